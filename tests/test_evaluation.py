import math
import random

import pytest
from pyspark.sql import functions as F

from riskspark.operators import evaluation as e
from tests.conftest import rows

SCHEMA = "TransactionID long, isFraud int, probability double"


def frame(spark, labels, scores):
    return spark.createDataFrame([(i, y, float(p)) for i, (y, p) in enumerate(zip(labels, scores))], SCHEMA)


def brute_ap(y, p):
    total, ap, seen = sum(y), 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        tp = sum(a for a, b in zip(y, p) if b >= cut)
        recall = tp / total
        ap += (recall - seen) * tp / sum(b >= cut for b in p)
        seen = recall
    return ap


def brute_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_perfect_order(spark):
    """Four fraud cases above six others: any floor up to 4/10 can be had with full recall."""
    curve = e.pr_curve(frame(spark, [1, 0, 1, 0, 0, 1, 0, 0, 1, 0], [0.81, 0.33, 0.77, 0.12, 0.45, 0.93, 0.27, 0.06, 0.66, 0.51]))
    assert rows(e.ranking_metrics(curve)) == [{"average_precision": 1.0, "roc_auc": 1.0}]
    best = rows(e.operating_threshold(curve, floor=0.8))[0]
    assert best == {"threshold": 0.51, "method": "maximum_recall_with_precision_at_least_0.80", "precision": 0.8, "recall": 1.0}
    fallback = rows(e.operating_threshold(curve, floor=1.01))[0]
    assert fallback["method"] == "maximum_f1_fallback" and fallback["threshold"] == 0.66


def test_empty_curve_falls_back(spark):
    curve = e.pr_curve(frame(spark, [], []))
    assert rows(e.operating_threshold(curve)) == [{"threshold": 0.5, "method": "fallback_0.5", "precision": 0.0, "recall": 0.0}]


@pytest.mark.parametrize("chunk_rows", [5, 1_000_000])
def test_against_definition_with_ties(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    y = [int(rng.random() < 0.2) for _ in range(300)]
    p = [round(min(1, max(0, rng.gauss(0.4 + 0.2 * a, 0.2))), 2) for a in y]
    df = frame(spark, y, p)
    curve = e.pr_curve(df, chunk_rows=chunk_rows)
    found = rows(e.ranking_metrics(curve))[0]
    assert found["average_precision"] == pytest.approx(brute_ap(y, p)) and found["roc_auc"] == pytest.approx(brute_auc(y, p))
    floor = 0.3
    good = [c for c in set(p) if sum(a for a, b in zip(y, p) if b >= c) / sum(b >= c for b in p) >= floor]
    assert rows(e.operating_threshold(curve, floor=floor))[0]["threshold"] == min(good)
    order = sorted(range(300), key=lambda i: (-p[i], i))
    for r in rows(e.capacity(df, chunk_rows=chunk_rows)):
        k = max(1, math.ceil(300 * e.CAPACITY_SHARES[r["share"]]))
        assert r["reviewed_rows"] == k and r["fraud_captured"] == sum(y[i] for i in order[:k])


def test_confusion_without_hits(spark):
    one = rows(e.confusion(frame(spark, [0, 1], [0.1, 0.2]), 0.9))[0]
    assert (one["tn"], one["fp"], one["fn"], one["tp"]) == (1, 0, 1, 0) and one["precision"] == one["f1"] == 0.0


@pytest.mark.parametrize("chunk_rows", [3, 1_000_000])
def test_blend_grid_against_definition(spark, chunk_rows):
    rng = random.Random(12)
    y = [int(rng.random() < 0.3) for _ in range(60)]
    a, b = ([round(min(0.99, max(0.01, rng.gauss(0.4 + gain * v, 0.2))), 2) for v in y] for gain in (0.1, 0.3))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(y, a, b))], "TransactionID long, isFraud int, a double, b double")
    logit = lambda p: math.log(p / (1 - p))
    fitted = rows(e.blend_fit(df, "a", "b", grid=6, chunk_rows=chunk_rows), "grid")
    for r in fitted:
        w = r["first_weight"]
        assert w == pytest.approx(r["grid"] / 5) and w + r["second_weight"] == pytest.approx(1)
        assert r["average_precision"] == pytest.approx(brute_ap(y, [w * logit(p) + (1 - w) * logit(q) for p, q in zip(a, b)]), abs=0.02)


def test_blended_scores_stay_inside_their_limits(spark):
    at = lambda p, q, w: rows(spark.range(1).select(e.blend(F.lit(p), F.lit(q), w).alias("p")))[0]["p"]
    assert at(0.2, 0.2, 0.7) == pytest.approx(0.2) and 0.25 < at(0.25, 0.75, 0.4) < 0.75
    assert at(1.0, 0.0, 1.0) == pytest.approx(1 - 1e-6)


def test_groups_are_independent(spark):
    df = frame(spark, [0, 1, 1, 0], [0.1, 0.9, 0.2, 0.8]).withColumn("split", F.when(F.col("TransactionID") < 2, "a").otherwise("b"))
    found = {r["split"]: r for r in rows(e.evaluate(df, 0.5, by=["split"]))}
    assert found["a"]["roc_auc"] == 1.0 and found["b"]["roc_auc"] == 0.0
