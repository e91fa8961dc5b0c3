"""Quality classifier: densities against their definition, held-out accuracy, length, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from riskspark.llm import quality
from riskspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_scores_equal_the_definition(spark):
    """The query's own path against means, covariances and densities taken over collected rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    values = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    logs, sizes = {}, {}
    for k in (0, 1):
        x = np.array([values[i] for i in sorted(texts) if labels.get(i) == k and not held[i]])
        covariance = quality.shrunk(np.cov(x.T, bias=True), len(x), quality.FLOOR)
        inverse, (_, log_det) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
        far = {i: v - x.mean(0) for i, v in values.items()}
        logs[k] = {i: -0.5 * d @ inverse @ d - 0.5 * log_det for i, d in far.items()}
        sizes[k] = len(x)
    rows = QUERIES["op11_quality"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        logit = logs[1][r["doc_id"]] - logs[0][r["doc_id"]] + np.log(sizes[1] / sizes[0])
        wanted = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
        assert r["score"] == pytest.approx(wanted, abs=1e-6) and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held[r["doc_id"]]
    scores = {k: [r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == k] for k in (0, 1)}
    area = np.mean([(b > a) + 0.5 * (b == a) for a in scores[0] for b in scores[1]])
    assert area > 0.98 and np.mean(np.array(scores[1]) >= 0.3) > 0.97 and np.mean(np.array(scores[0]) >= 0.3) < 0.1


def test_shrinkage():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6))
    covariance = np.cov(x.T, bias=True)
    few, many = quality.shrunk(covariance, 10, 0.0), quality.shrunk(covariance, 10**9, 0.0)
    assert np.allclose(many, covariance, atol=1e-6) and np.allclose(np.diag(few), np.diag(covariance))
    off = lambda c: np.abs(c - np.diag(np.diag(c))).sum()
    assert off(few) < off(many)
    flat = quality.shrunk(np.zeros((4, 4)), 100, 0.05)  # statistics that never vary
    assert np.allclose(flat, 0.0025 * np.eye(4)) and np.linalg.cholesky(flat).shape == (4, 4)
    assert np.linalg.cholesky(quality.shrunk(np.ones((5, 5)), 30, 0.05)).shape == (5, 5)  # statistics that are all the same


def test_length_alone_is_no_evidence(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    measured = quality.measure(docs)
    model = quality.train(measured, labels)
    good = [r["text"] for r in docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").collect()]
    long = [("\n".join(good[k::3]) * 10)[:size] for k, size in enumerate([3_000_000, 1_000_000, 200_000])]
    values = np.array([quality.statistics(t) for t in long])
    assert (model.scores(values) > 0.9).all()
    loud = ["\n".join(w.upper() + "!!" for w in t.split()) for t in long]
    assert (model.scores(np.array([quality.statistics(t) for t in loud])) < 0.1).all()


def test_statistics_by_hand():
    got = dict(zip(quality.NAMES, quality.statistics("Ab ab ab!\nAb ab ab!\n")))
    share = lambda part, whole, often, kind: quality._share(part, whole, often, quality.PRIOR[kind], quality.LEAST[kind])
    assert got["capitals"] == share(2, 12, 0.02, 0) and got["letters"] == share(12, 14, 0.97, 0) and got["loud"] == share(2, 14, 0.002, 0)
    assert got["again"] == share(2, 6, 0.01, 1) and got["distinct"] == share(2, 6, 0.9, 1) and got["commonest"] == share(4, 6, 0.06, 1)
    assert got["repeated_lines"] == share(1, 2, 0.02, 2) and got["closed_lines"] == share(2, 2, 0.95, 2)
    assert np.isfinite([quality.statistics(t) for t in ["", " ", "\n", "\x00", "!", "é", "日本語", "a" * 100_000, "  \x85"]]).all()


def test_awkward_rows(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choices(["some", "quiet", "words", "that", "follow."], k=60))
    bad = lambda: " ".join(rng.choices(["BUY!!", "$$$", "NOW!!!"], k=60))
    rows = [(i, good()) for i in range(80)] + [(100 + i, bad()) for i in range(80)] + [(900, None), (901, ""), (902, "x" * 500_000), (None, good()), (3, good()), (3, good())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as label", "3 as values", "0 as quality")
    marks = [(i, 1) for i in range(80)] + [(100 + i, 0) for i in range(80)] + [(5, 0), (None, 1), (6, None), (777, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int").selectExpr("*", "'t' as text", "9 as label")
    found = quality.classify(df, labels, quality.Fit(least=30)).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["score"] for r in found}
    assert all(by[i] > 0.5 for i in [*range(80), None]) and all(by[100 + i] < 0.1 for i in range(80))
    for marks_now, constant in [(labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)]:
        assert {r["score"] for r in quality.classify(df, marks_now).collect()} == {constant}
    few = quality.classify(df, labels.where("doc_id in (1, 2, 3, 104)")).collect()  # too few for a covariance
    assert len({r["score"] for r in few}) == 1
    assert quality.classify(df.limit(0), labels).count() == 0
