"""The network: gradients against finite differences, weights as given, validation stop, encoding and reload."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from riskspark.operators.profiling import positive_weight
from riskspark.plans import network
from riskspark.plans.network import Shape
from tests.conftest import rows

GROUPS = {"numeric": ["TransactionAmt"], "low_cardinality": ["ProductCD"], "high_cardinality": ["card1"]}


@pytest.fixture(scope="module")
def data(spark):
    """The label follows a category alone, in a way that its numbers do not order."""
    base = spark.range(1, 601).select(
        F.col("id").alias("TransactionID"), F.when(F.col("id") % 11 != 0, (F.col("id") % 37).cast("double")).alias("TransactionAmt"),
        F.when(F.col("id") % 3 == 0, "W").when(F.col("id") % 7 != 0, "C").alias("ProductCD"), (F.col("id") * 7 % 12).alias("card1"))
    return base.withColumn("isFraud", F.col("card1").isin(2, 5, 6, 11).cast("int")).cache()


def some_rows(seed=3, n=50):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)), rng.integers(0, [5, 7], (n, 2)), (rng.random(n) < 0.3).astype(float)


def test_gradient_equals_finite_differences():
    shape = Shape(3, (5, 7), (6, 4))
    x, c, y = some_rows()
    weight = np.where(y > 0, 1.4, 1.0)
    rng = np.random.default_rng(1)
    masks = [(rng.random((len(y), n)) >= 0.25) / 0.75 for n in shape.hidden]
    flat = shape.start(2) + rng.normal(0, 0.05, shape.size)  # no bias of zero: units without input would sit on the kink
    for used in (None, masks):
        _, gradient = network.loss_gradient(shape, flat, x, c, y, weight, used)
        for at in range(shape.size):
            move = np.zeros(shape.size)
            move[at] = 1e-5
            around = [network.loss_gradient(shape, flat + s * move, x, c, y, weight, used)[0] for s in (1, -1)]
            assert math.isclose((around[0] - around[1]) / 2e-5, gradient[at], rel_tol=1e-4, abs_tol=1e-5), at


def test_tasks_sum_to_the_gradient_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(network, "PIECE", 16)
    shape = Shape(3, (5, 7), (6, 4))
    x, c, y = some_rows(n=333)
    flat = shape.start(4)
    table = spark.createDataFrame([(float(b), a.tolist(), [int(v) for v in d]) for a, d, b in zip(x, c, y)], "_y double, _x array<double>, _c array<int>").repartition(7)
    loss, weight, gradient = network.summed_gradient(table, shape, flat, 1.4)
    expected = network.loss_gradient(shape, flat, x, c, y, np.where(y > 0, 1.4, 1.0))
    assert math.isclose(loss, expected[0], rel_tol=1e-9) and math.isclose(weight, 333 + 0.4 * y.sum(), rel_tol=1e-9)
    np.testing.assert_allclose(gradient, expected[1], rtol=1e-8, atol=1e-9)
    assert network.summed_gradient(table.limit(0), shape, flat, 1.4)[1] == 0


def test_weight_modes_differ_where_rounding_would_hide_it(spark):
    """240 negatives, 171 positives: a weight of 1.4, its root 1.18."""
    table = spark.range(411).select(F.col("id").alias("TransactionID"), (F.col("id") % 5).cast("double").alias("TransactionAmt"), (F.col("id") < 171).cast("int").alias("isFraud"))
    groups = {"numeric": ["TransactionAmt"], "low_cardinality": [], "high_cardinality": []}
    weights = [positive_weight(table, mode) for mode in ("balanced", "sqrt_balanced")]
    assert math.isclose(weights[0], 240 / 171) and math.isclose(weights[1], math.sqrt(240 / 171))
    fits = [network.train_network(table, table, groups=groups, weight_mode=m, hidden=(3,), dropout=(), epochs=1, batches=1) for m in ("balanced", "sqrt_balanced")]
    assert not np.allclose(fits[0].flat, fits[1].flat, atol=1e-9) or fits[0].history[0][1] != fits[1].history[0][1]
    assert fits[0].history[0][1] != fits[1].history[0][1]


def test_learns_from_embeddings_and_reloads(spark, data, tmp_path):
    train, valid = data.where("TransactionID % 5 <> 0"), data.where("TransactionID % 5 = 0")
    fitted = network.train_network(train, valid, groups=GROUPS, hidden=(8,), dropout=(0.1,), epochs=15, batches=2, rate=0.05)
    best = max(h[2] for h in fitted.history)
    assert best > 0.95
    assert math.isclose(network.average_precision(fitted.score(valid)), best, rel_tol=1e-9)  # the kept epoch is the best one
    network.save(fitted, spark, str(tmp_path / "net"))
    again = network.load(spark, str(tmp_path / "net"))
    assert rows(again.score(valid), "TransactionID") == rows(fitted.score(valid), "TransactionID")


def test_stops_without_gain(data):
    fitted = network.train_network(data, data.withColumn("isFraud", F.lit(0)), groups=GROUPS, hidden=(2,), dropout=(), epochs=9, patience=2, batches=1)
    assert [h[0] for h in fitted.history] == [1, 2, 3]


def test_rare_unseen_missing_levels_and_the_bound(spark, data):
    state = network.fit_inputs(data, GROUPS, levels=4, rare_min_count=20)
    assert len(state["levels"]["card1"]) == 4 and state["levels"]["ProductCD"] == ["C", "W"]
    shape = network.shape_of(state, (3,))
    asked = spark.createDataFrame(
        [(1, None, None, None, "a"), (2, 5.0, "new", 10**9, "b"), (3, float("inf"), "C", 3, None), (3, float("inf"), "C", 3, None)],
        "TransactionID long, TransactionAmt double, ProductCD string, card1 long, probability_note string").selectExpr("*", "7 as `_c`", "8 as TransactionAmt__scaled")
    model = network.Network(state, shape, shape.start(1))
    found = rows(model.score(asked), "TransactionID")
    assert len(found) == 4 and found[2] == found[3] and all(0 <= r["probability"] <= 1 for r in found)
    assert [r["_c"] for r in found] == [7] * 4 and [r["TransactionAmt__scaled"] for r in found] == [8] * 4
    assert model.score(asked.limit(0)).count() == 0
    tables, _ = shape.parts(model.flat)
    tables[1][network.OTHER_LEVEL] += 5.0  # only the unseen card and category use it
    moved = rows(model.score(asked), "TransactionID")
    assert moved[0] == found[0] and moved[1]["probability"] != found[1]["probability"]
    with pytest.raises(SparkRuntimeException):  # nothing to learn a class weight from
        network.train_network(data.limit(0), data, state=state, hidden=(2,), dropout=(), batches=1)
    with pytest.raises(ValueError):
        network.train_network(data, data, state=state, hidden=(2, 2), dropout=(0.1,))
