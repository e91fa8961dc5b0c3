import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskspark.operators import ordering as o
from riskspark.operators import sampling as s
from tests.conftest import rows
from tests.fixtures import basic


def test_running_totals_across_chunks_and_groups(spark):
    rng = random.Random(3)
    data = [("ab"[rng.random() < 0.8], i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, i int, v int").repartition(5)
    found = rows(o.running_totals(df, [F.col("i")], {"total": F.col("v")}, by=["g"], chunk_rows=13), "i")
    sums = {"a": 0, "b": 0}
    for g, i, v in sorted(data, key=lambda r: r[1]):
        sums[g] += v
        assert found[i]["total"] == sums[g]


def test_sequence_with_ties(spark):
    df = spark.createDataFrame([(i, i // 50) for i in range(500)], "TransactionID long, TransactionDT long").repartition(7)
    found = {r["TransactionID"]: r["sequence_number"] for r in rows(o.sequence_numbers(df))}
    assert found == {i: i for i in range(500)}


def test_fifo_violations(spark):
    good = spark.createDataFrame([(10, 1, 0), (11, 2, 1), (12, 2, 2)], "TransactionID long, TransactionDT long, sequence_number long")
    assert rows(o.fifo_violations(good)) == [{"order_violations": 0, "sequence_violations": 0}]
    bad = spark.createDataFrame([(10, 3, 0), (11, 2, 1), (12, 2, 1)], good.schema)
    assert rows(o.fifo_violations(bad)) == [{"order_violations": 1, "sequence_violations": 1}]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles(spark, n):
    rng = random.Random(n)
    data = [("a", float(rng.randrange(n)), None if rng.random() < 0.2 and n > 2 else rng.random()) for _ in range(n)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    found = {r["column"]: r["quantile"] for r in rows(o.exact_quantiles(df, ["x", "y"], 0.5, by=["g"], accuracy=50))}
    for i, name in ((1, "x"), (2, "y")):
        values = [r[i] for r in data if r[i] is not None]
        assert found[name] == pytest.approx(statistics.median(values))
    disc = {r["column"]: r["quantile"] for r in rows(o.exact_quantiles(df, ["x"], 0.95, discrete=True))}
    ordered = sorted(r[1] for r in data)
    assert disc["x"] == ordered[max(0, -(-95 * n // 100) - 1)]


def test_chronological_split(spark):
    df = s.split_chronological(basic(spark))
    sizes = {r["split"]: r for r in rows(s.split_summary(df))}
    assert {k: v["rows"] for k, v in sizes.items()} == {"train": 8, "validation": 2, "test": 2}
    assert sizes["train"]["transaction_dt_max"] < sizes["validation"]["transaction_dt_min"]
    for bad in ({"train": 0.9, "validation": 0.2}, {"train": 0.0}):
        with pytest.raises(ValueError):
            s.split_chronological(basic(spark), **bad)


def test_folds(spark):
    assert s.fold_bounds(850) == [(int(850 * a / 0.85), int(850 * b / 0.85)) for a, b in s.FOLD_BOUNDS]
    with pytest.raises(ValueError):
        s.fold_bounds(99)
    df = spark.range(850).select(F.col("id").alias("TransactionID"), F.col("id").alias("TransactionDT"))
    found = rows(s.split_expanding_folds(df).groupBy("fold", "role").agg(F.min("TransactionID").alias("lo"), F.max("TransactionID").alias("hi")), "fold", "role")
    for fold in (1, 2, 3):
        train, valid = (r for r in found if r["fold"] == fold)
        assert train["lo"] == 0 and train["hi"] + 1 == valid["lo"]
    assert max(r["hi"] for r in found) == 849


def test_stratified_sample(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("TransactionID"), (F.col("id") % 20 == 0).cast("int").alias("isFraud"))
    sample = s.sample_stratified(df, 200)
    assert {r["isFraud"]: r["count"] for r in rows(sample.groupBy("isFraud").count())} == {0: 190, 1: 10}
    again = s.sample_stratified(df.repartition(3), 200)
    assert sample.exceptAll(again).isEmpty()
    assert s.sample_stratified(df, 5000).count() == 1000
    assert {r["isFraud"]: r["count"] for r in rows(s.sample_debug(df, 5).groupBy("isFraud").count())} == {0: 5, 1: 1}


def test_samples_of_many_classes_and_missing_ones(spark):
    df = spark.range(6000).select(F.col("id").alias("TransactionID"), F.when(F.col("id") % 300 < 299, F.col("id") % 300).cast("int").alias("isFraud"))
    debug = {r["isFraud"]: r["count"] for r in rows(s.sample_debug(df, 600).groupBy("isFraud").count())}
    assert len(debug) == 300 and None in debug and set(debug.values()) == {2}
    assert s.sample_stratified(df, 900).count() == 900


def test_sample_takes_the_smallest_hashes(spark):
    import hashlib

    df = spark.range(40_000).select(F.col("id").alias("TransactionID"), (F.col("id") % 2).cast("int").alias("isFraud"))
    got = {r["TransactionID"] for r in s.sample_stratified(df, 9000).collect()}
    ranked = sorted(range(40_000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert got == {i for c in (0, 1) for i in [x for x in ranked if x % 2 == c][:4500]}
