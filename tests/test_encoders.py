import pytest
from pyspark.sql import functions as F

from riskspark.operators import encoders as enc
from riskspark.operators import profiling
from tests.conftest import rows
from tests.fixtures import basic


def test_rare_and_unseen(spark):
    train = basic(spark)
    levels = enc.fit_levels(train, ["ProductCD"], rare_min_count=4)
    score = spark.createDataFrame([("S",), ("new",), (None,), ("H",)], "ProductCD string")
    assert [r["ProductCD"] for r in rows(enc.apply_rare_levels(score, levels, ["ProductCD"]))] == ["OTHER", "UNKNOWN", "MISSING", "H"]
    vocabulary = enc.fit_vocabulary(levels)
    found = {r["ProductCD"]: r["ProductCD__index"] for r in rows(enc.apply_vocabulary(score, vocabulary, ["ProductCD"]))}
    assert found == {"S": 2, "new": 1, None: 0, "H": 3}


def test_missing_never_seen_in_training(spark):
    train = spark.createDataFrame([("a",)] * 25, "x string")
    levels = enc.fit_levels(train, ["x"])
    score = spark.createDataFrame([(None,)], "x string")
    assert rows(enc.apply_rare_levels(score, levels, ["x"]))[0]["x"] == "UNKNOWN"
    assert rows(enc.apply_vocabulary(score, enc.fit_vocabulary(levels), ["x"]))[0]["x__index"] == 0


def test_frequency(spark):
    train = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x string")
    score = spark.createDataFrame([("a",), (None,), ("z",)], "x string")
    found = {r["x"]: r["x__frequency"] for r in rows(enc.apply_frequency(score, enc.fit_levels(train, ["x"]), ["x"]))}
    assert found == {"a": 0.5, None: 0.25, "z": 0.0}


def test_scaling(spark):
    train = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (None, None, 5.0), (9.0, None, 5.0)], "x double, e double, c double")
    fitted = enc.fit_scaling(train, ["x", "e", "c"])
    v = enc.scaling_values(fitted)
    assert v["x"]["median"] == 2.0 and v["x"]["mean"] == 3.5 and v["e"]["median"] == 0.0 and v["c"]["std"] == 1.0
    one = rows(enc.apply_scaling(spark.createDataFrame([(None, float("inf"), 6.0)], "x double, e double, c double"), fitted, ["x", "e", "c"]))[0]
    assert one["x__missing"] == 1.0 and one["e__scaled"] == enc.CLAMP and one["c__scaled"] == 1.0


def test_groups_and_bands(spark):
    df = basic(spark)
    groups = profiling.infer_feature_groups(df)
    assert groups["numeric"] == ["TransactionDT", "TransactionAmt"] and groups["high_cardinality"] == []
    assert groups["low_cardinality"] == ["ProductCD", "card1", "card2", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceType"]
    shown = [r["b"] for r in rows(spark.createDataFrame([(20,), (21,), (100,), (101,), (1000,), (1001,)], "n int").select(profiling.cardinality_band(F.col("n")).alias("b")))]
    assert shown == ["low", "medium", "medium", "high", "high", "very_high"]


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "isFraud int")
    assert profiling.positive_weight(df, "balanced") == 3.0
    assert profiling.positive_weight(df, "sqrt_balanced") == pytest.approx(3 ** 0.5)
    assert profiling.positive_weight(df, "none") == 1.0
    with pytest.raises(ValueError):
        profiling.positive_weight(df, "other")
    with pytest.raises(Exception, match="no fraud examples"):
        profiling.positive_weight(df.where("isFraud = 0"), "balanced")


def test_linear_encoding(spark):
    groups = {"numeric": ["TransactionAmt"], "low_cardinality": ["ProductCD"], "high_cardinality": ["card1"]}
    state = enc.fit_linear(basic(spark), groups, rare_min_count=4)
    encoded, names = enc.apply_linear(spark.createDataFrame([(None, "S", 9), (5.0, "H", 99)], "TransactionAmt double, ProductCD string, card1 long"), state)
    assert names == ["num__TransactionAmt", "num__TransactionAmt__missing", "cat__ProductCD__H", "cat__ProductCD__infrequent", "freq__card1"]
    first, second = [[r[f"x{i}"] for i in range(5)] for r in rows(encoded)]
    assert first[2:4] == [0.0, 1.0] and second[2:4] == [1.0, 0.0] and second[4] == 0.0 and first[1] > 0 and second[1] == 0.0


def test_any_number_of_levels(spark):
    train = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 1500).alias("x"))
    levels = enc.fit_levels(train.union(train.where("x < 'v2'")), ["x"], rare_min_count=3)
    score = spark.createDataFrame([("v1",), ("v3",), ("nowhere",)], "x string")
    assert [r["x"] for r in rows(enc.apply_rare_levels(score, levels, ["x"]), "x")] == ["OTHER", "UNKNOWN", "v1"]


def test_too_many_levels_are_refused(spark):
    df = spark.range(300).selectExpr("id as TransactionID", "cast(id % 101 as string) as wide", "cast(id % 3 as string) as small")
    with pytest.raises(ValueError, match="wide"):
        enc.fit_linear(df, {"numeric": [], "low_cardinality": ["wide", "small"], "high_cardinality": []})
    assert set(enc.fit_linear(df, {"numeric": [], "low_cardinality": ["small"], "high_cardinality": ["wide"]})["one_hot"]) == {"small"}


def test_one_join_for_any_number_of_columns(spark):
    train = spark.range(300).selectExpr("id", *[f"if(id % {3 + i} = 0, null, cast(id % {5 + i} as string)) as c{i}" for i in range(30)])
    columns = [f"c{i}" for i in range(30)]
    levels = enc.fit_levels(train, columns, rare_min_count=40)
    odd = spark.createDataFrame([(None, *["new"] * 30), (7, *[None] * 30), (7, *[None] * 30)], "id long, " + ", ".join(f"c{i} string" for i in range(30)))
    asked = train.unionByName(odd)
    once = enc.apply_levels_once(asked, levels, frequency=columns, rare=columns[:9])
    apart = enc.apply_rare_levels(enc.apply_frequency(asked, levels, columns), levels, columns[:9])
    assert once.columns == apart.columns
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(once) == plain(apart)
    planned = [enc.apply_levels_once(asked, levels, frequency=columns[:n]) for n in (2, 30)]  # not run yet: AQE would list its plan twice
    exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in planned]
    assert exchanges[0] == exchanges[1]
    assert enc.apply_levels_once(asked.limit(0), levels, frequency=columns).count() == 0
    assert enc.apply_levels_once(asked, levels).columns == asked.columns
