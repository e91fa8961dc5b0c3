import math
import random

import pytest
from pyspark.sql import functions as F

from riskspark.functions.row_features import with_v2_row_features
from riskspark.operators import history as h
from tests.conftest import rows
from tests.fixtures import HISTORY_SCHEMA, history


def by_id(df):
    return {r["TransactionID"]: r for r in rows(df)}


def test_known_values(spark):
    found = by_id(h.causal_features(history(spark)))
    assert [found[i]["card1_key_prior_count"] for i in (11, 13, 15, 16)] == [0, 1, 2, 3]
    assert [found[i]["card1_key_seconds_since_previous"] for i in (11, 13, 15, 16)] == [None, 600.0, 1350.0, 150.0]
    third = found[15]  # after amounts of 8 and 24 with the same client key
    assert third["uid_proxy_amount_prior_numeric_count"] == 2
    assert third["uid_proxy_amount_prior_mean"] == 16.0 and third["uid_proxy_amount_prior_std"] == 8.0
    assert third["uid_proxy_amount_difference"] == 32.0 and third["uid_proxy_amount_zscore"] == 4.0 and third["uid_proxy_amount_ratio"] == 3.0
    assert third["uid_proxy_P_emaildomain_prior_nunique"] == 2 and third["uid_proxy_DeviceInfo_prior_nunique"] == 1
    assert found[16]["uid_proxy_prior_count"] == 0  # another address


def test_label_and_future_do_not_matter(spark):
    base = history(spark)
    changed = base.withColumn("isFraud", 1 - F.col("isFraud")).withColumn(
        "TransactionAmt", F.when(F.col("TransactionID") == 17, 4321.0).otherwise(F.col("TransactionAmt")))
    audit = {r["check"]: r["violations"] for r in rows(h.leakage_audit(base, changed, F.col("TransactionID") < 17))}
    assert audit == {"past_features_changed": 0, "keys_without_first_row": 0}
    leaked = base.withColumn("TransactionAmt", F.col("TransactionAmt") + (F.col("TransactionID") == 11).cast("int"))
    assert {r["check"]: r["violations"] for r in rows(h.leakage_audit(base, leaked))}["past_features_changed"] > 0


def generated(n, seed):
    """Rows with ties in time, NULLs and one key that holds most rows."""
    rng = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        card = 7 if rng.random() < 0.6 else rng.randrange(5)
        out.append((
            i, rng.randrange(n // 3) * 1000, None if rng.random() < 0.1 else round(rng.uniform(0, 90), 2), card, 1,
            None if rng.random() < 0.2 else 1, 1, float(rng.randrange(2)), None if rng.random() < 0.3 else float(rng.randrange(9)), 1.0, None,
            "W", rng.choice(["a", "b", None]), None, None if rng.random() < 0.7 else "desktop", rng.choice(["x", "y", None]), None, None, 0))
    return out


def brute(data):
    """Row by row over everything earlier, as the definition says."""
    names = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]
    recs = sorted((dict(zip(names, r)) for r in data), key=lambda r: (r["TransactionDT"], r["TransactionID"]))
    text = lambda v: "MISSING" if v is None else str(v)
    for r in recs:
        anchor = round(r["TransactionDT"] / 86400 - r["D1"])
        r["uid"] = f"{text(r['card1'])}__{text(r['addr1'])}__{anchor}"
        r["device"] = f"{text(r['DeviceType'])}__{text(r['DeviceInfo'])}"
    result = {}
    for i, r in enumerate(recs):
        past = [p for p in recs[:i] if p["uid"] == r["uid"]]
        amounts = [p["TransactionAmt"] for p in past if p["TransactionAmt"] is not None]
        mean = sum(amounts) / len(amounts) if amounts else None
        std = math.sqrt(max(sum((a - mean) ** 2 for a in amounts) / len(amounts), 0)) if len(amounts) >= 2 else None
        result[r["TransactionID"]] = {
            "uid_proxy_prior_count": len(past),
            "uid_proxy_seconds_since_previous": float(r["TransactionDT"] - past[-1]["TransactionDT"]) if past else None,
            "uid_proxy_amount_prior_numeric_count": len(amounts), "uid_proxy_amount_prior_mean": mean, "uid_proxy_amount_prior_std": std,
            "uid_proxy_P_emaildomain_prior_nunique": len({p["P_emaildomain"] for p in past}),
            "device_key_prior_count": sum(p["device"] == r["device"] for p in recs[:i]),
            "card1_key_prior_count": sum(p["card1"] == r["card1"] for p in recs[:i]),
        }
    return result


def same(found, want):
    for ident, expected in want.items():
        for name, value in expected.items():
            got = found[ident][name]
            ok = got == value or (value is not None and got is not None and math.isclose(got, value, rel_tol=1e-9, abs_tol=1e-9))
            assert ok, (ident, name, got, value)


@pytest.mark.parametrize("hot_rows", [1_000_000, 40, 7])
def test_equals_definition_with_and_without_hot_keys(spark, hot_rows):
    data = generated(300, seed=hot_rows)
    df = spark.createDataFrame(data, HISTORY_SCHEMA)
    found = by_id(h.causal_features(df, hot_rows=hot_rows))
    assert len(found) == 300
    same(found, brute(data))


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_same_rows_at_any_width_with_repeated_and_missing_ids(spark, hot_rows):
    data = generated(60, seed=5)
    data += [data[3], data[3], (None, *data[7][1:]), (None, *data[8][1:])]
    narrow = with_v2_row_features(spark.createDataFrame(data, HISTORY_SCHEMA))
    wide = narrow.withColumns({f"extra_{i}": F.lit(i) for i in range(40)})
    names = h.feature_names(narrow.columns)
    both = [h.with_history(df, hot_rows=hot_rows) for df in (narrow, wide)]
    assert [df.count() for df in both] == [64, 64] and both[1].columns == [*wide.columns, *names]
    assert h.history_features(wide, hot_rows=hot_rows).count() == 64
    counts = [sorted(r["card1_key_prior_count"] for r in df.where("card1 = 7").collect()) for df in both]
    assert counts[0] == counts[1] == list(range(len(counts[0])))


def test_every_large_key_is_hot(spark):
    df = spark.range(15_000).select(F.concat(F.lit("k"), F.col("id") % 5000).alias("k"))
    assert h.hot_keys(df, ["k"], 2).count() == 5000


def test_amounts_that_are_not_finite_count_as_missing(spark):
    df = history(spark).withColumn("TransactionAmt", F.when(F.col("TransactionID") == 11, float("inf")).otherwise(F.col("TransactionAmt")))
    third = by_id(h.causal_features(df))[15]
    assert third["uid_proxy_prior_count"] == 2 and third["uid_proxy_amount_prior_numeric_count"] == 1 and third["uid_proxy_amount_prior_mean"] == 24.0


def test_hot_keys_lists_the_large_ones(spark):
    df = with_v2_row_features(spark.createDataFrame(generated(200, seed=2), HISTORY_SCHEMA))
    found = rows(h.hot_keys(df, ["card1_key", "device_key"], 90))
    assert ("card1_key", "7") in {(r["kind"], r["value"]) for r in found} and all(r["rows"] > 90 for r in found)


def test_equal_amounts_have_no_spread(spark):
    data = [(i, i * 10, 0.1, 1, 1, 1, 1, 0.0, 0.0, 0.0, 0.0, "W", "a", None, None, None, None, None, 0) for i in range(1, 9)]
    found = by_id(h.causal_features(spark.createDataFrame(data, HISTORY_SCHEMA)))
    assert found[8]["uid_proxy_amount_prior_std"] == 0.0 and found[8]["uid_proxy_amount_zscore"] is None


def test_window_plan_has_one_shuffle_per_key(spark):
    df = with_v2_row_features(history(spark))
    plan = h.history_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == len(h.KEY_HISTORIES)
    assert "SinglePartition" not in plan


def test_no_hot_key_needs_no_count_by_key(spark):
    """Keys that are nearly unique are not shuffled to find out that none is hot."""
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    found = h.hot_keys(df, ["k"], 100)
    assert found.count() == 0 and "Exchange" not in found._jdf.queryExecution().toString()


def test_audit_digests_stay_narrow_and_tell_nulls_apart(spark):
    df = spark.createDataFrame(generated(400, 9), HISTORY_SCHEMA)
    digests = h.past_digests(df, hot_rows=50)
    assert len(digests.columns) == 4
    moved = df.withColumn("D4", F.when(F.col("TransactionID") == 200, F.lit(99.0)).otherwise(F.col("D4")))
    names = ["TransactionID", "TransactionDT", "uid_proxy", *h.feature_names(h.with_v2_row_features(df).columns)]
    for other in (moved, df.where("TransactionID <> 100"), df.withColumn("isFraud", 1 - F.col("isFraud")), df.unionByName(df.where("TransactionID = 7"))):
        wide = h.causal_features(df).select(names).exceptAll(h.causal_features(other).select(names)).count()
        assert {r["check"]: r["violations"] for r in rows(h.leakage_audit(df, other))}["past_features_changed"] == wide
    assert rows(digests, "_digest", "_digest_2") == rows(h.past_digests(df), "_digest", "_digest_2")  # chunks of hot keys or not
