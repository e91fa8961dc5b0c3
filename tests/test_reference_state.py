import math

import pytest
from pyspark.sql import functions as F

from riskspark.operators import history as h
from riskspark.operators import reference_state as ref
from riskspark.operators.bucketed_state import BucketedState
from tests.conftest import rows
from tests.fixtures import HISTORY_SCHEMA, history
from tests.test_history import by_id, generated


def close(a, b, names):
    for n in names:
        assert a[n] == b[n] or math.isclose(a[n], b[n], rel_tol=1e-9), (n, a[n], b[n])


def names():
    return [n for s in h.KEY_HISTORIES for n in h.spec_features(s)]


def test_frozen_lookup_of_the_next_row(spark):
    df = history(spark)
    state = ref.build(df.where("TransactionID <= 15"))
    meta = state.meta.first()
    assert (meta["history_end_transaction_dt"], meta["history_end_transaction_id"], meta["history_row_count"]) == (2950.0, 15, 5)
    moved = df.where("TransactionID = 17").withColumns({"card1": F.lit(66).cast("long"), "addr1": F.lit(80).cast("long")})
    one = rows(ref.apply(moved, state))[0]
    assert one["card1_key_prior_count"] == 2 and one["card1_key_seconds_since_previous"] == 1600.0
    close(rows(ref.apply(df.where("TransactionID = 16"), state))[0], by_id(h.causal_features(df))[16], names())


def test_score_then_merge_equals_causal(spark):
    df = history(spark)
    causal = by_id(h.causal_features(df))
    state = ref.build(df.where("TransactionID <= 14"))
    for ident in (15, 16, 17):
        row = df.where(F.col("TransactionID") == ident)
        close(rows(ref.apply(row, state))[0], causal[ident], names())
        state = ref.merge(state, row)
    meta = state.meta.first()
    assert meta["history_end_transaction_id"] == 17 and meta["history_row_count"] == 7


def test_merge_equals_one_build(spark):
    df = spark.createDataFrame(generated(200, seed=9), HISTORY_SCHEMA)
    early, late = df.where("TransactionDT < 30000"), df.where("TransactionDT >= 30000")
    merged, whole = ref.merge(ref.build(early), late), ref.build(df)
    for spec in whole.specs:
        columns = whole.keyed[spec.key].columns
        assert merged.keyed[spec.key].select(*columns).exceptAll(whole.keyed[spec.key]).isEmpty()
        assert whole.keyed[spec.key].exceptAll(merged.keyed[spec.key].select(*columns)).isEmpty()
    assert merged.pairs.exceptAll(whole.pairs).isEmpty() and whole.pairs.exceptAll(merged.pairs).isEmpty()


def test_save_and_load(spark, tmp_path):
    df = history(spark)
    state = ref.build(df.where("TransactionID <= 15"))
    ref.save(state, str(tmp_path))
    loaded = ref.load(spark, str(tmp_path), state.specs)
    close(rows(ref.apply(df.where("TransactionID = 16"), loaded))[0], by_id(h.causal_features(df))[16], names())


def test_guards(spark):
    df = history(spark)
    state = ref.build(df.where("TransactionID <= 14"))
    with pytest.raises(ValueError, match="overlaps"):
        ref.require_after_cutoff(df.where("TransactionID = 14"), state.meta)
    with pytest.raises(ValueError, match="overlaps"):
        ref.merge(state, df.where("TransactionID = 13"))
    with pytest.raises(ValueError, match="target exclusion"):
        ref.require_after_cutoff(df.where("TransactionID = 15"), state.meta.withColumn("uses_target", F.lit(True)))
    with pytest.raises(ValueError, match="cannot be empty"):
        ref.build(df.limit(0))


def test_bucketed_merge_equals_one_build(spark, tmp_path):
    df = spark.createDataFrame(generated(120, seed=9), HISTORY_SCHEMA)
    times = sorted(r["TransactionDT"] for r in df.select("TransactionDT").collect())
    cuts = [0, times[50] + 1, times[80] + 1, times[100] + 1, 10**9]
    part = [df.where(F.col("TransactionDT").between(a, b - 1)) for a, b in zip(cuts, cuts[1:])]
    store = BucketedState(spark, str(tmp_path), ref.build(part[0]).specs, buckets=8, compact_every=1)
    store.create(ref.build(part[0]))
    for batch, rows_ in enumerate(part[1:]):
        store.merge(batch, rows_)
    merged, whole = store.whole(3), ref.build(df)
    for spec in whole.specs:
        columns = whole.keyed[spec.key].columns
        assert rows(merged.keyed[spec.key].select(*columns), "key") == rows(whole.keyed[spec.key], "key")
    assert rows(merged.pairs, "column", "key", "value") == rows(whole.pairs, "column", "key", "value")
    with pytest.raises(ValueError, match="overlaps"):
        store.merge(3, part[1])
