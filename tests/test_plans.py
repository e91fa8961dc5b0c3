"""The physical plans keep their shape: pruning, pushdown, shuffles, bounded windows."""

from pyspark.sql import functions as F

from riskspark.operators import cases, contract, evaluation, ordering, sampling
from riskspark.operators import reference_state as ref
from riskspark.operators.history import KeyHistory
from riskspark.sources import readers
from riskspark.sources import demo_cases as demo
from riskspark.sources.demo_tables import table, txn

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_filter_reaches_the_scan(spark):
    text = plan(readers.point_lookup(table(spark, FOLDER, "orders"), 42, "o_orderkey"))
    assert "EqualTo(o_orderkey,42)" in text


def test_scan_reads_only_named_columns(spark, tmp_path):
    txn(spark, FOLDER).write.parquet(f"{tmp_path}/wide")
    text = plan(readers.scan_parquet(spark, f"{tmp_path}/wide", ["TransactionID", "card1"]))
    assert "ReadSchema: struct<TransactionID:bigint,card1:bigint>" in text


def test_split_does_not_shuffle_wide_rows(spark, tmp_path):
    txn(spark, FOLDER).write.parquet(f"{tmp_path}/rows")
    text = plan(sampling.split_chronological(spark.read.parquet(f"{tmp_path}/rows")))
    assert "Exchange" not in text


def test_short_duplicate_lists_do_not_shuffle_the_rows(spark, tmp_path):
    txn(spark, FOLDER).write.parquet(f"{tmp_path}/rows")
    text = plan(contract.validate_rows(spark.read.parquet(f"{tmp_path}/rows")))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_global_windows_run_on_chunk_totals_only(spark):
    rows = txn(spark, FOLDER)
    for df in (evaluation.pr_curve(rows), evaluation.capacity(rows), ordering.sequence_numbers(rows)):
        single = [line for line in plan(df).splitlines() if "SinglePartition" in line]
        assert len(single) <= 2  # chunk offsets and one row of totals, never the rows
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_top_contributions_are_cut_before_the_shuffle(spark):
    from riskspark.operators.contributions import rank_contributions
    assert "WindowGroupLimit" in plan(rank_contributions(demo.contributions(spark, FOLDER), ["transaction_id", "model_identifier"]))


def test_alerts_shuffle_once(spark):
    scored = demo.predictions(spark, FOLDER)
    assert plan(cases.derive_alerts(scored)).count("Exchange hashpartitioning") == 1


def test_small_state_is_looked_up_without_shuffling_rows(spark, tmp_path):
    rows = txn(spark, FOLDER)
    rows.write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    state = ref.build(stored.where(F.col("TransactionDT") < 86_400 * 20), [KeyHistory("card1_key"), KeyHistory("device_key")])
    assert "Exchange hashpartitioning" not in plan(ref.apply(stored, state))
