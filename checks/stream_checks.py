"""Streams over the whole adapter view, compared with the batch result where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.history_checks import KEYED, past, whole
from checks.registry import query, r, rounded, txn_sql
from checks.history_checks import mean_sql, std_sql, sums_cte
from riskspark.functions.row_features import text_or_missing
from riskspark.operators.history import KeyHistory
from riskspark.session import scratch_path
from riskspark.sources.demo_tables import txn
from riskspark.streaming.keyed_state import keyed_history
from riskspark.streaming import replay
from riskspark.streaming.replay import append_replay, paced, read_replay, write_replay
from riskspark.streaming.scoring import StreamJob

COLUMNS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "addr1", "D1", "P_emaildomain", "DeviceType", "DeviceInfo", "probability"]
MODEL = "logistic_regression.v2"
SLICES, COMPACT = 4, 2  # micro-batches of a query, and how many of them are folded at a time


def scorer(features):
    return features.select("TransactionID", F.lit(MODEL).alias("model_identifier"), F.col("probability").alias("risk_score"))


def job(spark, sf_dir, specs=None, labels=None, spoil=False, slices=SLICES, **options):
    """A job, its folder, schema and rows per micro-batch over a replay of the whole view; ``spoil`` makes some rows fail."""
    rows = txn(spark, sf_dir)
    if spoil:
        rows = rows.withColumn("TransactionAmt", F.when(F.col("k") == 23, -1.0).otherwise(F.col("TransactionAmt")))
    folder = scratch_path(spark, "stream")
    schema = write_replay(rows.select(*COLUMNS), f"{folder}/in")
    thresholds = spark.createDataFrame([(MODEL, 0.9)], "model_identifier string, threshold double")
    options = {"compact_every": COMPACT} | options
    work = StreamJob(spark, f"{folder}/out", scorer, thresholds, specs or [KeyHistory("card1_key")], labels=labels, **options)
    work.seed(schema)
    last = spark.read.parquet(f"{folder}/in/index").agg(F.coalesce(F.max("last"), F.lit(-1))).first()[0]  # numbers are dense
    return work, folder, schema, -(-(last + 1) // slices)


def drained(work, folder, schema, size):
    replay.drained(work.start(f"{folder}/in", schema, f"{folder}/checkpoint", rows_per_trigger=size))
    return work


@query("stream_replay_source", txn_sql(f"""
select cast(sequence_number // ((n + {SLICES} - 1) // {SLICES}) as bigint) as batch, count(*) as rows, min(sequence_number) as first_sequence, max(sequence_number) as last_sequence
from (select row_number() over (order by TransactionDT, TransactionID) - 1 as sequence_number, count(*) over () as n from txn) group by 1"""))
def _source(spark, sf_dir):
    _, folder, schema, size = job(spark, sf_dir)
    seen = f"{folder}/seen"
    source = read_replay(spark, f"{folder}/in", schema, rows_per_trigger=size)
    writer = source.writeStream.foreachBatch(lambda rows, batch: rows.agg(
        F.lit(batch).cast("bigint").alias("batch"), F.count(F.lit(1)).alias("rows"), F.min("sequence_number").alias("first_sequence"),
        F.max("sequence_number").alias("last_sequence")).write.mode("overwrite").parquet(f"{seen}/part={batch}")
    ).option("checkpointLocation", f"{folder}/checkpoint")
    replay.drained(paced(writer, rows_per_trigger=size, rate=None).start())
    return spark.read.parquet(seen).drop("part")


def stream_sql():
    fresh = "fresh as (select *, cast(row_number() over (partition by uid_proxy, coalesce(P_emaildomain, 'MISSING') order by TransactionDT, TransactionID) = 1 as int) as new_mail from keyed)"
    sums = sums_cte("uid_proxy", "amt_u", "summed", "fresh")
    return txn_sql(f"""select TransactionID, row_number() over {whole('uid_proxy')} - 1 as uid_proxy_prior_count,
      cast(TransactionDT - lag(TransactionDT) over {whole('uid_proxy')} as double) as uid_proxy_seconds_since_previous,
      n_ as uid_proxy_amount_prior_numeric_count, {r(mean_sql('n_', 's_', 1000), 'uid_proxy_amount_prior_mean')}, {r(std_sql('n_', 's_', 'q_', 1000), 'uid_proxy_amount_prior_std')},
      cast(coalesce(sum(new_mail) over {past('uid_proxy')}, 0) as bigint) as uid_proxy_P_emaildomain_prior_nunique,
      row_number() over {whole('device_key')} - 1 as device_key_prior_count from summed""", KEYED, fresh, sums)


@query("stream_score_then_update", stream_sql())
def _update(spark, sf_dir):
    """Features seen by the stream equal the features of one batch window."""
    specs = [KeyHistory("uid_proxy", amounts=True, distinct=("P_emaildomain",)), KeyHistory("device_key")]
    rows = drained(*job(spark, sf_dir, specs, slices=8, compact_every=3)).output("features")
    return rows.select(
        "TransactionID", "uid_proxy_prior_count", "uid_proxy_seconds_since_previous", "uid_proxy_amount_prior_numeric_count",
        rounded("uid_proxy_amount_prior_mean"), rounded("uid_proxy_amount_prior_std"), "uid_proxy_P_emaildomain_prior_nunique", "device_key_prior_count")


@query("stream_stateful_key", txn_sql(f"""
select card1_key as key, TransactionID, row_number() over {whole('card1_key')} - 1 as prior_count, cast(TransactionDT - lag(TransactionDT) over {whole('card1_key')} as double) as seconds_since_previous,
  n_ as amount_prior_numeric_count, {r(mean_sql('n_', 's_', 1000), 'amount_prior_mean')}, {r(std_sql('n_', 's_', 'q_', 1000), 'amount_prior_std')} from summed""", KEYED, sums_cte("card1_key", "amt_u", "summed")))
def _stateful(spark, sf_dir):
    _, folder, schema, size = job(spark, sf_dir)
    source = read_replay(spark, f"{folder}/in", schema, rows_per_trigger=size)
    history = keyed_history(source.withColumn("card1_key", text_or_missing("card1", source.columns)), "card1_key")
    writer = history.writeStream.format("parquet").option("path", f"{folder}/keyed").option("checkpointLocation", f"{folder}/checkpoint")
    replay.drained(paced(writer, rows_per_trigger=size, rate=None).start())
    number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return spark.read.parquet(f"{folder}/keyed").select(
        "key", "TransactionID", "prior_count", number("seconds_since_previous").alias("seconds_since_previous"), "amount_prior_numeric_count",
        rounded(number("amount_prior_mean")).alias("amount_prior_mean"), rounded(number("amount_prior_std")).alias("amount_prior_std"))


@query("stream_late_guard", txn_sql("""
select TransactionID, 'invalid_prediction_input' as error_code, 'Behavioral reference overlaps the transaction being scored' as error_message from txn where TransactionDT < 86400 * 4"""))
def _late(spark, sf_dir):
    """History up to day four is known already; its rows are refused when they arrive again."""
    work, folder, schema, size = job(spark, sf_dir)
    work.seed(schema, spark.read.schema(schema).parquet(f"{folder}/in/rows/part=0").where("TransactionDT < 86400 * 4"))
    return drained(work, folder, schema, size).output("dead_letters").select("TransactionID", "error_code", "error_message")


@query("stream_dead_letter", txn_sql("""
select TransactionID, 'invalid_prediction_input' as error_code, 'TransactionAmt must be a finite non-negative number' as error_message from txn where k = 23"""))
def _dead(spark, sf_dir):
    return drained(*job(spark, sf_dir, spoil=True)).output("dead_letters").select("TransactionID", "error_code", "error_message")


@query("stream_counters", txn_sql("""
select count(*) as received_count, count(*) filter (where k <> 23) as processed_count, count(*) filter (where k = 23) as failed_count,
  count(*) filter (where k <> 23 and probability >= 0.9) as fraud_count, cast(round(sum(cast(TransactionAmt as decimal(18,6))) filter (where k <> 23 and probability >= 0.9), 2) as double) as suspicious_value,
  count(*) - 1 as current_sequence from txn"""))
def _counters(spark, sf_dir):
    return drained(*job(spark, sf_dir, spoil=True)).totals()


@query("stream_idempotent_sink", txn_sql("select TransactionID, probability as highest_risk_score, cast(1 as bigint) as model_agreement, TransactionAmt as suspicious_amount from txn where probability >= 0.9"))
def _idempotent(spark, sf_dir):
    """The last batch is delivered twice; its outputs are replaced, not repeated."""
    work, folder, schema, size = job(spark, sf_dir)
    drained(work, folder, schema, size)
    last = work.output("features").where(F.col("batch") == SLICES - 1).select(*schema.fieldNames())
    work.process(last, SLICES - 1)
    return work.output("alerts").select("TransactionID", "highest_risk_score", "model_agreement", "suspicious_amount")


@query("stream_label_reveal", txn_sql("select TransactionID, probability >= 0.9 as decision, isFraud = 1 as actual_label from txn"))
def _labels(spark, sf_dir):
    labels = txn(spark, sf_dir).select("TransactionID", (F.col("isFraud") == 1).alias("actual_label"))
    work = drained(*job(spark, sf_dir, labels=labels))
    assert "actual_label" not in work.output("features").columns
    return work.output("predictions").select("TransactionID", "decision", "actual_label")


@query("stream_stop_resume", txn_sql(f"select TransactionID, row_number() over {whole('card1_key')} - 1 as card1_key_prior_count from keyed", KEYED))
def _resume(spark, sf_dir):
    """Stop after the first slice, add the rest, resume from the checkpoint."""
    work, folder, schema, size = job(spark, sf_dir)
    rows = spark.read.schema(schema).parquet(f"{folder}/in/rows/part=0")
    for part in (F.col("sequence_number") < size, F.col("sequence_number") >= size):
        append_replay(rows.where(part), f"{folder}/late_in")
        replay.drained(work.start(f"{folder}/late_in", schema, f"{folder}/resume", rows_per_trigger=2 * size))
    return work.output("features").select("TransactionID", "card1_key_prior_count")


@query("stream_event_rows", txn_sql("""
select sequence_number, TransactionID, case when k = 23 then 'FAILED' else 'COMPLETED' end as status, case when k = 23 then 'invalid_prediction_input' end as error_code, true as in_order
from (select *, row_number() over (order by TransactionDT, TransactionID) - 1 as sequence_number from txn)"""))
def _events(spark, sf_dir):
    """The life of every row as the job stamps it: fetched, begun, done."""
    events = drained(*job(spark, sf_dir, spoil=True)).output("events")
    order = (F.col("arrival_time") <= F.col("completed_at")) & (F.col("processing_started_at") < F.col("completed_at"))
    return events.select("sequence_number", "TransactionID", "status", "error_code", order.alias("in_order"))


@query("stream_run_metrics", txn_sql("""
select 'run' as run_id, count(*) as received, count(*) filter (where k <> 23) as processed, count(*) filter (where k = 23) as failed, true as timed,
  count(*) filter (where k <> 23 and probability >= 0.9) as fraud_alerts, cast(round(sum(cast(TransactionAmt as decimal(18,6))) filter (where k <> 23 and probability >= 0.9), 2) as double) as suspicious_value from txn"""))
def _run_metrics(spark, sf_dir):
    """``stream_metrics`` of the job's own events and alerts; its times are only checked to be there."""
    found = drained(*job(spark, sf_dir, spoil=True)).metrics()
    timed = (F.col("average_latency_ms") > 0) & (F.col("p95_latency_ms") > 0) & (F.col("throughput") > 0)
    return found.select("run_id", "received", "processed", "failed", timed.alias("timed"), "fraud_alerts", "suspicious_value")
