"""Run, prediction, alert and action tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators.cases import derive_alerts
from riskspark.operators.contract import encode_payload
from riskspark.sources.demo_tables import table, txn

THRESHOLDS = {"logistic_regression.v1": 0.9, "lightgbm.v1": 0.92, "catboost.v2": 0.95}
ACTIONS = ["CONFIRMED_FRAUD", "MARKED_LEGITIMATE", "ESCALATED", "CLOSED", "NOTE_ADDED", "NOTE_ADDED", "NOTE_ADDED"]
PAYLOAD = ["P_emaildomain", "ProductCD", "TransactionAmt", "TransactionID"]  # sorted names
WEEK = 604_800


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).withColumns({
        "run_id": F.concat(F.lit("run-"), F.floor(F.col("TransactionDT") / WEEK).cast("string")),
        "sequence_number": F.col("TransactionID") - 1,
    })


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(THRESHOLDS.items()), "model_identifier string, threshold double")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transaction and model, without thresholds."""
    values = {"logistic_regression.v1": F.col("probability"), "lightgbm.v1": (F.col("probability") + F.col("probability_b")) / 2, "catboost.v2": F.col("probability_b")}
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model_identifier"), v.alias("risk_score")) for m, v in values.items()])).alias("m")
    return _base(spark, sf_dir).select(
        "run_id", F.col("TransactionID").alias("transaction_id"), "sequence_number", F.col("TransactionAmt").alias("amount"),
        (F.col("isFraud") == 1).alias("actual_label"), (F.col("k") % 50 + 0.5).cast("double").alias("latency_ms"), "k", models,
    ).select("*", "m.*").drop("m")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])[F.col("model_identifier")]
    return scores(spark, sf_dir).withColumn("threshold", cut).withColumn("decision", F.col("risk_score") >= F.col("threshold"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    dt, k = F.col("TransactionDT").cast("double"), F.col("k")
    return _base(spark, sf_dir).select(
        "run_id", F.col("TransactionID").alias("transaction_id"), "sequence_number", dt.alias("arrival_time"),
        (k % 10).alias("queue_position"), (dt + 0.5).alias("processing_started_at"), (dt + 0.5 + (k % 40) / F.lit(64.0)).alias("completed_at"),
        F.when(k % 29 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(k % 29 == 0, "ValueError").alias("error_code"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = _base(spark, sf_dir).select("run_id", F.col("TransactionID").alias("transaction_id"), F.col("TransactionDT").alias("created_at"))
    return derive_alerts(predictions(spark, sf_dir)).join(times, ["run_id", "transaction_id"]).select(
        F.concat_ws(":", "run_id", F.col("transaction_id").cast("string")).alias("alert_id"), "run_id", "transaction_id",
        F.when(F.col("transaction_id") % 7 == 0, "IN_REVIEW").otherwise("OPEN").alias("status"),
        "highest_risk_score", "model_agreement", "selected_model_count", "suspicious_amount", "created_at", F.col("created_at").alias("updated_at"),
        F.array(*[F.lit(m) for m in THRESHOLDS]).alias("selected_models"), F.array(F.lit("V1"), F.lit("V2")).alias("selected_versions"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as analyst actions on the alert with the order's number."""
    names = F.array(*[F.lit(a) for a in ACTIONS])
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), names[F.col("l_linenumber") - 1].alias("action"),
        F.concat(F.lit("analyst-"), (F.col("l_suppkey") % 5).cast("string")).alias("analyst_identifier"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("created_at"),
        (F.col("l_partkey") * 100_000_000 + F.col("l_suppkey") * 10_000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("int")).alias("action_id"),
    )
    return lines.join(alerts(spark, sf_dir).select("transaction_id", "alert_id"), "transaction_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = events(spark, sf_dir).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("received_count"), F.count_if(F.col("status") == "COMPLETED").alias("processed_count"),
        F.count_if(F.col("status") == "FAILED").alias("failed_count"), F.max("sequence_number").alias("current_sequence"), F.max("completed_at").alias("created_at"))
    week = F.substring("run_id", 5, 3).cast("int")
    return grouped.withColumns({
        "status": F.element_at(F.array(*[F.lit(s) for s in ("COMPLETED", "STOPPED", "FAILED", "RUNNING")]), (week % 4 + 1).cast("int")),
        "client_id": F.concat(F.lit("client-"), (week % 2).cast("string")), "input_mode": F.lit("realtime"),
        "transactions_per_second": F.when(week == 3, 4).otherwise(2), "fraud_count": F.lit(0).cast("bigint"),
        "selected_models": F.array(*[F.lit(m) for m in THRESHOLDS]),
        "selected_versions": F.when(week == 2, F.array(F.lit("V3"))).otherwise(F.array(F.lit("V1"), F.lit("V2"))),
    })


def history_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("k") % 29 == 0
    return _base(spark, sf_dir).select(
        "run_id", F.col("sequence_number").alias("ordinal"), F.col("TransactionID").alias("transaction_id"),
        F.when(F.col("k") % 31 != 0, F.col("TransactionID").cast("string")).otherwise("").alias("raw_transaction_id"),
        encode_payload(PAYLOAD).alias("input_payload"), F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(failed, "invalid_prediction_input").alias("error_code"), F.when(failed, "refused").alias("error_message"))


def history_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of completed transactions; a quarter of them explained."""
    done = F.col("k") % 4 == 0
    return predictions(spark, sf_dir).where("k % 29 <> 0").select(
        "run_id", F.col("sequence_number").alias("ordinal"), "model_identifier", "risk_score", "threshold", "decision",
        F.when(done, "COMPLETED").otherwise("NOT_GENERATED").alias("explanation_status"),
        F.when(done, '[{"feature":"TransactionAmt"}]').alias("top_contributed_features"),
        F.when(done & (F.col("k") % 8 == 0), "amount").alias("reasoning"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic contributions of seven features for each flagged or unflagged prediction."""
    k, dt = F.col("k"), F.col("sequence_number")
    values = {
        "numeric__uid_proxy_prior_count": (k - 40) / F.lit(128.0), "card1_key_seconds_since_previous": (k % 7 - 3) / F.lit(8.0),
        "numeric__device_key_prior_count": (dt % 11 - 4) / F.lit(16.0), "uid_proxy_amount_prior_mean": (dt % 5 - 2) / F.lit(4.0),
        "uid_proxy_DeviceInfo_prior_nunique": (k % 3) / F.lit(32.0), "TransactionAmt": (k % 9 - 4) / F.lit(2.0),
        "card_address_key_amount_prior_std": F.lit(0.0),
    }
    features = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), v.cast("double").alias("contribution")) for n, v in values.items()])).alias("f")
    return predictions(spark, sf_dir).select("transaction_id", "model_identifier", "decision", features).select("transaction_id", "model_identifier", "decision", "f.*")


CASES_SQL = """
based as (select *, 'run-' || (TransactionDT // 604800) as run_id, TransactionID - 1 as sequence_number from txn),
scores as (
  select run_id, TransactionID as transaction_id, sequence_number, TransactionAmt as amount, isFraud = 1 as actual_label,
    cast(k % 50 + 0.5 as double) as latency_ms, k, m.model_identifier, m.threshold,
    case m.model_identifier when 'logistic_regression.v1' then probability when 'catboost.v2' then probability_b else (probability + probability_b) / 2 end as risk_score
  from based, (values ('logistic_regression.v1', 0.9::double), ('lightgbm.v1', 0.92::double), ('catboost.v2', 0.95::double)) m(model_identifier, threshold)
),
predictions as (select *, risk_score >= threshold as decision from scores),
lifecycle as (
  select run_id, TransactionID as transaction_id, sequence_number, cast(TransactionDT as double) as arrival_time, k % 10 as queue_position,
    TransactionDT + 0.5::double as processing_started_at, TransactionDT + 0.5::double + (k % 40) / 64.0::double as completed_at,
    case when k % 29 = 0 then 'FAILED' else 'COMPLETED' end as status, case when k % 29 = 0 then 'ValueError' end as error_code
  from based
),
alerts as (
  select p.run_id || ':' || p.transaction_id as alert_id, p.run_id, p.transaction_id, case when p.transaction_id % 7 = 0 then 'IN_REVIEW' else 'OPEN' end as status,
    max(risk_score) as highest_risk_score, count(*) filter (where decision) as model_agreement, count(*) as selected_model_count,
    max(amount) as suspicious_amount, any_value(TransactionDT) as created_at
  from predictions p join based b on b.TransactionID = p.transaction_id group by p.run_id, p.transaction_id having count(*) filter (where decision) > 0
),
actions as (
  select l_orderkey as transaction_id, alert_id, case l_linenumber when 1 then 'CONFIRMED_FRAUD' when 2 then 'MARKED_LEGITIMATE' when 3 then 'ESCALATED' when 4 then 'CLOSED' else 'NOTE_ADDED' end as action,
    'analyst-' || (l_suppkey % 5) as analyst_identifier, epoch_us(l_shipdate) // 1000000 as created_at,
    l_partkey * 100000000 + l_suppkey * 10000 + l_linenumber * 1000 + cast(l_quantity as int) as action_id
  from lineitem join alerts on transaction_id = l_orderkey
),
runs as (
  select *, cast(substr(run_id, 5) as int) as week, ['COMPLETED', 'STOPPED', 'FAILED', 'RUNNING'][cast(substr(run_id, 5) as int) % 4 + 1] as status,
    'client-' || (cast(substr(run_id, 5) as int) % 2) as client_id, 'realtime' as input_mode
  from (select run_id, count(*) as received_count, count(*) filter (where status = 'COMPLETED') as processed_count, count(*) filter (where status = 'FAILED') as failed_count,
    max(sequence_number) as current_sequence, max(completed_at) as created_at from lifecycle group by run_id)
),
past_transactions as (
  select run_id, sequence_number as ordinal, TransactionID as transaction_id, case when k % 31 <> 0 then cast(TransactionID as varchar) else '' end as raw_transaction_id,
    '{' || case when P_emaildomain is not null then '"P_emaildomain":"' || P_emaildomain || '",' else '' end || '"ProductCD":"' || ProductCD || '","TransactionAmt":' || TransactionAmt || ',"TransactionID":' || TransactionID || '}' as input_payload,
    case when k % 29 = 0 then 'FAILED' else 'COMPLETED' end as status, case when k % 29 = 0 then 'invalid_prediction_input' end as error_code, case when k % 29 = 0 then 'refused' end as error_message
  from based
),
past_predictions as (
  select run_id, sequence_number as ordinal, model_identifier, risk_score, threshold, decision, case when k % 4 = 0 then 'COMPLETED' else 'NOT_GENERATED' end as explanation_status,
    case when k % 4 = 0 then '[{"feature":"TransactionAmt"}]' end as top_contributed_features, case when k % 8 = 0 then 'amount' end as reasoning
  from predictions where k % 29 <> 0
),
contributions as (
  select transaction_id, model_identifier, decision, unnest(['numeric__uid_proxy_prior_count', 'card1_key_seconds_since_previous', 'numeric__device_key_prior_count', 'uid_proxy_amount_prior_mean',
      'uid_proxy_DeviceInfo_prior_nunique', 'TransactionAmt', 'card_address_key_amount_prior_std']) as feature,
    unnest([(k - 40) / 128.0::double, (k % 7 - 3) / 8.0::double, (sequence_number % 11 - 4) / 16.0::double, (sequence_number % 5 - 2) / 4.0::double, (k % 3) / 32.0::double, (k % 9 - 4) / 2.0::double, 0.0::double]) as contribution
  from predictions
)
"""
