"""Predictions, votes, alerts, analyst actions, runs and history exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.ordering import exact_quantiles
from riskspark.schema import MODEL_NAMES
from riskspark.session import single_row

# Analyst actions that set a status; NOTE_ADDED leaves it.
STATUS_BY_ACTION = {
    "CONFIRMED_FRAUD": "CONFIRMED_FRAUD",
    "MARKED_LEGITIMATE": "LEGITIMATE",
    "ESCALATED": "ESCALATED",
    "CLOSED": "CLOSED",
}
# Run status shown in the history.
HISTORY_STATUS = {"COMPLETED": "COMPLETED", "STOPPED": "PARTIAL", "FAILED": "FAILED"}
NOT_GENERATED = "Not generated"
PAGE_ROWS = 1000


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def apply_threshold(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each model's own threshold; a score equal to it is a decision."""
    # One row per model (eight at most).
    joined = scores.join(F.broadcast(thresholds.select("model_identifier", "threshold")), "model_identifier", "left")
    return joined.withColumn("decision", F.col("risk_score") >= F.col("threshold"))


def invalid_score(score: str = "risk_score") -> Column:
    """Missing, not finite or outside [0, 1]."""
    value = F.col(score)
    return value.isNull() | F.isnan(value) | (value < 0) | (value > 1)


def score_range_check(scores: DataFrame, score: str = "risk_score") -> DataFrame:
    """Rows scored and scores that are missing, not finite or outside [0, 1]."""
    return scores.agg(F.count(F.lit(1)).alias("rows"), F.count_if(invalid_score(score)).alias("invalid_scores"))


def _votes() -> dict[str, Column]:
    return {"fraud_vote_count": F.count_if("decision"), "selected_model_count": F.count(F.lit(1))}


def agreement_summary(predictions: DataFrame, key: list[str]) -> DataFrame:
    """Votes per transaction; a transaction has one prediction per selected model."""
    votes, models = F.col("fraud_vote_count"), F.col("selected_model_count")
    counted = predictions.groupBy(*key).agg(*[v.alias(n) for n, v in _votes().items()])
    return counted.withColumns({
        "unanimous": (votes == 0) | (votes == models),
        "agreement_label": F.when(votes == models, "all_flag_fraud").when(votes == 0, "all_flag_legitimate").otherwise("disagreement"),
    })


def predictions_wide(predictions: DataFrame, key: list[str], models: list[str]) -> DataFrame:
    """One row per transaction with score, threshold and decision per model name."""
    columns = []
    for identifier in models:
        name, mine = MODEL_NAMES[identifier], F.col("model_identifier") == identifier
        for source, suffix in (("risk_score", "score"), ("threshold", "threshold"), ("decision", "decision")):
            columns.append(F.max(F.when(mine, F.col(source))).alias(f"{name}_{suffix}"))
    return predictions.groupBy(*key).agg(*columns, F.count_if("decision").alias("fraud_vote_count"))


def predictions_long(wide: DataFrame, key: list[str], models: list[str]) -> DataFrame:
    """Inverse of ``predictions_wide``; models without a score are left out."""
    one = lambda m: F.struct(
        F.lit(m).alias("model_identifier"), F.col(f"`{MODEL_NAMES[m]}_score`").alias("risk_score"),
        F.col(f"`{MODEL_NAMES[m]}_threshold`").alias("threshold"), F.col(f"`{MODEL_NAMES[m]}_decision`").alias("decision"),
    )
    return wide.select(*key, F.explode(F.array(*[one(m) for m in models])).alias("p")).select(*key, "p.*").where("risk_score is not null")


def derive_alerts(predictions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One alert per transaction with at least one vote."""
    key = key or ["run_id", "transaction_id"]
    return predictions.groupBy(*key).agg(
        F.max("risk_score").alias("highest_risk_score"), F.count_if("decision").alias("model_agreement"),
        F.count(F.lit(1)).alias("selected_model_count"), F.max("amount").alias("suspicious_amount"),
    ).where("model_agreement > 0")


def batch_summary(predictions: DataFrame, refused: DataFrame, key: list[str]) -> DataFrame:
    """Totals of one scored batch; the per-model counts are a map of at most eight."""
    votes = agreement_summary(predictions.select(*key, "decision"), key).join(
        predictions.groupBy(*key).agg(F.max("amount").alias("amount")), key
    )
    rows = votes.agg(
        F.count(F.lit(1)).alias("valid_rows"), F.count_if("unanimous").alias("model_agreement_count"),
        F.round(F.coalesce(F.sum(F.when(F.col("fraud_vote_count") > 0, F.col("amount").cast("decimal(18,6)"))), F.lit(0)), 2)
        .cast("double").alias("suspicious_transaction_value"),
    )
    models = predictions.groupBy("model_identifier").agg(F.count_if("decision").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model_identifier", "n")))).alias("fraud_count_by_model")
    )
    invalid = refused.agg(F.count(F.lit(1)).alias("invalid_rows"))
    whole = rows.withColumns({"_m": single_row(models), "_i": single_row(invalid)}).select(*rows.columns, "_m.*", "_i.*")
    return whole.select(
        (F.col("valid_rows") + F.col("invalid_rows")).alias("total_rows"), "valid_rows", "invalid_rows",
        F.col("valid_rows").alias("processed_rows"), F.lit(0).cast("bigint").alias("failed_rows"), "fraud_count_by_model",
        "model_agreement_count", "suspicious_transaction_value",
    )


def alert_queue(alerts: DataFrame, *, status: str | None = None, transaction_id: int | None = None, limit: int = 100) -> DataFrame:
    """Highest risk first, older alerts first among equals."""
    if not 1 <= limit <= 500:
        raise ValueError("a page of alerts has 1 to 500 rows")
    if status:
        alerts = alerts.where(F.col("status") == status)
    if transaction_id is not None:
        alerts = alerts.where(F.col("transaction_id") == transaction_id)
    return alerts.orderBy(F.desc("highest_risk_score"), "created_at", "alert_id").limit(limit)


def alert_filter(
    alerts: DataFrame, *, search: str = "", minimum_risk: float = 0.0, minimum_votes: int = 0, version: str | None = None,
    model: str | None = None, newer_than: float | None = None,
) -> DataFrame:
    """The review filters: id text, risk, votes, version, model and age."""
    keep = F.col("transaction_id").cast("string").contains(search.strip())
    keep &= (F.col("highest_risk_score") >= minimum_risk) & (F.col("model_agreement") >= minimum_votes)
    if version:
        keep &= F.array_contains("selected_versions", version)
    if model:
        keep &= F.array_contains("selected_models", model)
    if newer_than is not None:
        keep &= F.col("created_at") >= newer_than
    return alerts.where(keep)


def search_by_id(rows: DataFrame, text: str, *, order: str, limit: int = 100) -> DataFrame:
    """First rows whose raw or parsed id contains the text."""
    ident = F.coalesce(F.col("raw_transaction_id"), F.col("transaction_id").cast("string"), F.lit(""))
    return rows.where(ident.contains(text.strip())).orderBy(order).limit(limit)


def apply_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Status after all actions: the latest one that maps to a status decides."""
    mapped = actions.withColumn("_status", lookup(STATUS_BY_ACTION, F.col("action")))
    when = F.struct("created_at", "action_id")
    state = mapped.groupBy("alert_id").agg(
        F.max_by(F.col("_status"), F.when(F.col("_status").isNotNull(), when)).alias("_latest"),
        F.max(F.when(F.col("_status").isNotNull(), F.col("created_at"))).alias("_changed"),
        F.count(F.lit(1)).alias("action_count"),
    )
    return alerts.join(state, "alert_id", "left").select(
        *[c for c in alerts.columns if c not in {"status", "updated_at"}],
        F.coalesce("_latest", "status").alias("status"), F.coalesce("_changed", "updated_at").alias("updated_at"),
        F.coalesce("action_count", F.lit(0)).alias("action_count"),
    )


def alert_detail(
    alerts: DataFrame, predictions: DataFrame, actions: DataFrame, events: DataFrame, payloads: DataFrame
) -> DataFrame:
    """Alert with predictions, latest action, lifecycle and stored payload.

    Predictions per alert are bounded by the eight models and nest; actions are not
    bounded, so the row carries their count and the latest one, and ``alert_action_log``
    lists them one per row.
    """
    key = ["run_id", "transaction_id"]
    nested = predictions.join(alerts.select(*key), key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "model_identifier", "risk_score", "threshold", "decision", "actual_label", "latency_ms"))).alias("predictions"))
    latest = actions.groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("action_count"), F.max_by(F.struct("action", "analyst_identifier", "created_at"), F.struct("created_at", "action_id")).alias("latest_action"))
    lifecycle = events.select(*key, "sequence_number", "arrival_time", "queue_position", "completed_at", F.col("status").alias("event_status"), "error_code")
    return (
        alerts.join(nested, key, "left").join(latest, "alert_id", "left").join(lifecycle, key, "left")
        .join(payloads, "transaction_id", "left").withColumn("action_count", F.coalesce("action_count", F.lit(0)))
    )


def alert_action_log(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Audit rows: every action of every alert in order, with the status before and after it."""
    order = Window.partitionBy("alert_id").orderBy("created_at", "action_id")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    mapped = actions.withColumn("_status", lookup(STATUS_BY_ACTION, F.col("action"))).withColumns({
        "position": F.row_number().over(order),
        "_before": F.last("_status", ignorenulls=True).over(before), "_after": F.last("_status", ignorenulls=True).over(upto),
    })
    first = alerts.select("alert_id", F.col("status").alias("_first"))
    return mapped.join(first, "alert_id").select(
        *actions.columns, "position", F.coalesce("_before", "_first").alias("status_before"), F.coalesce("_after", "_first").alias("status_after"))


def nested_runs(runs: DataFrame, transactions: DataFrame, predictions: DataFrame, *, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Run, page and the page's transactions in order, each with its predictions.

    A run may hold most of the table, so its transactions come in pages of bounded size.
    """
    key = ["run_id", "ordinal"]
    nested = predictions.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("model_identifier", "risk_score", "threshold", "decision"))).alias("predictions"))
    rows = transactions.join(nested, key, "left").withColumn("page", F.floor(F.col("ordinal") / page_rows))
    pages = rows.groupBy("run_id", "page").agg(F.sort_array(F.collect_list(F.struct(
        "ordinal", "transaction_id", "raw_transaction_id", "status", "error_code",
        F.coalesce("predictions", F.array()).alias("predictions")))).alias("transactions"))
    return runs.join(pages, "run_id", "left")


def export_history(runs: DataFrame, transactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Flat history: one row per prediction, or one per transaction without any."""
    rows = transactions.join(runs.select("run_id", "input_mode", "created_at"), "run_id").join(
        predictions, ["run_id", "ordinal"], "left")
    done = F.coalesce(F.col("explanation_status") == "COMPLETED", F.lit(False))
    return rows.select(
        F.col("run_id").alias("analysis_run_id"), F.col("input_mode").alias("analysis_mode"), F.col("created_at").alias("analysed_at"),
        F.coalesce(F.nullif("raw_transaction_id", F.lit("")), F.col("transaction_id").cast("string"), F.lit("")).alias("transaction_id"),
        F.col("input_payload").alias("input_columns"), F.coalesce("model_identifier", F.lit("")).alias("model_identifier"),
        F.when(F.col("decision"), "Fraud").when(~F.col("decision"), "Legitimate").otherwise("").alias("predicted_output"),
        "risk_score", "threshold",
        F.when(done, F.col("top_contributed_features")).otherwise(NOT_GENERATED).alias("top_contributed_features"),
        F.when(done, F.coalesce("reasoning", F.lit("No behavioral reasoning available"))).otherwise(NOT_GENERATED).alias("reasoning"),
        F.coalesce("explanation_status", F.lit("NOT_GENERATED")).alias("explanation_status"),
        F.col("status").alias("transaction_status"), F.coalesce("error_code", F.lit("")).alias("error_code"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


def union_outcomes(completed: DataFrame, refused: DataFrame) -> DataFrame:
    """Completed and refused rows of a batch with their file positions."""
    failed = refused.select(
        (F.col("row_number") - 2).alias("ordinal"), F.col("transaction_id").alias("raw_transaction_id"), F.lit("FAILED").alias("status"),
        "error_code", F.col("message").alias("error_message"))
    return completed.unionByName(failed, allowMissingColumns=True)


def stream_metrics(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counters, throughput and latency of each run, with the nearest-rank percentile."""
    latency = (F.col("completed_at") - F.col("processing_started_at")) * 1000
    timed = events.withColumn("latency_ms", latency)
    base = timed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("status") == "COMPLETED").alias("processed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"), F.round(F.avg("latency_ms"), 3).alias("average_latency_ms"),
        F.round(F.try_divide(F.count_if(F.col("status") == "COMPLETED"), F.max("completed_at") - F.min("arrival_time")), 9).alias("throughput"),
    )
    p95 = exact_quantiles(timed, ["latency_ms"], 0.95, by=["run_id"], discrete=True).select("run_id", F.round("quantile", 3).alias("p95_latency_ms"))
    raised = alerts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("fraud_alerts"), F.round(F.sum(F.col("suspicious_amount").cast("decimal(18,6)")), 2).cast("double").alias("suspicious_value"))
    return base.join(p95, "run_id", "left").join(raised, "run_id", "left").withColumns({
        "fraud_alerts": F.coalesce("fraud_alerts", F.lit(0)), "suspicious_value": F.coalesce("suspicious_value", F.lit(0.0))})


def run_rollup(runs: DataFrame) -> DataFrame:
    """History status and counters of a stream run."""
    done = F.col("processed_count") + F.col("failed_count")
    return runs.select(
        "run_id", F.coalesce(lookup(HISTORY_STATUS, F.col("status")), F.lit("PROCESSING")).alias("status"),
        F.greatest("received_count", done).alias("total_transactions"), F.col("processed_count").alias("successful_transactions"),
        F.col("failed_count").alias("failed_transactions"),
    )


def recent_runs(runs: DataFrame, *, client_id: str, mode: str, limit: int, offset: int) -> DataFrame:
    mine = runs.where((F.col("client_id") == client_id) & (F.col("input_mode") == mode))
    return mine.orderBy(F.desc("created_at"), "run_id").offset(offset).limit(limit)


def overview_kpis(runs: DataFrame, alerts: DataFrame, models: DataFrame) -> DataFrame:
    """Alert rate, suspicious sum and the champion with the best validation score."""
    processed = runs.agg(F.sum("processed_count").alias("transactions_processed"))
    raised = alerts.agg(F.count(F.lit(1)).alias("fraud_alerts"), F.round(F.sum(F.col("suspicious_amount").cast("decimal(18,6)")), 2).cast("double").alias("suspicious_value"))
    best = models.where("champion").agg(F.max_by("model_identifier", "validation_pr_auc").alias("best_champion"))
    whole = processed.withColumns({"_r": single_row(raised), "_b": single_row(best)}).select("transactions_processed", "_r.*", "_b.*")
    return whole.select(
        "transactions_processed", "fraud_alerts", F.coalesce(F.try_divide("fraud_alerts", "transactions_processed"), F.lit(0.0)).alias("alert_rate"),
        "suspicious_value", "best_champion")
