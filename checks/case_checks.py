"""Predictions, alerts, actions, runs, history and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded, r, txn_sql
from riskspark.operators import cases, contract, contributions
from riskspark.sources import demo_cases as demo
from riskspark.session import write_through

KEY = ["run_id", "transaction_id"]
MODELS = list(demo.THRESHOLDS)


def case_sql(select, *ctes):
    return txn_sql(select, demo.CASES_SQL, *ctes)


@query("apply_threshold", case_sql("select transaction_id, model_identifier, risk_score, threshold, decision from predictions"))
def _threshold(spark, sf_dir):
    return cases.apply_threshold(demo.scores(spark, sf_dir), demo.thresholds(spark)).select("transaction_id", "model_identifier", "risk_score", "threshold", "decision")


@query("score_range_check", case_sql("select count(*) as rows, count(*) filter (where k = 77 or k = 78) as invalid_scores from scores"))
def _range(spark, sf_dir):
    spoiled = F.when(F.col("k") == 77, F.lit(float("nan"))).when(F.col("k") == 78, F.col("risk_score") + 1.5).otherwise(F.col("risk_score"))
    return cases.score_range_check(demo.scores(spark, sf_dir).withColumn("risk_score", spoiled))


VOTES = "votes as (select run_id, transaction_id, count(*) filter (where decision) as v, count(*) as n, max(amount) as amount from predictions group by all)"


@query("agreement_summary", case_sql("""
select run_id, transaction_id, v as fraud_vote_count, n as selected_model_count, v = 0 or v = n as unanimous,
  case when v = n then 'all_flag_fraud' when v = 0 then 'all_flag_legitimate' else 'disagreement' end as agreement_label from votes""", VOTES))
def _agreement(spark, sf_dir):
    return cases.agreement_summary(demo.predictions(spark, sf_dir), KEY)


WIDE_SQL = "select transaction_id, " + ", ".join(
    f"max({source}) filter (where model_identifier = '{m}') as \"{cases.MODEL_NAMES[m]}_{suffix}\""
    for m in MODELS for source, suffix in (("risk_score", "score"), ("threshold", "threshold"), ("decision", "decision"))
) + ", count(*) filter (where decision) as fraud_vote_count from predictions group by transaction_id"


@query("predictions_wide", case_sql(WIDE_SQL))
def _wide(spark, sf_dir):
    return cases.predictions_wide(demo.predictions(spark, sf_dir), ["transaction_id"], MODELS)


@query("predictions_long", case_sql("select transaction_id, model_identifier, risk_score, threshold, decision from predictions"))
def _long(spark, sf_dir):
    wide = cases.predictions_wide(demo.predictions(spark, sf_dir), ["transaction_id"], MODELS)
    return cases.predictions_long(wide, ["transaction_id"], MODELS)


@query("derive_alerts", case_sql("select run_id, transaction_id, highest_risk_score, model_agreement, selected_model_count, suspicious_amount from alerts"))
def _alerts(spark, sf_dir):
    return cases.derive_alerts(demo.predictions(spark, sf_dir))


@query("batch_summary", case_sql("""
select valid_rows + invalid_rows as total_rows, valid_rows, invalid_rows, valid_rows as processed_rows, cast(0 as bigint) as failed_rows,
  model_agreement_count, suspicious_transaction_value, fraud_count_by_model from
  (select count(*) as valid_rows, count(*) filter (where v = 0 or v = n) as model_agreement_count, cast(round(sum(cast(amount as decimal(18,6))) filter (where v > 0), 2) as double) as suspicious_transaction_value from votes),
  (select count(*) as invalid_rows from lifecycle where status = 'FAILED'),
  (select string_agg(model_identifier || '=' || n, ';' order by model_identifier) as fraud_count_by_model from (select model_identifier, count(*) filter (where decision) as n from predictions group by 1))""", VOTES))
def _batch(spark, sf_dir):
    summary = cases.batch_summary(demo.predictions(spark, sf_dir), demo.events(spark, sf_dir).where("status = 'FAILED'"), KEY)
    shown = F.array_join(F.transform(F.map_entries("fraud_count_by_model"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return summary.withColumn("fraud_count_by_model", shown)


QUEUE = ["alert_id", "run_id", "transaction_id", "status", "highest_risk_score", "model_agreement", "suspicious_amount", "created_at"]


@query("alert_queue", case_sql(f"select {', '.join(QUEUE)} from alerts where status = 'OPEN' order by highest_risk_score desc, created_at, alert_id limit 100"))
def _queue(spark, sf_dir):
    return cases.alert_queue(demo.alerts(spark, sf_dir), status="OPEN").select(*QUEUE)


@query("alert_filter", case_sql(f"select {', '.join(QUEUE)} from alerts where contains(cast(transaction_id as varchar), '7') and highest_risk_score >= 0.96 and model_agreement >= 2 and created_at >= 900000"))
def _filter(spark, sf_dir):
    return cases.alert_filter(demo.alerts(spark, sf_dir), search=" 7 ", minimum_risk=0.96, minimum_votes=2, version="V1", model="catboost.v2", newer_than=900_000).select(*QUEUE)


@query("search_by_id", case_sql("select ordinal, transaction_id, raw_transaction_id from past_transactions where contains(raw_transaction_id, '99') order by ordinal limit 100"))
def _search(spark, sf_dir):
    return cases.search_by_id(demo.history_transactions(spark, sf_dir), "99", order="ordinal").select("ordinal", "transaction_id", "raw_transaction_id")


@query("alert_apply_actions", case_sql("""
select a.alert_id, a.transaction_id, coalesce(m.status, a.status) as status, coalesce(m.changed, a.created_at) as updated_at, coalesce(n, 0) as action_count from alerts a
left join (select alert_id, arg_max(case action when 'MARKED_LEGITIMATE' then 'LEGITIMATE' else action end, (created_at, action_id)) as status, max(created_at) as changed
  from actions where action <> 'NOTE_ADDED' group by 1) m using (alert_id)
left join (select alert_id, count(*) as n from actions group by 1) c using (alert_id)"""))
def _actions(spark, sf_dir):
    done = cases.apply_actions(demo.alerts(spark, sf_dir), demo.actions(spark, sf_dir))
    return done.select("alert_id", "transaction_id", "status", "updated_at", "action_count")


@query("alert_action_log", case_sql("""
select c.alert_id, c.action, c.analyst_identifier, c.created_at, c.action_id,
  cast(row_number() over w as int) as position,
  coalesce(last_value(c.status ignore nulls) over (w rows between unbounded preceding and 1 preceding), a.status) as status_before,
  coalesce(last_value(c.status ignore nulls) over (w rows between unbounded preceding and current row), a.status) as status_after
from (select *, case action when 'MARKED_LEGITIMATE' then 'LEGITIMATE' when 'NOTE_ADDED' then null else action end as status from actions) c join alerts a using (alert_id)
window w as (partition by c.alert_id order by c.created_at, c.action_id)"""))
def _action_log(spark, sf_dir):
    found = cases.alert_action_log(demo.alerts(spark, sf_dir), demo.actions(spark, sf_dir))
    return found.select("alert_id", "action", "analyst_identifier", "created_at", "action_id", "position", "status_before", "status_after")


def listed(array, *parts):
    """A nested list as one text, the same in both engines."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[p(x).cast("string") for p in parts])), ";")


@query("join_alert_detail", case_sql("""
select a.alert_id, a.transaction_id, p.predictions, coalesce(c.n, 0) as action_count, c.latest_action, e.arrival_time, e.status as event_status, e.error_code, t.payload_product from alerts a
left join (select run_id, transaction_id, string_agg(model_identifier || ':' || decision || ':' || actual_label || ':' || cast(floor(latency_ms) as bigint), ';' order by model_identifier) as predictions from predictions group by all) p using (run_id, transaction_id)
left join (select alert_id, count(*) as n, arg_max(action || ' by ' || analyst_identifier, (created_at, action_id)) as latest_action from actions group by 1) c using (alert_id)
left join lifecycle e using (run_id, transaction_id) left join (select TransactionID, ProductCD as payload_product from txn) t on t.TransactionID = a.transaction_id"""))
def _detail(spark, sf_dir):
    payloads = demo.history_transactions(spark, sf_dir).select("transaction_id", "input_payload")
    stored = write_through(demo.alerts(spark, sf_dir), "alerts")  # a stored table, read in several places
    detail = cases.alert_detail(stored, demo.predictions(spark, sf_dir), demo.actions(spark, sf_dir), demo.events(spark, sf_dir), payloads)
    shown = listed("predictions", lambda x: x["model_identifier"], lambda x: x["decision"], lambda x: x["actual_label"], lambda x: F.floor(x["latency_ms"]))
    latest = F.concat(F.col("latest_action.action"), F.lit(" by "), F.col("latest_action.analyst_identifier"))
    return detail.select("alert_id", "transaction_id", shown.alias("predictions"), "action_count", latest.alias("latest_action"), "arrival_time",
                         "event_status", "error_code", F.get_json_object("input_payload", "$.ProductCD").alias("payload_product"))


@query("join_run_nested", case_sql("""
select run_id, ordinal // 250 as page, count(*) as transactions, min(ordinal) as first_ordinal, string_agg(ordinal || '=' || coalesce(p.predictions, ''), ';' order by ordinal) as nested
from past_transactions left join (select run_id, ordinal, string_agg(model_identifier || '/' || decision, ',' order by model_identifier) as predictions from past_predictions group by all) p using (run_id, ordinal) group by all"""))
def _nested(spark, sf_dir):
    rows = cases.nested_runs(demo.runs(spark, sf_dir), demo.history_transactions(spark, sf_dir), demo.history_predictions(spark, sf_dir), page_rows=250)
    inner = lambda t: F.array_join(F.transform(t["predictions"], lambda p: F.concat_ws("/", p["model_identifier"], p["decision"].cast("string"))), ",")
    nested = F.array_join(F.transform("transactions", lambda t: F.concat(t["ordinal"].cast("string"), F.lit("="), inner(t))), ";")
    return rows.select("run_id", "page", F.size("transactions").cast("bigint").alias("transactions"), F.col("transactions")[0]["ordinal"].alias("first_ordinal"), nested.alias("nested"))


@query("export_history_flat", case_sql("""
select t.run_id as analysis_run_id, input_mode as analysis_mode, u.created_at as analysed_at, coalesce(nullif(raw_transaction_id, ''), cast(transaction_id as varchar)) as transaction_id,
  input_payload as input_columns, coalesce(model_identifier, '') as model_identifier, case when decision then 'Fraud' when not decision then 'Legitimate' else '' end as predicted_output, risk_score, threshold,
  case when explanation_status = 'COMPLETED' then top_contributed_features else 'Not generated' end as top_contributed_features,
  case when explanation_status = 'COMPLETED' then coalesce(reasoning, 'No behavioral reasoning available') else 'Not generated' end as reasoning,
  coalesce(explanation_status, 'NOT_GENERATED') as explanation_status, t.status as transaction_status, coalesce(error_code, '') as error_code, coalesce(error_message, '') as error_message
from past_transactions t join runs u using (run_id) left join past_predictions p on p.run_id = t.run_id and p.ordinal = t.ordinal"""))
def _export(spark, sf_dir):
    return cases.export_history(demo.runs(spark, sf_dir), demo.history_transactions(spark, sf_dir), demo.history_predictions(spark, sf_dir))


@query("union_batch_outcomes", case_sql("""
select ordinal, raw_transaction_id, status, error_code, error_message, case when status = 'COMPLETED' then transaction_id end as transaction_id from past_transactions"""))
def _outcomes(spark, sf_dir):
    rows = demo.history_transactions(spark, sf_dir)
    completed = rows.where("status = 'COMPLETED'").select("ordinal", "transaction_id", "raw_transaction_id", "status")
    refused = rows.where("status = 'FAILED'").select((F.col("ordinal") + 2).alias("row_number"), F.col("raw_transaction_id").alias("transaction_id"), "error_code", F.col("error_message").alias("message"))
    return cases.union_outcomes(completed, refused)


@query("stream_metrics", case_sql("""
select run_id, received, processed, failed, average_latency_ms, throughput, p95_latency_ms, coalesce(fraud_alerts, 0) as fraud_alerts, coalesce(suspicious_value, 0) as suspicious_value from (
  select run_id, count(*) as received, count(*) filter (where status = 'COMPLETED') as processed, count(*) filter (where status = 'FAILED') as failed,
    round(avg((completed_at - processing_started_at) * 1000), 3) as average_latency_ms, round(count(*) filter (where status = 'COMPLETED') / (max(completed_at) - min(arrival_time)), 9) as throughput,
    round(quantile_disc((completed_at - processing_started_at) * 1000, 0.95), 3) as p95_latency_ms from lifecycle group by run_id)
left join (select run_id, count(*) as fraud_alerts, cast(round(sum(cast(suspicious_amount as decimal(18,6))), 2) as double) as suspicious_value from alerts group by 1) using (run_id)"""))
def _metrics(spark, sf_dir):
    return cases.stream_metrics(demo.events(spark, sf_dir), demo.alerts(spark, sf_dir))


@query("run_rollup", case_sql("""
select run_id, case status when 'COMPLETED' then 'COMPLETED' when 'STOPPED' then 'PARTIAL' when 'FAILED' then 'FAILED' else 'PROCESSING' end as status,
  greatest(received_count, processed_count + failed_count) as total_transactions, processed_count as successful_transactions, failed_count as failed_transactions from runs"""))
def _rollup(spark, sf_dir):
    return cases.run_rollup(demo.runs(spark, sf_dir))


@query("recent_runs", case_sql("select run_id, client_id, status, created_at from runs where client_id = 'client-1' and input_mode = 'realtime' order by created_at desc limit 2 offset 1"))
def _recent(spark, sf_dir):
    return cases.recent_runs(demo.runs(spark, sf_dir), client_id="client-1", mode="realtime", limit=2, offset=1).select("run_id", "client_id", "status", "created_at")


@query("overview_kpis", case_sql(f"""
select transactions_processed, fraud_alerts, {r('fraud_alerts / transactions_processed', 'alert_rate')}, suspicious_value, best_champion from
  (select cast(sum(processed_count) as bigint) as transactions_processed from runs), (select count(*) as fraud_alerts, cast(round(sum(cast(suspicious_amount as decimal(18,6))), 2) as double) as suspicious_value from alerts),
  (select arg_max(model_identifier, (s, model_identifier)) as best_champion from (select model_identifier, round(avg(risk_score), 9) as s from predictions where actual_label group by 1))"""))
def _kpis(spark, sf_dir):
    models = demo.predictions(spark, sf_dir).where("actual_label").groupBy("model_identifier").agg(F.round(F.avg("risk_score"), 9).alias("validation_pr_auc")).withColumn("champion", F.lit(True))
    return cases.overview_kpis(demo.runs(spark, sf_dir), demo.alerts(spark, sf_dir), models).withColumn("alert_rate", rounded(F.col("alert_rate")))


AUDITS = {"runs": contract.RUN_RULES, "events": contract.EVENT_RULES, "predictions": contract.PREDICTION_RULES, "alerts": contract.ALERT_RULES}


def audit_sql():
    duck = lambda p: p.replace("size(", "len(").replace("array_except(selected_versions, array(", "list_filter(selected_versions, lambda x: x not in (").replace(
        "array_except(selected_models, array(", "list_filter(selected_models, lambda x: x not in (")
    source = {"runs": "run_rows", "events": "lifecycle", "predictions": "predictions", "alerts": "alerts"}
    return case_sql(" union all ".join(
        f"select '{t}' as table_name, '{n}' as rule, count(*) filter (where not ({duck(p)})) as violations from {source[t]}" for t, rules in AUDITS.items() for n, p in rules.items()),
        """run_rows as (select *, case when week = 3 then 4 else 2 end as transactions_per_second, 0 as fraud_count, ['logistic_regression.v1', 'lightgbm.v1', 'catboost.v2'] as selected_models,
          case when week = 2 then ['V3'] else ['V1', 'V2'] end as selected_versions from runs)""")


@query("constraint_audit", audit_sql())
def _audit(spark, sf_dir):
    tables = {"runs": demo.runs(spark, sf_dir), "events": demo.events(spark, sf_dir), "predictions": demo.predictions(spark, sf_dir), "alerts": demo.alerts(spark, sf_dir)}
    rows = None
    for name, rules in AUDITS.items():
        one = contract.constraint_audit(tables[name], rules).select(F.lit(name).alias("table_name"), "rule", "violations")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("constraint_keys", case_sql("""
select 'history' as table_name, 'status_known' as rule, 0::bigint as violations
union all select 'history', 'one_to_eight_models', count(*) from runs where week * 3 not between 1 and 8
union all select 'history', 'counters_add_up', count(*) from runs where processed_count + failed_count > greatest(received_count, processed_count + failed_count)
union all select 'events', 'unique run_id, sequence_number', count(*) from lifecycle where sequence_number % 50 = 0
union all select 'predictions', 'unique transaction_id, model_identifier', (select count(*) from (select 1 from predictions group by transaction_id, model_identifier having count(*) > 1))
union all select 'alerts', 'transaction_id in done', count(*) from alerts where transaction_id not in (select transaction_id from lifecycle where status = 'COMPLETED')
union all select 'predictions', 'transaction_id in events', count(*) from predictions where transaction_id not in (select transaction_id from lifecycle)"""))
def _keys(spark, sf_dir):
    """History rules, unique keys and parent rows; every fiftieth event arrives twice, and failed events are no parents."""
    runs, events = demo.runs(spark, sf_dir), demo.events(spark, sf_dir)
    week = F.substring("run_id", 5, 10).cast("int")
    history = cases.run_rollup(runs).withColumn("selected_models", F.filter(F.sequence(F.lit(1), week * 3 + 1), lambda n: n <= week * 3))
    rules = contract.constraint_audit(history, contract.HISTORY_RULES).select(F.lit("history").alias("table_name"), "rule", "violations")
    tables = {
        "events": events.unionByName(events.where("sequence_number % 50 = 0")), "predictions": demo.predictions(spark, sf_dir),
        "alerts": demo.alerts(spark, sf_dir), "done": events.where("status = 'COMPLETED'"),
    }
    unique = {"events": ["run_id", "sequence_number"], "predictions": ["transaction_id", "model_identifier"]}
    parents = [("alerts", "done", ["transaction_id"]), ("predictions", "events", ["transaction_id"])]
    return rules.unionByName(contract.key_audit(tables, unique, parents))


RANKED = """ranked as (select *, row_number() over (partition by transaction_id, model_identifier order by abs(contribution) desc, feature) as rank from contributions)"""


@query("rank_contributions", case_sql("""
select transaction_id, model_identifier, feature, contribution, rank, case when contribution >= 0 then 'toward_fraud' else 'toward_not_fraud' end as direction from ranked where rank <= 5""", RANKED))
def _rank(spark, sf_dir):
    ranked = contributions.rank_contributions(demo.contributions(spark, sf_dir), ["transaction_id", "model_identifier"])
    return ranked.select("transaction_id", "model_identifier", "feature", "contribution", F.col("rank").cast("bigint").alias("rank"), "direction")


LABELLED = """labelled as (select *, case when feature like '%seconds_since_previous%' then 'time since the previous related transaction' when feature like '%prior_mean%' then 'historical average transaction amount'
  when feature like '%prior_std%' then 'historical transaction amount variability'
  when feature like '%prior_count%' then 'previous transaction frequency' end as label from ranked where rank <= 5),
named as (select transaction_id, model_identifier, label, min(rank) as rank from labelled where decision and contribution > 1e-12 and label is not null group by all),
worded as (select transaction_id, model_identifier, string_agg(label, ' and ' order by rank) as words from (select *, row_number() over (partition by transaction_id, model_identifier order by rank) as n from named) where n <= 2 group by all)"""


@query("explain_reason", case_sql("""
select p.transaction_id, p.model_identifier, 'It is flagged as fraud because ' || words || ' increased the model''s fraud score.' as reasoning, case when words is not null then 'template' end as reasoning_source
from predictions p left join worded using (transaction_id, model_identifier)""", RANKED, LABELLED))
def _reason(spark, sf_dir):
    key = ["transaction_id", "model_identifier"]
    return contributions.reasons(contributions.rank_contributions(demo.contributions(spark, sf_dir), key), key)
