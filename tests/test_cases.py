from pyspark.sql import functions as F

from riskspark.operators import cases, contributions, joins
from tests.conftest import rows

PREDICTIONS = "run_id string, transaction_id long, model_identifier string, risk_score double, threshold double, decision boolean, amount double"


def test_one_record_gives_one_alert(spark):
    df = spark.createDataFrame([("r", 1, "catboost.v2", 0.9, 0.4, True, 50.0), ("r", 2, "catboost.v2", 0.1, 0.4, False, 9.0)], PREDICTIONS)
    assert rows(cases.derive_alerts(df)) == [{
        "run_id": "r", "transaction_id": 1, "highest_risk_score": 0.9, "model_agreement": 1, "selected_model_count": 1, "suspicious_amount": 50.0}]


def test_threshold_is_inclusive(spark):
    scores = spark.createDataFrame([(1, "m", 0.39), (2, "m", 0.4)], "id int, model_identifier string, risk_score double")
    cuts = spark.createDataFrame([("m", 0.4)], "model_identifier string, threshold double")
    assert [r["decision"] for r in rows(cases.apply_threshold(scores, cuts), "id")] == [False, True]


def test_agreement_labels(spark):
    data = [("r", i, m, 0.5, 0.5, d, 1.0) for i, votes in ((1, (True, True)), (2, (False, False)), (3, (True, False))) for m, d in zip(("catboost.v2", "lightgbm.v1"), votes)]
    df = spark.createDataFrame(data, PREDICTIONS)
    assert [r["agreement_label"] for r in rows(cases.agreement_summary(df, ["transaction_id"]), "transaction_id")] == ["all_flag_fraud", "all_flag_legitimate", "disagreement"]
    wide = cases.predictions_wide(df, ["transaction_id"], ["catboost.v2", "lightgbm.v1"])
    long = cases.predictions_long(wide, ["transaction_id"], ["catboost.v2", "lightgbm.v1"])
    assert long.exceptAll(df.select(*long.columns)).isEmpty() and long.count() == 6


def test_actions(spark):
    alerts = spark.createDataFrame([("a", "OPEN", 0), ("b", "OPEN", 0), ("c", "OPEN", 0)], "alert_id string, status string, updated_at long")
    log = spark.createDataFrame([("a", "ESCALATED", 1, 1), ("a", "MARKED_LEGITIMATE", 2, 2), ("a", "NOTE_ADDED", 3, 3), ("b", "NOTE_ADDED", 1, 4)],
                                "alert_id string, action string, created_at long, action_id long")
    found = rows(cases.apply_actions(alerts, log), "alert_id")
    assert [(r["status"], r["updated_at"], r["action_count"]) for r in found] == [("LEGITIMATE", 2, 3), ("OPEN", 0, 1), ("OPEN", 0, 0)]


def test_history_export_defaults(spark):
    runs = spark.createDataFrame([("r", "single", 1.0)], "run_id string, input_mode string, created_at double")
    tx = spark.createDataFrame([("r", 0, 100, "100", '{"TransactionAmt":25}', "COMPLETED", None, None), ("r", 1, None, "", "{}", "FAILED", "bad", "text")],
                               "run_id string, ordinal long, transaction_id long, raw_transaction_id string, input_payload string, status string, error_code string, error_message string")
    predictions = spark.createDataFrame([("r", 0, "catboost.v2", 0.91, 0.4, True, "NOT_GENERATED", None, None)],
                                        "run_id string, ordinal long, model_identifier string, risk_score double, threshold double, decision boolean, explanation_status string, top_contributed_features string, reasoning string")
    done, failed = rows(cases.export_history(runs, tx, predictions), "transaction_status")
    assert done["predicted_output"] == "Fraud" and done["reasoning"] == done["top_contributed_features"] == "Not generated" and done["input_columns"] == '{"TransactionAmt":25}'
    assert failed["model_identifier"] == failed["predicted_output"] == failed["transaction_id"] == "" and failed["risk_score"] is None


CONTRIBUTIONS = "transaction_id int, model_identifier string, decision boolean, feature string, contribution double"


def explain(spark, data):
    key = ["transaction_id", "model_identifier"]
    ranked = contributions.rank_contributions(spark.createDataFrame(data, CONTRIBUTIONS), key)
    return {r["transaction_id"]: r["reasoning"] for r in rows(contributions.reasons(ranked, key))}


def test_reasons(spark):
    found = explain(spark, [
        (1, "m", True, "numeric__device_key_prior_count", 0.4), (2, "m", False, "numeric__device_key_prior_count", 0.4),
        (3, "m", True, "TransactionAmt", 0.9), (3, "m", True, "card1_key_prior_count", -0.5),
        (4, "m", True, "uid_proxy_amount_prior_mean", 0.2), (4, "m", True, "uid_proxy_prior_count", 0.5), (4, "m", True, "device_key_prior_count", 0.4),
        (4, "m", True, "uid_proxy_seconds_since_previous", 0.1),
    ])
    assert found[1] == "It is flagged as fraud because previous transaction frequency increased the model's fraud score."
    assert found[2] is None and found[3] is None
    assert found[4] == "It is flagged as fraud because previous transaction frequency and historical average transaction amount increased the model's fraud score."


def test_labels_held_apart(spark):
    data = spark.createDataFrame([(7, 1.0)], "id long, x double")
    labelled = joins.join_ground_truth(data, spark.createDataFrame([(7, 1)], "id long, is_fraud int"), "id")
    assert rows(labelled)[0]["actual_label"] is True
    none = joins.join_ground_truth(data, spark.createDataFrame([], "id long, is_fraud int"), "id")
    assert rows(joins.ground_truth_gaps(none)) == [{"rows": 1, "missing_labels": 1}]


def test_nested_pages(spark):
    runs = spark.createDataFrame([("r",)], "run_id string")
    tx = spark.range(5).select(F.lit("r").alias("run_id"), F.col("id").alias("ordinal"), F.col("id").alias("transaction_id"), F.col("id").cast("string").alias("raw_transaction_id"),
                               F.lit("COMPLETED").alias("status"), F.lit(None).cast("string").alias("error_code"))
    predictions = spark.createDataFrame([("r", 1, "m", 0.5, 0.5, True)], "run_id string, ordinal long, model_identifier string, risk_score double, threshold double, decision boolean")
    pages = rows(cases.nested_runs(runs, tx, predictions, page_rows=2), "page")
    assert [[t["ordinal"] for t in p["transactions"]] for p in pages] == [[0, 1], [2, 3], [4]]
    assert pages[0]["transactions"][0]["predictions"] == [] and pages[0]["transactions"][1]["predictions"][0]["model_identifier"] == "m"
