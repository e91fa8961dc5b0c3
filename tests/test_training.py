import pytest
from pyspark.sql import functions as F

from riskspark.operators import joins
from riskspark.plans import scoring, training
from tests.conftest import rows

GROUPS = {"numeric": ["TransactionAmt"], "low_cardinality": ["ProductCD"], "high_cardinality": ["card1"]}


@pytest.fixture(scope="module")
def data(spark):
    base = spark.range(1, 401).select(
        F.col("id").alias("TransactionID"), F.col("id").alias("TransactionDT"), (F.col("id") % 37).cast("double").alias("TransactionAmt"),
        F.when(F.col("id") % 3 == 0, "W").otherwise("C").alias("ProductCD"), (F.col("id") % 150).alias("card1"))
    return base.withColumn("isFraud", (F.col("TransactionAmt") > 30).cast("int")).cache()


def test_models_learn_and_reload(spark, data, tmp_path):
    valid = data.where("TransactionID > 300")
    fitted = {
        "logistic_regression.v2": training.train_logistic(data, groups=GROUPS),
        "lightgbm.v2": training.train_boosted(data.where("TransactionID <= 300"), valid, groups=GROUPS, max_iter=3, min_rows=2),
        "neural_network.v2": training.train_network(data, groups=GROUPS, hidden=(4,), max_iter=30),
    }
    for name, model in fitted.items():
        assert training.average_precision(model.score(valid)) > 0.5, name
        training.save_model(model, f"{tmp_path}/{name}")
        again = training.load_model(spark, f"{tmp_path}/{name}")
        parity = rows(joins.score_parity(training.scores_of(again, valid), training.scores_of(model, valid)))[0]
        assert parity["scores_match"] and parity["labels_match"] and parity["rows_compared"] == 100
    long = scoring.score_models(valid, fitted)
    assert long.count() == 300 and long.where("risk_score < 0 or risk_score > 1").isEmpty()
    top = rows(training.feature_importance(fitted["logistic_regression.v2"]))[0]
    assert top["absolute_value"] == abs(top["value"])


class Linear:
    """Stand-in for a trained model: one hundredth of the amount."""

    def score(self, df):
        return df.withColumn("probability", F.coalesce(F.col("TransactionAmt"), F.lit(0.0)) / 100)


def test_ablation(spark):
    df = spark.createDataFrame([(1, 25.0, None), (2, 50.0, "x")], "TransactionID long, TransactionAmt double, note string")
    found = rows(scoring.explain_ablation(df, Linear(), ["TransactionAmt", "note"]), "TransactionID", "rank")
    assert [(r["TransactionID"], r["feature"], r["contribution"], r["direction"]) for r in found] == [
        (1, "TransactionAmt", 0.25, "toward_fraud"), (2, "TransactionAmt", 0.5, "toward_fraud"), (2, "note", 0.0, "toward_fraud")]


def test_model_selection_rules(data):
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            scoring.require_unique_models(bad)
    with pytest.raises(ValueError):
        training.fit_state(data, {"numeric": ["isFraud"], "low_cardinality": [], "high_cardinality": []})
