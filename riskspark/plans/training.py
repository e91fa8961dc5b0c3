"""MLlib training on encoded rows: linear, boosted trees and a small network."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel,
    MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import encoders, evaluation
from riskspark.operators.contract import assert_protected
from riskspark.operators.profiling import infer_feature_groups, positive_weight
from riskspark.schema import ID, LABEL

# Training parameters and the small search grid of the boosted model.
LOGISTIC_C = 0.1
LOGISTIC_ITERATIONS = 800
BOOSTED_CANDIDATES = [
    {"name": "balanced_64", "weight_mode": "balanced", "max_depth": 6, "min_rows": 50},
    {"name": "sqrt_96", "weight_mode": "sqrt_balanced", "max_depth": 7, "min_rows": 100},
    {"name": "unweighted_48", "weight_mode": "none", "max_depth": 5, "min_rows": 100},
]
NETWORK_WEIGHT_MODES = ["sqrt_balanced", "balanced"]
SEED = 42


@dataclass
class FittedModel:
    """Encoder state with the model trained on it; ``score`` adds ``probability``."""

    identifier: str
    state: dict
    model: Model
    features: list[str] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        vectors, _ = assembled(df, self.state)
        probability = vector_to_array("_probability")[1]
        scored = self.model.transform(vectors).withColumn("probability", probability)
        return scored.select(*df.columns, "probability")


def assembled(df: DataFrame, state: dict) -> tuple[DataFrame, list[str]]:
    """Rows with a sparse feature vector of the linear encoding."""
    encoded, names = encoders.apply_linear(df, state)
    columns = [f"x{i}" for i in range(len(names))]
    vectors = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep").transform(encoded)
    return vectors.drop(*columns), names


def fit_state(train: DataFrame, groups: dict[str, list[str]] | None = None) -> dict:
    groups = groups or infer_feature_groups(train)
    assert_protected([c for columns in groups.values() for c in columns])
    return encoders.fit_linear(train, groups)


def weighted(df: DataFrame, weight: float) -> DataFrame:
    return df.withColumn("_weight", F.when(F.col(LABEL) == 1, F.lit(float(weight))).otherwise(1.0))


def _columns(**more: str) -> dict[str, str]:
    return {"featuresCol": "_features", "labelCol": LABEL, "probabilityCol": "_probability",
            "rawPredictionCol": "_raw", "predictionCol": "_prediction", **more}


def train_logistic(train: DataFrame, *, groups: dict | None = None, max_iter: int = LOGISTIC_ITERATIONS) -> FittedModel:
    """L2 logistic regression with balanced class weights.

    The inverse strength C divides the summed loss; Spark averages the loss, so the same
    penalty is 1 / (C * total weight). Raises when it stops at the iteration limit.
    """
    state = fit_state(train, groups)
    n = train.count()
    ratio = positive_weight(train, "balanced")
    # Balanced weights give each class half of the total, which stays n.
    p = n / (1 + ratio)
    rows, names = assembled(train, state)
    rows = rows.withColumn("_weight", F.when(F.col(LABEL) == 1, n / (2 * p)).otherwise(n / (2 * (n - p))))
    learner = LogisticRegression(
        weightCol="_weight", regParam=1.0 / (LOGISTIC_C * n), elasticNetParam=0.0, maxIter=max_iter, tol=1e-3,
        standardization=False, **_columns())
    model = learner.fit(rows)
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError("Logistic regression reached max_iter; increase it before accepting this run")
    return FittedModel("logistic_regression.v2", state, model, names)


def train_boosted(
    train: DataFrame, valid: DataFrame, *, groups: dict | None = None, weight_mode: str = "balanced", max_iter: int = 20,
    max_depth: int = 6, min_rows: int = 50, state: dict | None = None,
) -> FittedModel:
    """Gradient-boosted trees with a class weight and early stopping on later rows."""
    state = state or fit_state(train, groups)
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    rows, names = assembled(weighted(both, positive_weight(train, weight_mode)), state)
    learner = GBTClassifier(
        weightCol="_weight", validationIndicatorCol="_valid", maxIter=max_iter, maxDepth=max_depth, stepSize=0.1,
        minInstancesPerNode=min_rows, subsamplingRate=0.8, seed=SEED, featuresCol="_features", labelCol=LABEL,
        predictionCol="_prediction")
    model = learner.fit(rows.select("_features", "_weight", "_valid", F.col(LABEL).cast("double").alias(LABEL)))
    model = model.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return FittedModel("lightgbm.v2", state, model, names)


def oversampled(df: DataFrame, weight: float) -> DataFrame:
    """Positive rows repeated by the rounded class weight, for a learner without weights."""
    copies = F.when(F.col(LABEL) == 1, F.lit(max(1, round(weight)))).otherwise(1)
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def train_network(
    train: DataFrame, *, groups: dict | None = None, weight_mode: str = "balanced", hidden: tuple[int, ...] = (32, 16),
    max_iter: int = 40, state: dict | None = None,
) -> FittedModel:
    """Dense network on the encoded vector; class weight through repeated positives."""
    state = state or fit_state(train, groups)
    rows, names = assembled(oversampled(train, positive_weight(train, weight_mode)), state)
    learner = MultilayerPerceptronClassifier(
        layers=[len(names), *hidden, 2], maxIter=max_iter, seed=SEED, blockSize=256, **_columns())
    return FittedModel("neural_network.v2", state, learner.fit(rows), names)


def average_precision(scored: DataFrame) -> float:
    value = evaluation.ranking_metrics(evaluation.pr_curve(scored)).first()["average_precision"]  # one row
    return float(value or 0.0)


def feature_importance(fitted: FittedModel, top: int = 100) -> DataFrame:
    """Coefficients or gains by size; as many rows as the model has inputs."""
    linear = hasattr(fitted.model, "coefficients")
    values = (fitted.model.coefficients if linear else fitted.model.featureImportances).toArray()
    rows = sorted(zip(fitted.features, map(float, values)), key=lambda x: (-abs(x[1]), x[0]))[:top]
    spark = fitted.state["levels"].sparkSession
    return spark.createDataFrame([(n, v, abs(v)) for n, v in rows], "feature string, value double, absolute_value double")


def scores_of(fitted: FittedModel, df: DataFrame) -> DataFrame:
    return fitted.score(df).select(ID, LABEL, "probability")


MODEL_CLASSES = {c.__name__: c for c in (LogisticRegressionModel, GBTClassificationModel, MultilayerPerceptronClassificationModel)}


def save_model(fitted: FittedModel, path: str) -> None:
    """Model, encoder numbers and level table under one folder."""
    spark = fitted.state["levels"].sparkSession
    fitted.model.write().overwrite().save(f"{path}/model")
    fitted.state["levels"].write.mode("overwrite").parquet(f"{path}/levels")
    numbers = {k: v for k, v in fitted.state.items() if k != "levels"}
    record = {"identifier": fitted.identifier, "features": fitted.features, "rounds": getattr(fitted, "rounds", None), "state": numbers, "class": type(fitted.model).__name__}
    spark.createDataFrame([(json.dumps(record),)], "record string").coalesce(1).write.mode("overwrite").text(f"{path}/record")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    record = json.loads(spark.read.text(f"{path}/record", wholetext=True).first()[0])  # one small document
    state = {**record["state"], "levels": spark.read.parquet(f"{path}/levels")}
    model = MODEL_CLASSES[record["class"]].load(f"{path}/model")
    return FittedModel(record["identifier"], state, model, record["features"])
