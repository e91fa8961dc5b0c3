"""Score rows with any subset of models, and explain scores by hiding features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.row_features import number
from riskspark.operators.contributions import TOP_K, rank_contributions
from riskspark.operators.contract import assert_protected
from riskspark.plans.training import FittedModel
from riskspark.schema import ID, PREDICTION_SCHEMA
from riskspark.session import write_through


@dataclass(frozen=True)
class LinearScorer:
    """A logistic model of fixed coefficients; missing inputs take ``fill``."""

    coefficients: dict[str, float]
    intercept: float
    fill: float = 0.0

    def score(self, df: DataFrame) -> DataFrame:
        z = F.lit(self.intercept)
        for name, weight in self.coefficients.items():
            z = z + F.lit(weight) * F.coalesce(number(name), F.lit(self.fill))
        return df.withColumn("probability", 1.0 / (1.0 + F.exp(-z)))


def score_models(features: DataFrame, models: dict[str, FittedModel | LinearScorer], *, reuse: bool = True) -> DataFrame:
    """Long predictions (id, model_identifier, risk_score) of all selected models.

    The feature frame is written once and read by every model.
    """
    if not models:
        raise ValueError("there is no model to score with")
    rows = write_through(features, "scoring") if reuse and len(models) > 1 else features
    parts = [
        fitted.score(rows).select(ID, F.lit(name).alias("model_identifier"), F.col("probability").alias("risk_score"))
        for name, fitted in models.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def require_unique_models(names: list[str]) -> None:
    if not names or len(names) != len(set(names)):
        raise ValueError("one to eight different models can be asked for")


def score_external_model(
    features: DataFrame, identifier: str, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], columns: list[str]
) -> DataFrame:
    """Scores of a user's Python model, batch by batch inside the tasks.

    ``load`` runs once per task; only the id and the model's columns are sent to Python.
    """
    assert_protected(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            scores = pd.Series(predict(batch[columns])).astype("float64").to_numpy()
            yield pd.DataFrame({ID: batch[ID].to_numpy(), "model_identifier": identifier, "risk_score": scores})

    return features.select(ID, *columns).mapInPandas(run, PREDICTION_SCHEMA)


def explain_ablation(rows: DataFrame, fitted: FittedModel | LinearScorer, columns: list[str], *, top_k: int = TOP_K) -> DataFrame:
    """Score change when one present feature is hidden at a time, largest first.

    Each row becomes one variant per present feature (a number fixed by the model), all
    variants are scored in one pass and compared with the unchanged row.
    """
    kept = rows.select(ID, *columns)
    variants = [F.lit(None).cast("string"), *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]]
    long = kept.select("*", F.posexplode(F.array(*variants)).alias("_at", "feature")).where("_at = 0 or feature is not null")
    types = dict(kept.dtypes)
    hidden = long.withColumns({
        c: F.when(F.col("feature") == c, F.lit(None).cast(types[c])).otherwise(F.col(c)) for c in columns
    })
    scored = fitted.score(hidden).select(ID, "feature", "probability")
    base = scored.where("feature is null").select(ID, F.col("probability").alias("_base"))
    deltas = scored.where("feature is not null").join(base, ID).select(
        ID, "feature", (F.col("_base") - F.col("probability")).alias("contribution"))
    return rank_contributions(deltas, [ID], top_k=top_k)
