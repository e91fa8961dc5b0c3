"""One batch from raw rows to decisions: verdicts, a frame per feature version, any subset of models, votes, alerts, totals."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions.row_features import number, with_v1_features
from riskspark.operators import reference_state as ref
from riskspark.operators.cases import apply_threshold, batch_summary, derive_alerts, predictions_wide
from riskspark.operators.contract import has_identity_values, validate_rows
from riskspark.plans.scoring import require_unique_models
from riskspark.schema import AMOUNT, ID, LABEL
from riskspark.session import write_through

# Fixed value: the constant column that the first feature version never saw.
V1_DROPPED = "V107"


@dataclass(frozen=True)
class BatchModel:
    """A model with the feature version it reads, what adds ``probability`` to such rows, and its own threshold."""

    identifier: str
    version: str
    score: Callable[[DataFrame], DataFrame]
    threshold: float


@dataclass(frozen=True)
class BatchResult:
    """``predictions`` has a row per valid row and model, ``refused`` a row per invalid one."""

    predictions: DataFrame
    refused: DataFrame
    models: list[str]

    def wide(self) -> DataFrame:
        return predictions_wide(self.predictions, [ID], self.models)

    def alerts(self) -> DataFrame:
        return derive_alerts(self.predictions, [ID])

    def summary(self) -> DataFrame:
        return batch_summary(self.predictions, self.refused, [ID])


def serving_frame(rows: DataFrame, version: str, state: ref.ReferenceState | None = None) -> DataFrame:
    """The features a version was trained on.

    Version 1 never saw V107, and takes any identity value for the identity row of its training join; both come
    before missing values are counted. Version 2 looks its history up in the frozen state.
    """
    if LABEL in rows.columns:
        raise ValueError(f"{LABEL} must be removed before feature engineering")
    if version == "v1":
        return with_v1_features(rows.drop(V1_DROPPED).withColumn("has_identity", has_identity_values(rows.columns)))
    if state is None:
        raise ValueError("Version 2 needs the frozen state")
    return ref.apply(rows, state)


def score_batch(rows: DataFrame, models: list[BatchModel], *, state: ref.ReferenceState | None = None) -> BatchResult:
    """Judge all rows, build each needed frame once, score it with each of its models.

    Rows at or before the end of the state's history are refused, like any other invalid row.
    """
    names = [m.identifier for m in models]
    require_unique_models(names)
    cutoff = None
    if state is not None and (end := state.meta.first())["history_end_transaction_dt"] is not None:  # one row of metadata
        cutoff = (end["history_end_transaction_dt"], end["history_end_transaction_id"])
    judged = write_through(validate_rows(rows.drop(LABEL), cutoff=cutoff), "batch")
    valid = judged.where("error_code is null").drop("error_code", "error_message")
    refused = judged.where("error_code is not null")
    frames = {v: write_through(serving_frame(valid, v, state), f"frame-{v}") for v in sorted({m.version for m in models})}
    scores = [
        m.score(frames[m.version]).select(ID, number(AMOUNT).alias("amount"), F.lit(m.identifier).alias("model_identifier"), F.col("probability").alias("risk_score"))
        for m in models
    ]
    thresholds = rows.sparkSession.createDataFrame([(m.identifier, m.threshold) for m in models], "model_identifier string, threshold double")
    predictions = apply_threshold(functools.reduce(DataFrame.unionByName, scores), thresholds)
    return BatchResult(write_through(predictions, "batch-predictions"), refused, names)
