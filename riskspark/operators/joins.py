"""Keyed joins. Strategy is left to Catalyst and AQE, which split skewed sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators.contract import unique_violations
from riskspark.schema import ID, LABEL


def require_unique(df: DataFrame, key: list[str], what: str) -> None:
    repeated = unique_violations(df, key).first()["repeated_keys"]
    if repeated:
        raise ValueError(f"{', '.join(key)} must be unique in {what}: {repeated} repeated")


def join_identity(transactions: DataFrame, identities: DataFrame, key: str = ID, *, validate: bool = True) -> DataFrame:
    """One-to-one left join; ``has_identity`` is 1 when the identity row exists."""
    if validate:
        require_unique(transactions, [key], "transactions")
        require_unique(identities, [key], "identities")
    found = identities.withColumn("_found", F.lit(1))
    return transactions.join(found, key, "left").withColumn("has_identity", F.coalesce("_found", F.lit(0))).drop("_found")


def semi_join_ids(identities: DataFrame, sample: DataFrame, key: str = ID) -> DataFrame:
    return identities.join(sample.select(key), key, "left_semi")


def new_pairs(pairs: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct pairs that are not known yet, compared exactly."""
    return pairs.select(*columns).distinct().join(known.select(*columns), columns, "left_anti")


def join_predictions(first: DataFrame, second: DataFrame, names: tuple[str, str], score: str = "probability") -> DataFrame:
    """Scores of two models side by side with a flag where their labels disagree."""
    left = first.select(ID, LABEL, F.col(score).alias(names[0]))
    right = second.select(ID, F.col(LABEL).alias("_label"), F.col(score).alias(names[1]))
    return left.join(right, ID).withColumn("label_mismatch", ~F.col(LABEL).eqNullSafe(F.col("_label"))).drop("_label")


def require_label_agreement(joined: DataFrame) -> DataFrame:
    if not joined.where("label_mismatch").isEmpty():
        raise ValueError("Label mismatch while joining predictions")
    return joined.drop("label_mismatch").orderBy(ID)


def join_ground_truth(rows: DataFrame, labels: DataFrame, key: str, *, label: str = "is_fraud") -> DataFrame:
    """Attach labels kept elsewhere; absent labels stay NULL."""
    return rows.join(labels.select(key, F.col(label).cast("boolean").alias("actual_label")), key, "left")


def ground_truth_gaps(joined: DataFrame) -> DataFrame:
    """Labelled data must have a label on every row; returns the two counts."""
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("actual_label").isNull()).alias("missing_labels"))


def score_parity(fresh: DataFrame, stored: DataFrame, *, key: str = ID, rtol: float = 1e-5, atol: float = 1e-7) -> DataFrame:
    """Compare fresh with stored scores by id: largest delta, closeness, label agreement."""
    a = fresh.select(key, F.col(LABEL).alias("_l"), F.col("probability").alias("_a"))
    b = stored.select(key, F.col(LABEL).alias("_m"), F.col("probability").alias("_b"))
    joined = a.join(b, key, "full_outer")
    delta = F.abs(F.col("_a") - F.col("_b"))
    close: Column = delta <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("_b"))
    return joined.agg(
        F.count(F.lit(1)).alias("rows_compared"), F.max(delta).alias("max_abs_delta"),
        F.bool_and(F.coalesce(close, F.lit(False))).alias("scores_match"),
        F.bool_and(F.col("_l").eqNullSafe(F.col("_m"))).alias("labels_match"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched_rows"),
    )
