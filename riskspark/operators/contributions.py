"""Feature contributions: ranking and plain-language reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name parts that mark a behavioural feature, in the order they are tested,
# with the words used for them.
BEHAVIOUR_LABELS = {
    "seconds_since_previous": "time since the previous related transaction",
    "prior_mean": "historical average transaction amount",
    "prior_std": "historical transaction amount variability",
    "prior_unique_count": "historical variety of transaction activity",
    "prior_count": "previous transaction frequency",
    "prior_numeric_count": "previous transaction frequency",
}
TOWARD_FRAUD, TOWARD_NOT_FRAUD = "toward_fraud", "toward_not_fraud"
SMALLEST = 1e-12
TOP_K = 5


def direction(contribution: Column) -> Column:
    return F.when(contribution >= 0, TOWARD_FRAUD).otherwise(TOWARD_NOT_FRAUD)


def rank_contributions(rows: DataFrame, key: list[str], *, top_k: int = TOP_K, tie: str = "feature") -> DataFrame:
    """Largest absolute contributions per (transaction, model).

    A group holds one row per model feature. Spark cuts each group to ``top_k`` rows
    before the shuffle.
    """
    finite = F.col("contribution").isNotNull() & ~F.isnan("contribution") & (F.abs("contribution") != float("inf"))
    checked = rows.withColumn(
        "contribution", F.when(finite, F.col("contribution")).otherwise(
            F.raise_error(F.lit("a contribution is missing or not finite")).cast("double")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), tie))
    return checked.withColumn("rank", rank).where(F.col("rank") <= top_k).withColumn("direction", direction(F.col("contribution")))


def behaviour_label(feature: Column, labels: dict[str, str] = BEHAVIOUR_LABELS) -> Column:
    """Words for a behavioural feature, NULL for any other; a ``numeric__`` style prefix is dropped.

    Distinct counts are named ``prior_nunique`` here, which no default marker matches; pass a marker to explain them too.
    """
    name = F.when(feature.contains("__"), F.regexp_replace(feature, "^.*?__", "")).otherwise(feature)
    label = F.lit(None).cast("string")
    for part, words in reversed(list(labels.items())):
        label = F.when(name.contains(f"_{part}"), F.lit(words)).otherwise(label)
    return label


def reasons(ranked: DataFrame, key: list[str], labels: dict[str, str] = BEHAVIOUR_LABELS) -> DataFrame:
    """One sentence per flagged transaction and model; NULL when nothing explains it.

    ``ranked`` carries ``decision`` and at most a few ranked features per group.
    """
    label = behaviour_label(F.col("feature"), labels)
    usable = F.col("decision") & (F.col("direction") == TOWARD_FRAUD) & (F.abs("contribution") > SMALLEST) & label.isNotNull()
    # Each label once, at its best rank; the first two are named.
    listed = F.sort_array(F.collect_list(F.when(usable, F.struct(F.col("rank"), label.alias("label")))))
    words = F.slice(F.array_distinct(F.transform(listed, lambda x: x["label"])), 1, 2)
    grouped = ranked.groupBy(*key).agg(words.alias("_words"))
    # Fixed value: the wording of a reason.
    sentence = F.concat(F.lit("It is flagged as fraud because "), F.array_join("_words", " and "), F.lit(" increased the model's fraud score."))
    return grouped.select(*key, F.when(F.size("_words") > 0, sentence).alias("reasoning"), F.when(F.size("_words") > 0, "template").alias("reasoning_source"))
