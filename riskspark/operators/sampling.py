"""Chronological splits, expanding folds and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.ordering import event_order, sequence_numbers
from riskspark.schema import ID, LABEL, TIME
from riskspark.session import single_row, write_through

# Fixed values: (train end, validation end) of the three folds as shares of all rows; the
# folds themselves divide the first 85 percent.
FOLD_BOUNDS = [(0.45, 0.55), (0.60, 0.70), (0.70, 0.85)]
DEVELOPMENT_SHARE = 0.85


def _position_keys(df: DataFrame, positions: list[int]) -> dict[int, tuple]:
    """(time, id) of the rows at the given order numbers; as many rows as positions."""
    ranked = sequence_numbers(df.select(TIME, ID))
    found = ranked.where(F.col("sequence_number").isin(positions)).collect()
    return {r["sequence_number"]: (r[TIME], r[ID]) for r in found}


def _before(key: tuple) -> Column:
    return F.struct(*event_order()) < F.struct(F.lit(key[0]).alias(TIME), F.lit(key[1]).alias(ID))


def split_chronological(df: DataFrame, *, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Add ``split`` by position in (time, id) order.

    Only the narrow order columns are sorted. The two boundary rows become literals, so
    the wide rows are labelled in place without a shuffle.
    """
    if not 0 < train < 1 or not 0 < validation < 1:
        raise ValueError("the shares of train and validation lie strictly between 0 and 1")
    if train + validation >= 1:
        raise ValueError("no share is left for test rows")
    n = df.count()
    first, second = int(n * train), int(n * (train + validation))
    keys = _position_keys(df, [first, second])
    if first not in keys or second not in keys:  # fewer rows than parts
        raise ValueError("Too few rows to split")
    return df.withColumn(
        "split",
        F.when(_before(keys[first]), "train").when(_before(keys[second]), "validation").otherwise("test"),
    )


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(LABEL).cast("bigint").alias("fraud_count"), F.avg(LABEL).alias("fraud_rate"),
        F.min(TIME).cast("double").alias("transaction_dt_min"), F.max(TIME).cast("double").alias("transaction_dt_max"),
    )


def fold_bounds(rows: int) -> list[tuple[int, int]]:
    if rows < 100:
        raise ValueError("time folds take 100 rows or more")
    return [(int(rows * a / DEVELOPMENT_SHARE), int(rows * b / DEVELOPMENT_SHARE)) for a, b in FOLD_BOUNDS]


def split_expanding_folds(df: DataFrame) -> DataFrame:
    """One copy of a row per fold it belongs to, with ``fold`` and ``role``."""
    n = df.count()
    bounds = fold_bounds(n)
    keys = _position_keys(df, sorted({p for pair in bounds for p in pair if p < n}))
    roles = []
    for train_end, valid_end in bounds:
        inside = _before(keys[valid_end]) if valid_end in keys else F.lit(True)
        roles.append(F.when(_before(keys[train_end]), "train").when(inside, "validation"))
    return df.select("*", F.posexplode(F.array(*roles)).alias("_fold", "role")).where("role is not null").select(
        *df.columns, (F.col("_fold") + 1).alias("fold"), "role"
    )


def _seeded_hash(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ID).cast("string")))


def take_per_stratum(df: DataFrame, stratum: str, quotas: DataFrame, seed: int) -> DataFrame:
    """Exactly ``quota`` rows of each stratum of ``quotas`` (stratum, quota), those with the smallest seeded hash.

    Hashes fall evenly into 4096 buckets. Bucket counts tell which buckets are taken whole; the one where the quota ends is
    divided by the next three digits in the same way, and only the last edge, a 16-millionth of a stratum, is ranked.
    """
    hashed = df.withColumn("_hash", _seeded_hash(seed))
    left = quotas.select(F.col(stratum).alias("_s"), F.col("quota").cast("long").alias("_left"))
    taken, edge = [], hashed
    for first in (1, 4):
        whole, edge, left = _divide(edge, stratum, left, first)
        taken.append(whole.select(*df.columns))
    ranked = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_hash", ID)))
    last = ranked.join(left, ranked[stratum].eqNullSafe(left["_s"])).where(F.col("_rank") <= F.col("_left"))
    return taken[0].unionByName(taken[1]).unionByName(last.select(*df.columns))


def _divide(rows: DataFrame, stratum: str, left: DataFrame, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of buckets taken whole, rows of the edge buckets, what is left to take from those)."""
    bucketed = rows.withColumn("_bucket", F.substring("_hash", first, 3))
    counts = bucketed.groupBy(F.col(stratum).alias("_c"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_c").orderBy("_bucket")  # at most 4096 rows
    spans = counts.withColumn("_last", F.sum("_n").over(upto)).join(left, F.col("_c").eqNullSafe(F.col("_s")))
    spans = spans.withColumn("_rest", F.col("_left") - (F.col("_last") - F.col("_n"))).where("_rest > 0")
    spans = write_through(spans.select("_s", F.col("_bucket").alias("_b"), (F.col("_n") <= F.col("_rest")).alias("_whole"), "_rest"), "sample-buckets")
    near = bucketed.join(spans, bucketed[stratum].eqNullSafe(spans["_s"]) & (bucketed["_bucket"] == spans["_b"]))
    edge = near.where("not _whole").select(*rows.columns)
    return near.where("_whole"), edge, spans.where("not _whole").select("_s", F.col("_rest").alias("_left"))


def _stratum_sizes(df: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n), written."""
    return write_through(df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), "strata")


def sample_stratified(df: DataFrame, rows: int, *, stratum: str = LABEL, seed: int = 42) -> DataFrame:
    """``rows`` rows with the class shares of the table; the smallest class takes the rest."""
    sizes = _stratum_sizes(df, stratum)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if rows <= 0 or rows >= total:
        return df
    share = F.least(F.bround(F.lit(rows) * F.col("n") / F.lit(total)), F.col("n")).cast("long")
    shared = sizes.withColumn("quota", share)
    # The class that comes last by size, then text, and what all classes together were given: one row.
    sums = shared.agg(
        F.max(F.struct(-F.col("n"), F.coalesce(F.col(stratum).cast("string"), F.lit("None")))).alias("last"), F.sum("quota").alias("given")
    )
    both = shared.withColumn("_t", single_row(sums))
    last = F.struct(-F.col("n"), F.coalesce(F.col(stratum).cast("string"), F.lit("None"))) == F.col("_t.last")
    rest = F.least(F.greatest(F.lit(rows) - F.col("_t.given") + F.col("quota"), F.lit(0)), F.col("n"))
    return take_per_stratum(df, stratum, both.select(stratum, F.when(last, rest).otherwise(F.col("quota")).alias("quota")), seed)


def sample_debug(df: DataFrame, rows: int, *, stratum: str = LABEL, seed: int = 42) -> DataFrame:
    """Small sample that keeps at least one row of every class."""
    sizes = _stratum_sizes(df, stratum)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if rows >= total:
        return df
    quota = F.greatest(F.lit(1), F.bround(F.lit(rows) * F.col("n") / F.lit(total))).cast("long")
    return take_per_stratum(df, stratum, sizes.select(stratum, quota.alias("quota")), seed)


def earliest_n(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in event order."""
    return df.orderBy(*event_order()).limit(n)
