"""Writers: split parquet, reports and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, metadata: DataFrame | None = None, split: str = "split") -> None:
    """zstd parquet partitioned by split, with the summary beside it as JSON."""
    df.write.mode("overwrite").partitionBy(split).option("compression", "zstd").parquet(f"{path}/rows")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_report(results: DataFrame, invalid: DataFrame, summary: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Results and refused rows as CSV with header, the summary as JSON."""
    shown = results.select(*columns) if columns else results
    shown.write.mode("overwrite").option("header", True).option("nullValue", "").csv(f"{path}/prediction_results")
    invalid.write.mode("overwrite").option("header", True).csv(f"{path}/invalid_rows")
    summary.write.mode("overwrite").json(f"{path}/summary")


def upsert_latest(base: DataFrame, updates: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """Merge on a key: the update wins, among updates the latest by ``order``.

    An aggregate instead of a window: copies of one key combine before the shuffle.
    """
    columns = base.columns
    rank = order if order is not None else F.lit(0)
    old = base.select(*columns, F.struct(F.lit(0).alias("a"), F.lit(None).cast("long").alias("b")).alias("_v"))
    new = updates.select(*columns, F.struct(F.lit(1).alias("a"), rank.cast("long").alias("b")).alias("_v"))
    rest = [c for c in columns if c not in key]
    latest = old.unionByName(new).groupBy(*key).agg(F.max_by(F.struct(*rest), "_v").alias("_row"))
    return latest.select(*key, "_row.*").select(*columns)
