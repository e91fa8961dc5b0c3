"""Session helpers: shared scratch folder and tables written to cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_folder(spark.sparkContext.applicationId).name


@functools.cache
def _local_folder(application: str) -> tempfile.TemporaryDirectory:
    """Goes with everything in it when the process ends."""
    return tempfile.TemporaryDirectory(prefix=f"riskspark-{application}-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder per table, grouped by application so that one rule can expire them."""
    return f"{shared_dir(spark)}/riskspark/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def single_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct constant of another query (a scalar subquery, no join)."""
    return df.select(F.struct(*df.columns)).scalar()


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lost executors re-read the files instead of recomputing the plan, the result keeps
    column pruning and file statistics, and values that depend on how rows were
    partitioned (such as order positions) are fixed once written.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, jobs: list[Callable[[], object]]) -> None:
    """Run independent small jobs side by side, since planning them takes longer than their work; the first failure is raised.

    Threads inherit the caller's job group, so stopping a stream cancels them too.
    """
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()
