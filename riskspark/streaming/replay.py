"""Ordered replay: a table sorted by sequence number and a streaming source whose offsets are sequence numbers.

``write_replay`` range-sorts the rows once and writes an index of the files (first and last sequence number). The source
hands out the next ``rowsPerTrigger`` numbers per micro-batch, so the order follows from the rows, not from file names or
modification times, and a checkpoint holds the position exactly. A micro-batch opens only the files and row groups that hold its
numbers; a large one is dealt to tasks in ranges of ``rowsPerTask`` numbers. Rows appended later with ``append_replay``
are found by a running query.

Tasks read the files with pyarrow, so the folder must be on a file system that it can open (local or shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from riskspark.operators.ordering import sequence_numbers

# The allowed replay rates and the rows fetched at a time.
RATES = (1, 2, 5)
FETCH_ROWS = 100

SEQUENCE = "sequence_number"
ROW_GROUP_BYTES = 4 << 20  # so that a small micro-batch opens little


def write_replay(df: DataFrame, path: str, *, order: list | None = None) -> T.StructType:
    """Number the rows in event order and write them with their index; returns the schema to read them with."""
    rows = sequence_numbers(df, order)
    append_replay(rows, path)
    return rows.schema


def append_replay(rows: DataFrame, path: str) -> None:
    """Add rows that carry sequence numbers. The index is written last, so a reader sees complete files only."""
    spark = rows.sparkSession
    at = spark.read.parquet(f"{path}/index").agg(F.max("part")).first()[0] + 1 if _exists(path) else 0
    folder = f"rows/part={at}"
    sorted_rows = rows.repartitionByRange(F.col(SEQUENCE)).sortWithinPartitions(SEQUENCE)
    sorted_rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/{folder}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
    index = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(SEQUENCE).alias("first"), F.max(SEQUENCE).alias("last"))
    index = index.select(F.lit(at).alias("part"), F.concat(F.lit(f"{folder}/"), F.col("name")).alias("name"), "first", "last")
    index.coalesce(1).write.mode("append").parquet(f"{path}/index")  # a row per file


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _exists(path: str) -> bool:
    system, folder = _open(path)
    return system.get_file_info(f"{folder}/index/_SUCCESS").type == fs.FileType.File


@dataclass
class Slice(InputPartition):
    """Rows of one file with sequence numbers from first to last."""

    name: str
    first: int
    last: int


class ReplayReader(DataSourceStreamReader):
    """Offsets are {"next": sequence number}; every micro-batch ends after ``rowsPerTrigger`` more numbers at most."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.schema = options["path"].rstrip("/"), schema
        self.per_trigger = int(options.get("rowsPerTrigger", FETCH_ROWS))
        self.per_task = int(options.get("rowsPerTask", 100_000))
        if self.per_trigger < 1 or self.per_task < 1:
            raise ValueError("rowsPerTrigger and rowsPerTask must be positive")
        self.next: int | None = None
        self.index: list[tuple[int, int, str]] = []

    def _load(self) -> None:
        """The files by their first sequence number; one row each."""
        system, folder = _open(self.path)
        table = pq.read_table(f"{folder}/index", filesystem=system, columns=["name", "first", "last"])
        self.index = sorted(zip(table["first"].to_pylist(), table["last"].to_pylist(), table["name"].to_pylist()))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """Called once per micro-batch; after a restart Spark has asked for the last batch's partitions before."""
        at = self.next if self.next is not None else 0
        ahead = [r for r in self.index if r[1] >= at]
        if not ahead:
            self._load()
            ahead = [r for r in self.index if r[1] >= at]
        if ahead:
            at = max(at, min(r[0] for r in ahead))  # numbers without rows don't make empty batches
            self.next = min(at + self.per_trigger, max(r[1] for r in ahead) + 1)
        else:
            self.next = at
        return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if self.next is None:  # restarted: go on behind the batch that is planned first
            self.next = end["next"]
        low, high = start["next"], end["next"] - 1
        if not any(last >= high for _, last, _ in self.index):
            self._load()
        out = []
        for first, last, name in self.index:
            a, b = max(first, low), min(last, high)
            out += [Slice(name, at, min(at + self.per_task - 1, b)) for at in range(a, b + 1, self.per_task)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        system, folder = _open(self.path)
        names, target = self.schema.fieldNames(), to_arrow_schema(self.schema)
        with system.open_input_file(f"{folder}/{partition.name}") as source:
            file = pq.ParquetFile(source)
            place = file.schema_arrow.names.index(SEQUENCE)
            for number in range(file.num_row_groups):
                held = file.metadata.row_group(number).column(place).statistics
                if held is not None and held.has_min_max and (held.max < partition.first or held.min > partition.last):
                    continue
                rows = file.read_row_group(number, columns=list(dict.fromkeys([*names, SEQUENCE])))
                mine = pc.and_(pc.greater_equal(rows[SEQUENCE], partition.first), pc.less_equal(rows[SEQUENCE], partition.last))
                yield from rows.filter(mine).select(names).cast(target).to_batches()


class OrderedReplay(DataSource):
    """``spark.readStream.format("ordered_replay").schema(...).option("path", ...)``; also ``rowsPerTrigger`` and ``rowsPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_replay"

    def streamReader(self, schema: T.StructType) -> ReplayReader:
        return ReplayReader(self.options, schema)


def read_replay(spark: SparkSession, path: str, schema: T.StructType, *, rows_per_trigger: int = FETCH_ROWS) -> DataFrame:
    spark.dataSource.register(OrderedReplay)
    return spark.readStream.format("ordered_replay").schema(schema).option("path", path).option("rowsPerTrigger", rows_per_trigger).load()


def paced(writer: DataStreamWriter, *, rows_per_trigger: int, rate: int | None) -> DataStreamWriter:
    """One batch after the other, or a batch per interval so that ``rate`` rows come per second."""
    if rate is None:
        return writer.trigger(processingTime="0 seconds")
    if rate not in RATES:
        raise ValueError(f"rate must be one of {RATES}")
    return writer.trigger(processingTime=f"{1000 * rows_per_trigger // rate} milliseconds")


def drained(query: StreamingQuery) -> None:
    """Wait until all rows that are there have been processed, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
