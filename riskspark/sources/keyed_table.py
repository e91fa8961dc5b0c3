"""Stored tables that are read and merged by key.

``KeyedTable`` lies in hash buckets, each in a folder per version; a small manifest names every bucket's version. A merge combines the
updates first, reads the buckets that they touch, writes these as the new version and then the manifest, so a small update rewrites
its own buckets only. A merge is named by its version: a retry overwrites what it wrote and gives the same table, and readers
see the old version until the manifest is there. Lookups read the buckets of their keys, where sorted files and bloom filters skip row groups.

``ClusteredTable`` is sorted by one column over its files, with a small index of what each file holds: a keyset page reads the few files
that the page needs.

Null keys name one row like any other value. Empty updates write a manifest alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from riskspark.operators.ordering import running_totals
from riskspark.session import write_through

BUCKET = "_bucket"
MANIFEST = "bucket int, version long"


def _with_blooms(writer, columns: list[str]):
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


@dataclass
class KeyedTable:
    """Rows of ``schema`` under ``root``, one per key. ``buckets`` is fixed: table size / buckets is what a merge rewrites at least."""

    spark: SparkSession
    root: str
    schema: StructType
    key: list[str]
    buckets: int = 64

    def _path(self, bucket: int, version: int) -> str:
        return f"{self.root}/data/version={version}/{BUCKET}={bucket}"

    def _bucket(self) -> Column:
        # The type of a key is part of its hash; rows and lists of keys have the table's own types.
        return F.pmod(F.xxhash64(*[f"`{k}`" for k in self.key]), F.lit(self.buckets)).cast("int")

    def _packed(self, df: DataFrame, rank: Column) -> DataFrame:
        """(row, rank), the row in the table's own types."""
        return df.select(F.struct(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]).alias("row"), rank.alias("rank"))

    def _latest(self, packed: DataFrame) -> DataFrame:
        """Of each key the row of highest rank, among equals of highest hash; copies of a key combine before the shuffle."""
        names = [F.col(f"row.`{k}`").alias(f"key{i}") for i, k in enumerate(self.key)]
        return packed.groupBy(*names).agg(F.max_by("row", F.struct("rank", F.xxhash64("row"))).alias("row")).select("row.*")

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Version of each bucket that holds rows: of the latest merge, or of the latest before one."""
        found = self.spark.read.schema(f"{MANIFEST}, merge long").parquet(f"{self.root}/manifest")
        if before is not None:
            found = found.where(F.col("merge") < before)
        latest = found.agg(F.max("merge")).first()[0]
        if latest is None:
            return {}
        return {r["bucket"]: r["version"] for r in found.where((F.col("merge") == latest) & (F.col("bucket") >= 0)).collect()}  # a row a bucket

    def _read(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._path(b, v) for b, v in sorted(versions.items())])

    def _write(self, rows: DataFrame, version: int) -> None:
        if BUCKET in rows.columns:
            raise ValueError(f"{BUCKET} is the name of the table's folders")
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.key)
        _with_blooms(dealt.write.mode("overwrite").partitionBy(BUCKET), self.key).parquet(f"{self.root}/data/version={version}")

    def _write_manifest(self, versions: dict[int, int], version: int) -> None:
        rows = sorted(versions.items()) or [(-1, version)]  # an empty table has a manifest too
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/merge={version}")

    def create(self, rows: DataFrame, order: Column | None = None) -> None:
        """Version 0; of several rows of a key the latest by ``order`` stays."""
        self._write_manifest({}, -1)
        self.merge(rows, 0, order)

    def merge(self, updates: DataFrame, version: int, order: Column | None = None) -> set[int]:
        """Updates win over stored rows, among updates the latest by ``order`` (ties by a hash of the row); returns the buckets rewritten.

        Columns that the table lacks are ignored. Versions go up by merge; a retry gives the same version again.
        """
        before = self.manifest(version)
        ranked = self._packed(updates, (order if order is not None else F.lit(0)).cast("long"))
        latest = write_through(self._latest(ranked), "updates")  # one row a key: no key is hot any more
        touched = {r["b"] for r in latest.select(self._bucket().alias("b")).distinct().collect()}  # at most one row a bucket
        if touched:
            old = self._read({b: before[b] for b in touched & before.keys()})
            self._write(self._latest(self._packed(old, F.lit(0)).unionByName(self._packed(latest, F.lit(1)))), version)
        self._write_manifest(before | dict.fromkeys(touched, version), version)
        return touched

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or what it was after a merge."""
        return self._read(self.manifest(None if version is None else version + 1))

    def lookup(self, keys: list[tuple]) -> DataFrame:
        """The rows of a stated list of keys, from their buckets alone."""
        types = StructType([StructField(k, self.schema[k].dataType) for k in self.key])
        asked = self.spark.createDataFrame(keys, types)
        wanted = {r["b"] for r in asked.select(self._bucket().alias("b")).distinct().collect()}
        rows = self._read({b: v for b, v in self.manifest().items() if b in wanted})
        if len(self.key) == 1:  # pushed down to row groups
            name, values = F.col(f"`{self.key[0]}`"), [k[0] for k in keys]
            named = name.isin([v for v in values if v is not None])
            return rows.where(named | name.isNull() if None in values else named)
        same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in self.key]
        return rows.alias("r").join(F.broadcast(asked.distinct().alias("a")), same, "left_semi")  # the stated list

    def superseded(self) -> list[str]:
        """Folders that the latest manifest does not name; expired once no reader of an older version is left."""
        current = self.manifest()
        used = {self._path(b, v) for b, v in current.items()}
        found = self.spark.read.schema(f"{MANIFEST}, merge long").parquet(f"{self.root}/manifest").where("bucket >= 0").select("bucket", "version").distinct()
        return sorted({self._path(r["bucket"], r["version"]) for r in found.collect()} - used)


@dataclass
class ClusteredTable:
    """A table sorted over its files by an integer column, ``id_col``."""

    spark: SparkSession
    root: str
    id_col: str

    def write(self, rows: DataFrame, files: int | None = None) -> None:
        """Range-sorted files with bloom filters, and an index of (file, least and largest id, rows). Rows with a null id are refused."""
        refused = F.raise_error(F.lit("a row without an id can't be clustered"))
        checked = rows.withColumn(self.id_col, F.coalesce(F.col(self.id_col), refused.cast(rows.schema[self.id_col].dataType)))
        spread = [F.col(self.id_col), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]  # equal ids may lie in several files
        dealt = checked.repartitionByRange(files, *spread) if files else checked.repartitionByRange(*spread)
        _with_blooms(dealt.sortWithinPartitions(self.id_col).write.mode("overwrite"), [self.id_col]).parquet(f"{self.root}/rows")
        stored = self.spark.read.parquet(f"{self.root}/rows")
        index = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.min(self.id_col).cast("long").alias("least"), F.max(self.id_col).cast("long").alias("most"), F.count(F.lit(1)).alias("n"))
        ranked = running_totals(index, [F.col("least"), F.col("most"), F.col("file")], {"through": F.col("n")})
        ranked.write.mode("overwrite").parquet(f"{self.root}/index")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def page(self, after: int | None, size: int) -> DataFrame:
        """The ``size`` rows of the smallest ids above ``after``, in order; equal ids are ordered by the other columns."""
        index = self.spark.read.parquet(f"{self.root}/index")
        if after is not None:
            index = index.where(F.col("most") > after)
        whole = index if after is None else index.where(F.col("least") > after)
        # Files that start above the page's start hold only rows of it; the first ``size`` of their rows end the page at the latest.
        first = whole.agg(F.min(F.col("through") - F.col("n"))).first()[0]
        if first is not None:
            last = whole.where(F.col("through") >= first + size).agg(F.min("most")).first()[0]
            index = index if last is None else index.where(F.col("least") <= last)
        paths = [r["file"] for r in index.select("file").collect()]  # the page's files
        rows = self.read()
        rows = self.spark.read.schema(rows.schema).parquet(*paths) if paths else rows.where(F.lit(False))
        rows = rows if after is None else rows.where(F.col(self.id_col) > after)
        rest = [F.col(f"`{c}`") for c in rows.columns if c != self.id_col]
        return rows.orderBy(self.id_col, *rest).limit(size)
