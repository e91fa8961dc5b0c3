"""Behavioural state in hash buckets: a batch reads and rewrites only the buckets that it touches.

Keyed totals are dealt by a hash of the key, distinct pairs by a hash of the whole pair, so a hot key with many values is spread. The
base of a table is a folder per (version, bucket); a small manifest names the current version of each bucket. A batch adds one
small delta per table; every ``compact_every`` batches the deltas are folded into the buckets that they touch, as a new version of
these buckets alone. So a batch reads its own buckets and at most ``compact_every`` deltas, whatever the size of the state, and a
compaction writes as many buckets as its batches touched.

Every folder is named after the batch that writes it, and batch N reads only what earlier batches wrote: a retry overwrites
its own folders and gives the same state. Versions that no manifest needs any more are listed by ``superseded``.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from riskspark.functions.row_features import with_v2_row_features
from riskspark.operators import reference_state as ref
from riskspark.operators.history import KeyHistory, distinct_text
from riskspark.operators.reference_state import PAIR, ReferenceState
from riskspark.session import at_once

SEED = -1
PAIRS, META = "pairs", "meta"
MANIFEST = "table string, bucket int, version int"


@dataclass
class BucketedState:
    """State under ``root``. ``buckets`` is fixed once written: state size / buckets is what one task merges."""

    spark: SparkSession
    root: str
    specs: list[KeyHistory]
    buckets: int = 64
    compact_every: int = 8
    _schemas: dict = field(default_factory=dict, repr=False)

    # --- layout ---

    @property
    def tables(self) -> list[str]:
        return [s.key for s in self.specs] + ([PAIRS] if any(s.distinct for s in self.specs) else [])

    def _path(self, kind: str, batch: int, table: str | None = None) -> str:
        return f"{self.root}/{kind}/batch={batch}" + (f"/table={table}" if table else "")

    def _bucket(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _bucketed(self, df: DataFrame, table: str) -> DataFrame:
        return df.withColumn("bucket", self._bucket(*[F.col(c) for c in (PAIR if table == PAIRS else ["key"])]))

    def _schema(self, table: str):
        if table not in self._schemas:
            self._schemas[table] = self.spark.read.parquet(self._path("empty", SEED, table)).schema
        return self._schemas[table]

    def _with_bucket(self, table: str) -> StructType:
        return StructType([*self._schema(table).fields, StructField("bucket", IntegerType())])

    def _last_compaction(self, batch: int) -> int:
        """The batch whose manifest holds before ``batch``; it follows from the number alone."""
        return (((batch - 1) // self.compact_every) * self.compact_every if batch >= 1 else 0) or SEED

    def manifest(self, batch: int) -> dict[str, dict[int, int]]:
        """table -> bucket -> version before ``batch``: at most tables x buckets numbers."""
        out: dict[str, dict[int, int]] = {t: {} for t in self.tables}
        for row in self.spark.read.schema(MANIFEST).parquet(self._path("manifest", self._last_compaction(batch))).collect():
            out[row["table"]][row["bucket"]] = row["version"]
        return out

    # --- reading ---

    def meta(self, batch: int) -> DataFrame:
        """The one row of metadata before ``batch``."""
        return self.spark.read.schema(self._schema(META)).parquet(self._path("meta", batch - 1))

    def touched(self, rows: DataFrame) -> dict[str, set[int]]:
        """Buckets that the keys and pairs of these rows fall into: one aggregate, at most ``buckets`` numbers a table."""
        sets = {(s.key, s.key): self._bucket(F.col(s.key)) for s in self.specs}
        sets |= {(PAIRS, c): self._bucket(F.lit(c), F.col(s.key), distinct_text(c)) for s in self.specs for c in s.distinct}
        found = rows.agg(*[F.collect_set(column).alias(f"{table} {name}") for (table, name), column in sets.items()]).first()
        out: dict[str, set[int]] = {t: set() for t in self.tables}
        for table, name in sets:
            out[table] |= set(found[f"{table} {name}"])
        return out

    def _base(self, table: str, versions: dict[int, int], wanted: set[int] | None) -> DataFrame:
        paths = [f"{self._path('base', v, table)}/bucket={b}" for b, v in sorted(versions.items()) if wanted is None or b in wanted]
        reader = self.spark.read.schema(self._schema(table))
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(table))

    def _delta(self, table: str, batch: int, wanted: set[int] | None) -> DataFrame:
        rows = self.spark.read.schema(self._with_bucket(table)).parquet(self._path("delta", batch, table))
        return (rows if wanted is None else rows.where(F.col("bucket").isin(sorted(wanted)))).drop("bucket")

    def _state(self, batch: int, wanted: dict[str, set[int]] | None) -> ReferenceState:
        """What is stored before ``batch`` in the wanted buckets (None: in all)."""
        versions, meta = self.manifest(batch), self.meta(batch)
        pick = lambda table: None if wanted is None else wanted[table]

        def part(read) -> ReferenceState:
            return ReferenceState({s.key: read(s.key) for s in self.specs}, read(PAIRS) if PAIRS in self.tables else None, meta, self.specs)

        parts = [part(lambda t: self._base(t, versions[t], pick(t)))]
        parts += [part(lambda t, b=b: self._delta(t, b, pick(t))) for b in range(self._last_compaction(batch) + 1, batch)]
        return replace(ref.combine(parts), meta=meta) if len(parts) > 1 else parts[0]

    def before(self, batch: int, rows: DataFrame) -> ReferenceState:
        """The stored totals and pairs that ``rows`` (with row-level features) can meet, read from their buckets alone."""
        return self._state(batch, self.touched(rows))

    def whole(self, batch: int) -> ReferenceState:
        """All of the state before ``batch``."""
        return self._state(batch, None)

    # --- writing ---

    def _write_base(self, state: ReferenceState, batch: int) -> None:
        def write_table(table: str) -> None:
            rows = self._bucketed(state.pairs if table == PAIRS else state.keyed[table], table)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path("base", batch, table))

        at_once(self.spark, [functools.partial(write_table, t) for t in self.tables])

    def _write_manifest(self, versions: dict[str, dict[int, int]], batch: int) -> None:
        rows = [(t, b, v) for t, held in versions.items() for b, v in held.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(self._path("manifest", batch))

    def _buckets_of(self, kind: str, batches: list[int], table: str) -> set[int]:
        read = self.spark.read.schema(self._with_bucket(table)).parquet(*[self._path(kind, b, table) for b in batches])
        return {r["bucket"] for r in read.select("bucket").distinct().collect()}

    def create(self, state: ReferenceState) -> None:
        """Write the state that batch 0 starts from."""
        for table in [*self.tables, META]:
            rows = state.meta if table == META else state.pairs if table == PAIRS else state.keyed[table]
            rows.limit(0).write.mode("overwrite").parquet(self._path("empty", SEED, table))
        self._schemas.clear()
        self._write_base(state, SEED)
        state.meta.write.mode("overwrite").parquet(self._path("meta", SEED))
        self._write_manifest({t: dict.fromkeys(self._buckets_of("base", [SEED], t), SEED) for t in self.tables}, SEED)

    def append(
        self, batch: int, rows: DataFrame, known: ReferenceState | None = None, *, written: bool = True, fresh: DataFrame | None = None
    ) -> None:
        """Add ``rows`` (a written table, or not) as batch ``batch``.

        ``known`` is ``before(batch, rows)`` and ``fresh`` ``reference_state.fresh_pairs`` of the rows if the caller has them.
        """
        known = known or self.before(batch, with_v2_row_features(rows))
        added = ref.delta(rows, self.specs, known.pairs, reuse=not written, fresh=fresh)

        def write_part(table: str) -> None:
            part = self._bucketed(added.pairs if table == PAIRS else added.keyed[table], table).select(*self._schema(table).fieldNames(), "bucket")
            part.sortWithinPartitions("bucket").write.mode("overwrite").parquet(self._path("delta", batch, table))

        def write_meta() -> None:
            ref.combined_meta([self.meta(batch), added.meta]).coalesce(1).write.mode("overwrite").parquet(self._path("meta", batch))

        at_once(self.spark, [write_meta, *[functools.partial(write_part, t) for t in self.tables]])
        if batch > 0 and batch % self.compact_every == 0:
            self._compact(batch)

    def merge(self, batch: int, rows: DataFrame) -> None:
        """Fold later rows in as batch ``batch``; rows at or before the end of history are refused as a whole."""
        ref.require_after_cutoff(rows, self.meta(batch))
        self.append(batch, rows, written=False)

    def _compact(self, batch: int) -> None:
        """Fold the deltas up to ``batch`` into new versions of the buckets that they touch."""
        deltas = list(range(self._last_compaction(batch) + 1, batch + 1))
        wanted = {t: self._buckets_of("delta", deltas, t) for t in self.tables}
        versions = self.manifest(batch)
        meta = self.meta(batch)
        parts = [ReferenceState({s.key: self._base(s.key, versions[s.key], wanted[s.key]) for s in self.specs},
                                self._base(PAIRS, versions[PAIRS], wanted[PAIRS]) if PAIRS in self.tables else None, meta, self.specs)]
        parts += [ReferenceState({s.key: self._delta(s.key, b, None) for s in self.specs}, self._delta(PAIRS, b, None) if PAIRS in self.tables else None, meta, self.specs) for b in deltas]
        self._write_base(ref.combine(parts), batch)
        for table in self.tables:
            versions[table] |= dict.fromkeys(wanted[table], batch)
        self._write_manifest(versions, batch)

    def superseded(self, batch: int) -> list[str]:
        """Bucket folders that no batch from ``batch`` on reads, for the caller to delete."""
        last, now = self._last_compaction(batch), self.manifest(batch)
        out = []
        for version in [SEED, *range(self.compact_every, last, self.compact_every)]:
            for table in self.tables:
                out += [f"{self._path('base', version, table)}/bucket={b}" for b in sorted(self._buckets_of("base", [version], table)) if now[table].get(b) != version]
        return out
