"""Near copies by exact Jaccard of word shingles; SimHash fingerprints and MinHash bands find the candidates.

A text's set is the 64-bit hashes of its five-word shingles (fewer words: the whole sequence; none: the empty set, which only
another empty set equals). Two texts are near copies where their sets have a Jaccard of ``least`` or more; classes are what near
copies connect. Operator 1's index proposes sets whose fingerprints differ in at most ``distance`` bits (a fingerprint here is that of the
set). Few pairs near ``least`` are that close, so ``bands`` keys of ``rows`` minima each propose more: a pair at Jaccard s shares no key with
probability (1 - s^rows)^bands, 1.3e-7 at 0.8 for 40 keys of 5, less above. Candidates of either kind are then decided by their exact Jaccard.

Equal sets are one node, whatever their number. Members of a bucket are linked to its least node, so a bucket costs its size, not its
pairs; sets meet once, in blocks of their candidate component (see ``blocks``). A null text counts as empty; of rows with one id and
one set one stays; a null id is the least only where all ids of its class are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from riskspark.llm import blocks, simhash
from riskspark.llm.common import slices
from riskspark.llm.components import components
from riskspark.session import write_through

SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_AT_A_TIME = 256  # shingles whose permutations are in memory at once
_SETS = 1024  # sets that are unpacked at once, besides those of an open block
_SLOTS = 1 << 22  # of the map of nodes, so that most rows pass without a join


@dataclass(frozen=True)
class Setting:
    shingle: int = 5
    least: float = 0.8
    bands: int = 40
    rows: int = 5
    distance: int = simhash.DISTANCE
    cap: int = 256  # members of a chunk whose sets are compared


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct hashes of all word shingles, sorted. Words are runs without ASCII white space, A-Z lowered."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist())
    return np.unique(np.fromiter((digest(view[a:b], SEED) for a, b in islice(pairs, n)), np.uint64, n))


def node_of(found: np.ndarray) -> int:
    """One number for equal sets."""
    return int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True)


class Bands:
    """Keys of a set: for each band, a hash of the least values under its permutations."""

    def __init__(self, setting: Setting):
        rng = np.random.default_rng(SEED)
        self.shape = setting.bands, setting.rows
        self.factor = rng.integers(0, 1 << 63, self.shape[0] * self.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, self.shape[0] * self.shape[1], np.uint64)

    def keys(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(0, np.int64)
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), _AT_A_TIME):
            np.minimum(low, (found[at:at + _AT_A_TIME, None] * self.factor + self.plus).min(0), out=low)
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(low.reshape(self.shape))], np.uint64).view(np.int64)


def jaccard_linked(held: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the other sets have a Jaccard of ``least`` or more with a set; all sorted and none empty."""
    sizes = np.array([len(o) for o in others], np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(held, flat), len(held) - 1)
    both = np.add.reduceat((held[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return both >= least * (len(held) + sizes - both) - 1e-9


def _slot(node: str):
    return F.pmod(F.col(node), F.lit(_SLOTS)) + 1


def _map_of(nodes: DataFrame, node: str) -> np.ndarray:
    """One bit a slot: whether a node is in the table (or shares its slot). Bounded, whatever the number of nodes."""
    slot = _slot(node)
    parts = nodes.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    out = np.zeros(_SLOTS // 8 + 8192, np.uint8)
    for bucket, bits in parts.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).collect():  # at most _SLOTS / 32,768 rows
        out[(bucket - 1) * 4096:(bucket - 1) * 4096 + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _marked(rows: DataFrame, node: str, bits: np.ndarray, wanted: bool) -> DataFrame:
    """The rows whose node's bit is as wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            slot = part.column(node).to_numpy(zero_copy_only=False) % _SLOTS
            yield part.filter(pa.array((bits[slot >> 3] >> (slot & 7) & 1 > 0) == wanted))

    return rows.mapInArrow(run, rows.schema)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", setting: Setting = Setting()) -> DataFrame:
    """One row of each class, with all its columns: the row with the smallest id (of several, the one with the smallest node)."""
    node, keys, fp = "_node", "_keys", "_fp"
    while {node, keys, fp} & set(df.columns):
        node, keys, fp = node + "_", keys + "_", fp + "_"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(setting)
        for part in slices(batches):
            sets = [shingles(t or "", setting.shingle) for t in part.column(text_col).to_pylist()]
            added = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([bands.keys(s) for s in sets], pa.list_(pa.int64()))]
            added.append(pa.array([simhash.fingerprint_of_set(s) for s in sets], pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, node, keys, fp])

    added = [StructField(node, LongType()), StructField(keys, ArrayType(LongType())), StructField(fp, LongType())]
    rows = write_through(df.mapInArrow(read, StructType(df.schema.fields + added)), "shingled")
    narrow = rows.select(F.col(id_col).alias("id"), F.col(node).alias("node"), F.col(keys).alias("keys"), F.col(fp).alias("fp"))
    roots = write_through(components(_links(rows, text_col, node, keys, fp, narrow, setting)), "near-copy-roots")
    several = narrow.groupBy("node").count().where("count > 1").select("node")
    open_ = write_through(roots.select("node").union(several).distinct(), "near-copy-nodes")
    bits = _map_of(open_, "node")
    asked = _marked(rows.drop(keys, fp), node, bits, True)
    ids = asked.select(F.col(id_col).alias("id"), F.col(node).alias("node")).join(roots, "node", "left")
    ids = ids.withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("id").isNull(), "id", "node")
    kept = ids.groupBy("root").agg(F.min(order).alias("_first")).select(F.col("_first.id").alias("_kept_id"), F.col("_first.node").alias("_kept_node"))
    chosen = asked.join(kept, asked[id_col].eqNullSafe(kept["_kept_id"]) & (asked[node] == kept["_kept_node"]), "left_semi")
    rest = _marked(rows.drop(keys, fp), node, bits, False)
    return rest.unionByName(chosen.dropDuplicates([id_col, node])).drop(node)


def _fingerprint_edges(narrow: DataFrame, distance: int) -> DataFrame:
    """(a, b): nodes connected as their fingerprints are. The nodes of one fingerprint are linked to their least."""
    prints = narrow.where(F.size("keys") > 0).select("fp", "node")  # an empty set is near no other
    least = write_through(prints.groupBy("fp").agg(F.min("node").alias("a"), F.max("node").alias("most")), "near-copy-prints")
    same = prints.join(least.where("a <> most").drop("most"), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    first, second = (least.select(F.col("fp").alias(f"{n}_fp"), F.col("a").alias(n)) for n in ("one", "two"))
    close = simhash.links(least.select("fp"), distance).join(first, F.col("a") == F.col("one_fp")).join(second, F.col("b") == F.col("two_fp"))
    return same.unionByName(close.select(F.col("one").alias("a"), F.col("two").alias("b")))


def _links(rows: DataFrame, text_col: str, node: str, keys: str, fp: str, narrow: DataFrame, setting: Setting) -> DataFrame:
    """(a, b): a forest over nodes that connects exactly what candidates of the least Jaccard connect."""
    entries = narrow.select("node", F.explode("keys").alias("key"))
    low = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("key", "a")
    low = write_through(low, "near-copy-buckets")
    edges = entries.join(low, "key").where("a <> node").select("a", F.col("node").alias("b"))
    edges = edges.unionByName(_fingerprint_edges(narrow, setting.distance))
    near = write_through(components(edges), "near-copy-candidates")
    texts = rows.select(F.col(node).alias("node"), F.col(text_col).alias("text"), F.col(keys).alias("keys"), F.col(fp).alias("fp"))
    found = _marked(texts, "node", _map_of(near, "node"), True)
    found = found.join(near, "node").dropDuplicates(["node"]).select(F.col("root").alias("key"), "node", "keys", "fp", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            packed = [shingles(t, setting.shingle).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(packed, pa.binary())], names=["key", "node", "keys", "fp", "found"])

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        held = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ["key", "i", "j", "node", "fp"]}
        held["found"] = np.array([*map(_set, batch.column("found")), None], object)[:-1]
        held["keys"] = np.array(batch.column("keys").to_pylist(), np.int64).reshape(-1, setting.bands)
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.groups(slices(batches, _SETS), arrays):
            held, keys_of, prints = block["found"], block["keys"], block["fp"]
            sizes = np.array([len(s) for s in held])

            def linked(at: int, others: np.ndarray) -> np.ndarray:
                hit = np.minimum(sizes[at], sizes[others]) >= setting.least * np.maximum(sizes[at], sizes[others]) - 1e-9
                far = np.bitwise_count((prints[others[hit]] ^ prints[at]).view(np.uint64)) > setting.distance
                hit[hit] = ~far | (keys_of[others[hit]] == keys_of[at]).any(1)
                for part in np.array_split(np.flatnonzero(hit), 1 + int(sizes[others[hit]].sum()) // 1_000_000):
                    if len(part):
                        hit[part] = jaccard_linked(held[at], [held[x] for x in others[part]], setting.least)
                return hit

            edges = np.array(blocks.forest(len(held), linked), np.int64).reshape(-1, 2)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(block["node"][edges[:, 0]]), pa.array(block["node"][edges[:, 1]])], names=["a", "b"])

    packed = write_through(found.mapInArrow(sets, "key long, node long, keys array<long>, fp long, found binary"), "near-copy-sets")
    return blocks.in_blocks(packed, "node", setting.cap).mapInArrow(run, "a long, b long")


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.uint64)
