"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most ``distance`` bits share at least
8 - distance of them: the guaranteed minimum. Postings of single bytes would grow with the square of the corpus, so the index
is keyed by small sets of positions with their bytes, chosen so that any guaranteed minimum of shared positions
contains one of the sets (twenty triples for distance 4). Inside a bucket the shared positional bytes of a pair are
tallied, pairs below the minimum dropped, and the rest verified by their differing bits.

Equal fingerprints are one entry of the index, whatever their number, so copies are never paired. Large buckets are split into
blocks (see ``blocks``). A null or empty text has fingerprint zero and links like any other; rows that repeat an id
are fingerprinted one by one; a null id takes part in links and never becomes a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskspark.llm import blocks
from riskspark.llm.common import id_text, per_text, slices
from riskspark.llm.components import components
from riskspark.session import write_through

SEED = 42
DISTANCE = 4
SHINGLE = 4
_BYTES = 8
_AT_A_TIME = 1 << 15  # shingles whose bits are in memory at once
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit integer.

    Words are runs without ASCII white space, A-Z lowered. Fewer words than a shingle: the whole sequence; none: zero.
    """
    words = text.encode().translate(_LOWER).split()  # splits bytes at \x20 and \x09-\x0d only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    pairs = zip(starts[:n].tolist(), ends[-n:].tolist())
    digest, view = xxhash.xxh64_digest, memoryview(line)
    sums = np.zeros(64, np.int64)
    for _ in range(0, n, _AT_A_TIME):
        part = b"".join([digest(view[a:b], SEED) for a, b in islice(pairs, _AT_A_TIME)])
        sums += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, _BYTES), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big", signed=True)


def fingerprint_of_set(found: np.ndarray) -> int:
    """Majority bits of a set of 64-bit hashes, each counted once, as a signed 64-bit integer; of none: zero."""
    sums = np.zeros(64, np.int64)
    for at in range(0, len(found), _AT_A_TIME):
        part = found[at:at + _AT_A_TIME].astype(">u8").view(np.uint8)
        sums += np.unpackbits(part.reshape(-1, _BYTES), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > len(found)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every whole text."""
    return per_text(id_text(df, id_col, text_col), lambda: lambda text: (fingerprint(text, shingle),), "fp long")


def position_sets(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that every ``8 - distance`` positions contain one of them; triples where that many are shared.

    For four shared positions: three groups of positions; triples inside a group, and two of a group with one of the next.
    Where more are shared, those triples serve as well.
    """
    shared = _BYTES - distance
    if shared < 4:
        return list(combinations(range(_BYTES), shared))
    group = [p % 3 for p in range(_BYTES)]

    def fits(triple: tuple[int, ...]) -> bool:
        count = [sum(group[p] == g for p in triple) for g in range(3)]
        return 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(_BYTES), 3) if fits(t)]


def links(prints: DataFrame, distance: int = DISTANCE, cap: int = blocks.CAP) -> DataFrame:
    """(a, b): a forest over the distinct values of ``fp`` that connects exactly what links of at most ``distance`` bits connect."""
    if not 0 <= distance < _BYTES:
        raise ValueError("distance must leave at least one of the eight bytes alike")
    byte = lambda p: F.shiftright("fp", 8 * (_BYTES - 1 - p)).bitwiseAND(F.lit(255))

    def key(number: int, positions: tuple[int, ...]):
        value = F.lit(number).cast("long")
        for p in positions:
            value = value * 256 + byte(p)
        return value

    keys = F.array(*[key(n, s) for n, s in enumerate(position_sets(distance))])
    entries = prints.select("fp").distinct().select(F.explode(keys).alias("key"), "fp")
    least = _BYTES - distance

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ["key", "i", "j", "fp"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks.groups(batches, arrays):
            fp = block["fp"]

            def linked(at: int, others: np.ndarray) -> np.ndarray:
                differing = fp[at] ^ fp[others]
                shared = (differing.view(np.uint8).reshape(-1, _BYTES) == 0).sum(1)
                found = shared >= least
                found[found] = np.bitwise_count(differing[found].view(np.uint64)) <= distance
                return found

            edges = np.array(blocks.forest(len(fp), linked), np.int64).reshape(-1, 2)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(fp[edges[:, 0]]), pa.array(fp[edges[:, 1]])], names=["a", "b"])

    return blocks.in_blocks(entries, "fp", cap).mapInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, cap: int = blocks.CAP
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links reach from each row's fingerprint."""
    prints = write_through(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    return prints.join(classes(prints, distance, cap), "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, cap: int = blocks.CAP) -> DataFrame:
    """One row of each class, with all its columns: the row with the smallest id (of several, the one with the smallest fingerprint).

    Rows are written once with their fingerprint, so texts are read and moved once for the decision and once for the result.
    """
    fp = "_fp"
    while fp in df.columns:
        fp += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = pa.array([fingerprint(t or "", shingle) for t in part.column(text_col).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, prints], names=[*part.schema.names, fp])

    rows = write_through(df.mapInArrow(run, StructType(df.schema.fields + [StructField(fp, LongType())])), "fingerprinted")
    prints = rows.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"))
    least = prints.join(classes(prints, distance, cap), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = least.groupBy("root").agg(F.min("fp").alias("_kept_fp"), F.first("component_id").alias("_kept_id"))
    found = rows.join(kept, rows[id_col].eqNullSafe(kept["_kept_id"]) & (rows[fp] == kept["_kept_fp"]), "left_semi")
    return found.dropDuplicates([id_col, fp]).drop(fp)


def classes(prints: DataFrame, distance: int = DISTANCE, cap: int = blocks.CAP) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of a written table (doc_id, fp); root tells classes apart."""
    nodes = write_through(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = components(links(nodes, distance, cap))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return nodes.join(ids, "root").select("fp", "root", "component_id")
