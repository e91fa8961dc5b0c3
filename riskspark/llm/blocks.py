"""Comparing the members of index buckets in blocks of bounded size.

A bucket with more members than ``cap`` is cut into chunks by a hash of the member, and every pair of chunks becomes a block of
its own, so that no task holds more than two chunks and every pair of members still meets exactly once. What leaves a
block is linear in its size (a spanning forest, sums per member), never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import write_through

#: Members of a chunk, as a mean.
CAP = 1024
KEYS = ["key", "i", "j"]


def in_blocks(entries: DataFrame, member: str, cap: int = CAP) -> DataFrame:
    """``entries`` (key, member, ...) with block numbers ``i <= j`` and ``left`` (in chunk i), dealt and sorted by block."""
    large = entries.groupBy("key").count().where(F.col("count") > cap)
    # Written first, so that the planner knows the size: a short list is joined without moving the entries.
    parts = write_through(large.select("key", F.ceil(F.col("count") / cap).cast("int").alias("parts")), "large-buckets")
    split = entries.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("chunk", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    split = split.withColumn("left", F.col("chunk") == F.col("i")).drop("parts", "chunk", "other")
    return split.repartition(*KEYS).sortWithinPartitions(*KEYS)


def groups(batches: Iterator[pa.RecordBatch], arrays: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of two members or more from batches sorted by block; a block may go over several batches."""
    rest: dict[str, np.ndarray] = {}

    def cut(held: dict[str, np.ndarray], last: bool) -> Iterator[dict[str, np.ndarray]]:
        n = len(held["key"])
        new = np.zeros(n, bool)
        for name in KEYS:
            new[1:] |= held[name][1:] != held[name][:-1]
        starts = np.concatenate([[0], np.flatnonzero(new), [n]])
        if not last:
            rest.update({name: v[starts[-2]:] for name, v in held.items()})
            starts = starts[:-1]
        for at in np.flatnonzero(np.diff(starts) > 1):
            yield {name: v[starts[at]:starts[at + 1]] for name, v in held.items()}

    for batch in batches:
        if batch.num_rows:
            now = arrays(batch)
            held = {name: np.concatenate([rest[name], now[name]]) if rest else now[name] for name in now}
            yield from cut(held, last=False)
    if rest:
        yield from cut(dict(rest), last=True)


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges (root, member) that connect what the links connect.

    A breadth-first search that only looks at members not reached yet, so a dense block costs a few passes, not all pairs.
    """
    edges: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left):
        root, left = int(left[0]), left[1:]
        open_ = [root]
        while open_ and len(left):
            hit = linked(open_.pop(), left)
            if hit.any():
                reached = left[hit].tolist()
                left = left[~hit]
                edges += [(root, x) for x in reached]
                open_ += reached
    return edges
