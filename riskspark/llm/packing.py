"""Token ids packed into rows of equal length: best-fit-decreasing with a segment tree over free capacities.

Each text becomes token ids and an end mark; texts beyond the row length are cut into pieces without loss. A task packs its own
rows in cells of bounded size (``cell_tokens``, or one text if that is longer), so nothing is shuffled and a lost task builds the same
rows again. Within a cell pieces go, longest first, into the fullest row that still has room, found by descending the tree.

A packed row holds the ids (little-endian, 16 bits if the vocabulary fits, padded with the end mark), the cumulative lengths of its
segments, the places where positions start again, and for each segment its document and its offset in the document's ids.

Null and empty texts are the end mark alone; repeated rows are packed one by one; null ids stay null in ``doc_ids``; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskspark.llm.common import id_text

ROW = 2048
CELL_TOKENS = 4_000_000


class Capacities:
    """Open rows by free capacity: a segment tree whose nodes tell whether any capacity below them has a row."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = capacity + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) with the least capacity that is enough; the row is removed."""
        node = least + self.leaves
        if not self.some[node]:
            while node > 1 and not (node % 2 == 0 and self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.some[node] = 0
            while (node := node >> 1) and not (self.some[2 * node] or self.some[2 * node + 1]):
                self.some[node] = 0
        return capacity, row


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Pieces (by number) of each row; of pieces of equal size the earlier goes first."""
    rows: list[list[int]] = []
    free = Capacities(row)
    for piece in sorted(range(len(sizes)), key=lambda n: -sizes[n]):
        found = free.take(sizes[piece])
        if found is None:
            rows.append([piece])
            free.add(row - sizes[piece], len(rows) - 1)
        else:
            capacity, number = found
            rows[number].append(piece)
            free.add(capacity - sizes[piece], number)
    return rows


@functools.lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def pack(df: DataFrame, path: str, pattern: str, row: int = ROW, cell_tokens: int = CELL_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack_id, n_tokens, ids, cu_seqlens, resets, doc_ids, starts): one row per packed row, its end mark being the first free id."""
    if row < 1:
        raise ValueError("a packed row needs room for a token")
    narrow = id_text(df, id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = tokenizer(path, pattern)
        kind = np.dtype("<u2" if end < 1 << 16 else "<i4")
        part, cell = TaskContext.get().partitionId(), 0
        held: list[tuple[object, np.ndarray]] = []
        tokens = 0
        for batch in batches:
            for number in range(batch.num_rows):
                text = batch.column(1)[number].as_py()
                ids = np.append(encoding.encode_to_numpy(text, disallowed_special=()), end).astype(kind)
                held.append((batch.column(0)[number].as_py(), ids))
                tokens += len(ids)
                if tokens >= cell_tokens:
                    yield from packed_cell(held, row, end, kind, f"{part:06d}-{cell:06d}", schema)
                    held, tokens, cell = [], 0, cell + 1
        if held:
            yield from packed_cell(held, row, end, kind, f"{part:06d}-{cell:06d}", schema)

    columns = f"pack_id string, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<{id_type}>, starts array<int>"
    schema = to_arrow_schema(StructType.fromDDL(columns))
    return narrow.mapInArrow(run, columns)


def packed_cell(held: list[tuple[object, np.ndarray]], row: int, end: int, kind: np.dtype, name: str, schema: pa.Schema, at_a_time: int = 256) -> Iterator[pa.RecordBatch]:
    """The packed rows of the texts' ids (id, ids)."""
    pieces = [(doc, at, ids[at:at + row]) for doc, ids in held for at in range(0, len(ids), row)]
    rows = best_fit_decreasing([len(p[2]) for p in pieces], row)
    for first in range(0, len(rows), at_a_time):
        columns: list[list] = [[] for _ in range(7)]
        for number, inside in enumerate(rows[first:first + at_a_time], first):
            ends = np.cumsum([len(pieces[p][2]) for p in inside]).tolist()
            line = np.full(row, end, kind)
            line[: ends[-1]] = np.concatenate([pieces[p][2] for p in inside])
            values = (f"{name}-{number:06d}", ends[-1], line.tobytes(), [0, *ends], [0, *ends[:-1]], [pieces[p][0] for p in inside], [pieces[p][1] for p in inside])
            for column, value in zip(columns, values):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def position_ids(resets: list[int], row: int) -> np.ndarray:
    """Position of each place of a row since the last reset."""
    starts = np.zeros(row, np.int64)
    starts[resets] = resets
    return np.arange(row) - np.maximum.accumulate(starts)


def write(packed: DataFrame, path: str) -> None:
    """The matrix rows with their segment tables as Parquet; ids stay binary."""
    packed.write.mode("errorifexists").parquet(path)
