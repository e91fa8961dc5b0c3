"""Byte-level BPE encoding and decoding in time linear in the text.

Bytes are mapped to Latin-1 characters, so that pyahocorasick can find the longest token that starts at a place of a piece. A token sequence is what the merges give exactly when every two neighbours are compatible (their own bytes,
merged alone, give the two tokens again). So the encoder takes the longest token, falls back to the next shorter prefix
token where the neighbours don't fit, and steps back where none is left; a place once left that way is never
entered again, which bounds the work by the text length. Compatibility is memoised per pair of tokens.

Null texts count as empty (no ids, empty bytes); rows with the same id are encoded one by one; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from riskspark.llm.common import id_text, slices

#: Entries that a worker's memo tables hold before they start afresh; the results don't depend on them. Several workers share an
#: executor, and each keeps its tables from task to task.
MEMO_ENTRIES = 150_000
EDGE_ENTRIES = 20_000
MEMO_CHARS = 48


class Codec:
    """Encoder and decoder for one rank file (base64 token, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(token) for token in self.tokens]
        self.reach = max(self.sizes)
        self.pattern = regex.compile(pattern)
        self._pieces = _Memo(self.encode_piece)
        self._fits: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[bytes, int]] | None] = {}
        self._shorter: dict[int, int] = {}

    @functools.cached_property
    def _automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for token, rank in self._latin.items():
            found.add_word(token, rank)
        found.make_automaton()
        return found

    @functools.cached_property
    def _latin(self) -> dict[str, int]:
        return {token.decode("latin-1"): rank for token, rank in self.ranks.items()}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges as defined, until ``least`` parts are left: the lowest rank first, leftmost among equals. For single tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        none = len(self.tokens)
        while len(parts) > least:
            ranks = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            rank = min(ranks)
            if rank == none:
                break
            at = ranks.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """What stands at one edge (0 left, 1 right) of the token while its merges run: (part, rank of the merge that ends it).

        None if the merges of its own bytes don't give the token.
        """
        key = (token, side)
        if key not in self._edges:
            data, found = self.tokens[token], []
            until = len(self.tokens)
            while len(data) > 1:
                found.append((data, until))
                halves, until = self.merged(data, 2), self.ranks[data]
                if len(halves) != 2:
                    found = None
                    break
                data = halves[side]
            if len(self._edges) >= EDGE_ENTRIES:
                self._edges.clear()
            self._edges[key] = None if found is None else [(data, until), *reversed(found)]
        return self._edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave two neighbours apart; left -1 stands for the start of the piece.

        Both sides' merges run in rank order; the two parts at the boundary must never have a merge of their own that comes
        before the one that ends either (of equal ranks the leftmost goes first).
        """
        key = left << 20 | right  # below 2**20 tokens; the start of the piece gives negative keys
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        y = self.edge(right, 0)
        if left < 0 or y is None:
            return y is not None
        x = self.edge(left, 1)
        if x is None:
            return False
        i = j = 0
        none = len(self.tokens)
        while True:
            (a, a_ends), (b, b_ends) = x[i], y[j]
            rank = self.ranks.get(a + b, none)
            if rank < a_ends and rank <= b_ends and rank < none:
                return False
            if a_ends == b_ends == none:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        known = self._shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self._shorter[token] = known
        return known

    @functools.cached_property
    def _starts(self) -> dict[str, int]:
        """For every beginning of a token the longest token that it starts with; every single byte is one."""
        found: dict[str, int] = {}
        for token in sorted(self._latin, key=len):
            for n in range(len(token), 0, -1):
                if token[:n] in found:
                    break
            longest = found[token[:n]] if token[:n] in found else self._latin[token[:1]]
            for k in range(n + 1, len(token)):
                found[token[:k]] = longest
            found[token] = self._latin[token]
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        latin = piece if piece.isascii() else piece.encode().decode("latin-1")
        whole = self._latin.get(latin)
        if whole is not None:
            return (whole,)
        n, sizes, reach, starts, longest_prefix = len(latin), self.sizes, self.reach, self._starts, self._automaton.longest_prefix
        known, fits = self._fits, self.fits
        out: list[int] = []
        left_behind: set[int] = set()
        at, last, token = 0, -1, starts[latin[: longest_prefix(latin[:reach])]]
        while at < n:
            while token >= 0:
                if not left_behind or at + sizes[token] not in left_behind:
                    fit = known.get(last << 20 | token)
                    if fits(last, token) if fit is None else fit:
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at += sizes[token]
                if at == n:
                    break
                last = token
                rest = latin[at:at + reach]
                token = starts[rest[: longest_prefix(rest)]]
            else:
                left_behind.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                token = self.shorter(token)
        return tuple(out)

    def encoded(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    @functools.cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array(self.sizes, np.int64)
        return np.frombuffer(b"".join(self.tokens), np.uint8), np.cumsum(sizes) - sizes, sizes

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of an array of ids: every output place looks its byte up in the tokens laid end to end."""
        flat, starts, sizes = self._flat
        lengths = sizes[ids]
        ahead = np.cumsum(lengths) - lengths
        return flat[np.arange(lengths.sum()) + np.repeat(starts[ids] - ahead, lengths)].tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return self.decoded(np.asarray(ids, np.int64))


class _Memo(dict):
    """Encoded pieces; a missing one is computed."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece

    def __missing__(self, piece: str) -> bytes:
        found = array("i", self.encode_piece(piece)).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = found
        return found


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encoded_rows(coder: Codec, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of a list of texts."""
    found = [coder.encoded(t) for t in texts]
    return np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32), np.frombuffer(b"".join(found), np.int32)


def _decoded_rows(coder: Codec, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.array([coder.decoded(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text; special tokens' strings are ordinary text."""
    narrow = id_text(df, id_col, text_col)
    out = StructType([narrow.schema["doc_id"], StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for part in slices(batches):
            offsets, ids = _encoded_rows(coder, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    return narrow.mapInArrow(run, out)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes that ``ids`` stand for; null ids count as none."""
    packed = df.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    out = StructType([packed.schema["doc_id"], StructField("data", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for part in slices(batches):
            lists = part.column(1)
            data = _decoded_rows(coder, lists.offsets.to_numpy(), lists.values.to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(0), data], names=["doc_id", "data"])

    return packed.mapInArrow(run, out)


def encode_and_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, data): the ids of each text and the bytes that these ids decode to, with one worker a task for both."""
    narrow = id_text(df, id_col, text_col)
    out = StructType([narrow.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("data", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for part in slices(batches):
            offsets, ids = _encoded_rows(coder, part.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, _decoded_rows(coder, offsets, ids)], names=["doc_id", "ids", "data"])

    return narrow.mapInArrow(run, out)
