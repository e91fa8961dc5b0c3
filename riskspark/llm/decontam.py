"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

An item of L words is found in a document where some window of L words (the whole text if it is shorter) can be turned into it
by at most floor((1 - similarity) L) insertions, deletions and replacements of words. The CGK walk reads a window with a random
step per (position, word), so that few edits become few differing positions of the walk; each repetition samples positions
of its own walk and windows whose samples equal an item's are candidates. The number of repetitions is chosen for each item length: the least
that reaches the target recall on items of that length with as many random edits as are allowed, and half as many again. A length that
would need more than ``most_repetitions`` is searched exactly instead: its candidates are the items that share as many word pairs with the window as
the allowed edits must leave. Candidates are verified by their exact edit distance.

Before the walk, windows are dropped that cannot be within the bound: k edits destroy at most k words and 2 k pairs of neighbouring
words of an item, so a window needs L - k known words and all but 2 k of the different pairs that items of its length have. This drops no answer, at
any size of input.

Items come to the executors in blocks of ``ITEMS_AT_A_TIME``, one pass over the documents each; documents are never shuffled. Words
are runs of ASCII letters, digits and non-ASCII characters, lower-cased. Null and empty texts match nothing and empty items are never found; repeated rows
are searched one by one; an empty benchmark gives no rows. Texts are searched whole.
"""

from __future__ import annotations

import functools
import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import id_text, slices

ITEMS_AT_A_TIME = 20_000
SIMILARITY = 0.8
_SPLIT = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Setting:
    similarity: float = SIMILARITY
    samples: int = 4  # positions sampled in a repetition
    recall: float = 0.99  # to reach on edited items
    most_repetitions: int = 160  # a length that needs more is searched exactly
    trial_items: int = 8  # of a length, spread over its items
    trials: int = 32  # edited copies of each
    seed: int = 1


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def edits_allowed(length: int, similarity: float) -> int:
    return int((1 - similarity) * length + 1e-9)


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger; only the band that matters is computed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        now = [most + 1] * (len(b) + 1)
        if i <= most:
            now[0] = i
        for j in range(low, high + 1):
            now[j] = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, now[j - 1] + 1)
        if min(now[low - 1:high + 1]) > most:
            return most + 1
        last = now
    return min(last[-1], most + 1)


class Walks:
    """Sampled CGK walks of windows of one length; repetition r has its own random steps and sampled positions."""

    def __init__(self, length: int, repetitions: int, samples: int, seed: int):
        self.length = length
        reach = max(1, 7 * length // 4)  # a walk moves on at every second step, so it hasn't left the window by then
        self.salts = np.zeros((reach, repetitions), np.uint64)
        self.sampled = np.zeros((reach, repetitions), bool)
        for r in range(repetitions):  # the same walks whatever their number
            rng = np.random.default_rng([seed, length, r])
            self.salts[:, r] = rng.integers(1, 2**63, reach, np.uint64)
            self.sampled[rng.permutation(reach)[:samples], r] = True
        self.steps = int(np.flatnonzero(self.sampled.any(1))[-1]) + 1

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """One key per window (row of word numbers, padded with -1) and repetition."""
        held = np.concatenate([windows, np.full((len(windows), 1), -1, windows.dtype)], 1).astype(np.uint64)
        at = np.zeros((len(windows), self.salts.shape[1]), np.int64)
        out = np.zeros(at.shape, np.uint64)
        row = np.arange(len(windows))[:, None]
        for step in range(self.steps):
            word = held[row, at]
            here = self.sampled[step]
            if here.any():
                out[:, here] = (out[:, here] ^ (word[:, here] + np.uint64(1))) * _PRIME + self.salts[0, here]
            mixed = (word * _PRIME) ^ self.salts[step]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _PRIME
            at = np.minimum(at + (mixed >> np.uint64(63)).astype(np.int64), self.length)
        return out


class Index:
    """The items' words, pair filter and LSH keys; built on each executor from the items' texts."""

    def __init__(self, items: list[tuple[int, str]], repetitions: dict[int, int | None], setting: Setting):
        self.setting = setting
        found = [(item, words_of(text)) for item, text in items]
        self.numbers: dict[bytes, int] = {}
        self.items: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for item, words in found:
            if words:
                self.items[len(words)].append((item, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        self.lengths = sorted(self.items)
        # Which lengths have an item with a pair of neighbours: one bit a length (lengths may share one), 16 places or more a pair.
        self.bit = {n: np.uint64(1 << place % 64) for place, n in enumerate(self.lengths)}
        self.shift = np.uint64(64 - max(10, (16 * sum(len(w) for _, w in found)).bit_length()))
        self.filter = np.zeros(1 << 64 - int(self.shift), np.uint64)
        self.pairs_of: dict[int, int] = {}  # the least number of different places that an item of the length has
        for n in self.lengths:
            for _, numbers in self.items[n]:
                places = np.unique(self._pairs(np.array(numbers, np.int64)))
                self.filter[places] |= self.bit[n]
                self.pairs_of[n] = min(self.pairs_of.get(n, n), len(places))
        self.walks = {n: Walks(n, repetitions[n], setting.samples, setting.seed) for n in self.lengths if repetitions[n]}
        self.keys: dict[int, list[dict[int, list[int]]]] = {}
        for n, walks in self.walks.items():
            keys = walks.keys(np.array([w for _, w in self.items[n]], np.int64))
            by_repetition: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(repetitions[n])]
            for number, row in enumerate(keys.tolist()):
                for r, key in enumerate(row):
                    by_repetition[r][key].append(number)
            self.keys[n] = by_repetition
        # Lengths searched exactly: items by place of a pair, and how many different places each item has.
        self.holders: dict[int, dict[int, list[int]]] = {}
        self.places: dict[int, list[int]] = {}
        for n in self.lengths:
            if n not in self.walks:
                self.holders[n], self.places[n] = defaultdict(list), []
                for number, (_, numbers) in enumerate(self.items[n]):
                    places = np.unique(self._pairs(np.array(numbers, np.int64))).tolist()
                    self.places[n].append(len(places))
                    for place in places:
                        self.holders[n][place].append(number)

    def _candidates(self, n: int, windows: np.ndarray) -> Iterator[set[int]]:
        """For each window the items of length n that are to be compared with it."""
        if n in self.walks:
            for row in self.walks[n].keys(windows).tolist():
                yield {i for r, key in enumerate(row) for i in self.keys[n][r].get(key, ())}
            return
        k = self._edits(n)
        always = {i for i, places in enumerate(self.places[n]) if places - 2 * k <= 0}
        for pairs in self._pairs(windows).tolist():
            shared = Counter(i for place in set(pairs) for i in self.holders[n].get(place, ()))
            yield always | {i for i, count in shared.items() if count >= self.places[n][i] - 2 * k}

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, first word, words, distance): an item's closest window, the first among equals."""
        gap = self.lengths[-1] if self.lengths else 0
        tokens = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in tokens], np.int64)
        starts = np.cumsum(sizes + gap) - sizes - gap
        flat = np.zeros(int((sizes + gap).sum()) + gap + 1, np.int64)
        for at, words in zip(starts.tolist(), tokens):
            flat[at:at + len(words)] = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))
        known = np.cumsum(np.concatenate([[0], flat > 0]))
        lengths_of = np.zeros(len(flat), np.uint64)  # of items that have the pair starting here
        both = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0))
        place = self._pairs(flat[np.stack([both, both + 1], 1)])[:, 0]
        lengths_of[both] = self.filter[place]
        both, place = both[lengths_of[both] > 0], place[lengths_of[both] > 0]
        order = np.argsort(place, kind="stable")
        same_before = np.full(len(flat), -1)  # where the same pair stood last, so that a window counts it once
        again = place[order[1:]] == place[order[:-1]]
        same_before[both[order[1:][again]]] = both[order[:-1][again]]
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for longest, lengths in self._classes():
            few = min(max(0, self.pairs_of[n] - 2 * self._edits(n)) for n in lengths)
            pairs = np.cumsum(np.concatenate([[0], lengths_of & functools.reduce(np.bitwise_or, [self.bit[n] for n in lengths]) > 0]))
            dense = np.flatnonzero(pairs[longest:] - pairs[:-longest] >= few) if few else np.arange(len(flat) - longest)
            for n in lengths:
                k = self._edits(n)
                ok = dense[known[dense + n] - known[dense] >= n - k]
                if self.pairs_of[n] - 2 * k > 0 and len(ok):
                    inside = ok[:, None] + np.arange(n - 1)
                    ok = ok[((lengths_of[inside] & self.bit[n] > 0) & (same_before[inside] < ok[:, None])).sum(1) >= self.pairs_of[n] - 2 * k]
                if not len(ok):
                    continue
                owner = np.searchsorted(starts, ok, side="right") - 1
                place = ok - starts[owner]
                whole = (place + n <= sizes[owner]) | ((place == 0) & (sizes[owner] > 0))
                for at in range(0, int(whole.sum()), 2048):
                    self._verify(n, k, flat, ok[whole][at:at + 2048], owner[whole][at:at + 2048], place[whole][at:at + 2048], sizes, best)
        return [sorted((item, place, size, d) for item, (d, place, size) in b.items()) for b in best]

    def _verify(self, n: int, k: int, flat: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, sizes: np.ndarray, best: list) -> None:
        windows = flat[at[:, None] + np.arange(n)]
        windows[np.arange(n)[None, :] >= (sizes[owner] - place)[:, None]] = -1  # past the end of a short text
        for candidates, text, start, words in zip(self._candidates(n, windows), owner.tolist(), place.tolist(), windows.tolist()):
            size = min(n, int(sizes[text]) - start)
            for number in candidates:
                item, wanted = self.items[n][number]
                d = edit_distance(wanted, words[:size], k)
                if d <= k and (item not in best[text] or (d, start, size) < best[text][item]):
                    best[text][item] = (d, start, size)

    def _edits(self, n: int) -> int:
        return edits_allowed(n, self.setting.similarity)

    def _pairs(self, numbers: np.ndarray) -> np.ndarray:
        """Place in the filter of each two neighbours (along the last axis)."""
        a, b = numbers[..., :-1].astype(np.uint64), numbers[..., 1:].astype(np.uint64)
        return (((a * _MIX) ^ b) * _PRIME >> self.shift).astype(np.int64)

    def _classes(self) -> Iterator[tuple[int, list[int]]]:
        """Lengths in classes of a quarter's span, for a first look with one window for all of them."""
        left = self.lengths
        while left:
            held = [n for n in left if n <= left[0] * 1.25]
            yield held[-1], held
            left = left[len(held):]


def edited(words: list[int], edits: int, rng: random.Random) -> list[int]:
    """A window of the same length after ``edits`` random edits; what is lost or gained at its end is foreign (negative)."""
    out = list(words)
    for n in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.choice("rid")
        if kind == "i":
            out.insert(at, -2 - n)
        elif at < len(out):
            out[at:at + 1] = [] if kind == "d" and len(out) > 1 else [-2 - n]
    return (out + [-1000 - n for n in range(len(words))])[: len(words)]


def repetitions_needed(items: list[str], setting: Setting) -> dict[int, int | None]:
    """Repetitions for each item length, or None where it is to be searched exactly.

    Trials are edited copies of items of the length, spread over all of them; walks are added until the target recall is reached.
    """
    by_length: dict[int, list[list[int]]] = defaultdict(list)
    numbers: dict[bytes, int] = {}
    for text in items:
        words = words_of(text)
        by_length[len(words)].append([numbers.setdefault(w, len(numbers) + 1) for w in words])
    return {n: _repetitions(held, setting) for n, held in by_length.items() if n}


def _repetitions(items: list[list[int]], setting: Setting) -> int | None:
    n = len(items[0])
    k = edits_allowed(n, setting.similarity)
    rng = random.Random(setting.seed)
    chosen = items[:: max(1, len(items) // setting.trial_items)][: setting.trial_items]
    trials = [(words, t) for words in chosen for _ in range(setting.trials) if edit_distance(words, t := edited(words, k, rng), k) <= k]
    if not k or not trials:
        return 1
    walks = Walks(n, setting.most_repetitions, setting.samples, setting.seed)
    same = walks.keys(np.array([w for w, _ in trials], np.int64)) == walks.keys(np.array([t for _, t in trials], np.int64))
    reached = np.maximum.accumulate(same, axis=1).mean(0)
    needed = int(np.searchsorted(reached, setting.recall)) + 1
    needed += needed // 2
    return needed if needed <= setting.most_repetitions else None


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about ITEMS_AT_A_TIME of them at once."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    passes = -(-items.count() // ITEMS_AT_A_TIME)
    for number in range(passes):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        yield [(r["item_id"], r["text"]) for r in held.orderBy("item_id", "text").collect()]


def find(
    df: DataFrame, benchmark: DataFrame, setting: Setting = Setting(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance) of each item found in a document, at its closest window."""
    narrow = id_text(df, id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    names = ["item_id", "first_word", "n_words", "distance"]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), *[(n, pa.int32()) for n in names[1:]]]))

    def one_pass(items: list[tuple[int, str]]) -> DataFrame:
        repetitions = repetitions_needed([text for _, text in items], setting)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, repetitions, setting)
            for part in slices(batches):
                hits = index.search(part.column(1).to_pylist())
                kept = [n for n, h in enumerate(hits) if h]
                if kept:
                    rows = [[dict(zip(names, h)) for h in hits[n]] for n in kept]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(rows, kind)], names=["doc_id", "found"])

        columns = "array<struct<item_id: long, first_word: int, n_words: int, distance: int>>"
        return narrow.mapInArrow(run, f"doc_id {id_type}, found {columns}")

    found = [one_pass(items) for items in _blocks(benchmark, item_col, item_text_col)] or [one_pass([])]
    return functools.reduce(DataFrame.unionByName, found).select("doc_id", F.explode("found").alias("hit")).select("doc_id", "hit.*")


def clean(df: DataFrame, benchmark: DataFrame, setting: Setting = Setting(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, in which no item is found."""

    def one_pass(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        repetitions = repetitions_needed([text for _, text in items], setting)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, repetitions, setting)
            for part in slices(batches):
                yield part.filter(pa.array([not h for h in index.search([t or "" for t in part.column(text_col).to_pylist()])], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    return functools.reduce(one_pass, _blocks(benchmark, item_col, item_text_col), df)
