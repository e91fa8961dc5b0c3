"""Language identification by cross-parsing against suffix automata of labelled text.

For each language a suffix automaton holds all substrings of a reference text. A document is parsed from left to right into
the longest phrases that occur in the reference (a character that never occurs is a phrase of its own); few phrases mean that the
language fits. The number of phrases times the logarithm of the reference's length, over the length parsed, estimates the
cross entropy in bits per character; the language with the least wins.

Texts are normalised (lower case, anything but letters a single space) and parsed whole, in segments of ``SEGMENT``
characters, each from its own start, so that many segments advance together through the automata's transition tables.

The references are a bounded sample of labelled documents: ``Fit.documents`` of each language by a hash of the id, cut
at ``Fit.characters``. Null texts and texts without a letter are ``und`` with score 0; ties go to the language first by name;
repeated rows are identified one by one; without labelled text everything is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import held_out, id_text, slices
from riskspark.session import write_through

UNKNOWN = "und"
SEGMENT = 512
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Fit:
    """Bounds of the references."""

    documents: int = 60
    characters: int = 20_000
    piece: int = 2_000  # of a document at most; where it begins follows from its id


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions by state; state 0 is the start, and every substring of the text is a path from it."""
    edges: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in edges[at]:
            edges[at][c] = new
            at = link[at]
        if at >= 0:
            to = edges[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(edges)
                edges.append(dict(edges[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                link[to] = link[new] = copy
                while at >= 0 and edges[at].get(c) == to:
                    edges[at][c] = copy
                    at = link[at]
        last = new
    return edges


@dataclass(frozen=True)
class Model:
    """Reference text by language."""

    references: dict[str, str]

    def parser(self) -> Parser:
        return Parser(self.references)


class Parser:
    """All languages' automata as one table: row = state, column = character, 0 where there is no way on."""

    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        alphabet = sorted({c for text in references.values() for c in text} | {" "})
        self.column = {c: n + 1 for n, c in enumerate(alphabet)}  # column 0: characters of no reference
        automata = [suffix_automaton(references[name]) for name in self.languages]
        self.table = np.zeros((1 + sum(map(len, automata)), len(alphabet) + 1), np.int32)
        self.start = np.zeros(len(automata), np.int64)
        self.bits = np.log2([max(2, len(references[name])) for name in self.languages])
        base = 1
        for number, edges in enumerate(automata):
            self.start[number] = base
            for state, ways in enumerate(edges):
                for c, to in ways.items():
                    self.table[base + state, self.column[c]] = base + to
            base += len(edges)
        top = max((ord(c) for c in alphabet), default=0) + 1
        self.of_code = np.zeros(top + 1, np.int32)
        for c, column in self.column.items():
            self.of_code[ord(c)] = column

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each (normalised) text for each language, whole texts in segments parsed side by side."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        counts = [-(-len(c) // SEGMENT) for c in codes]
        owner = np.repeat(np.arange(len(texts)), counts)
        if not len(owner):
            return np.zeros((len(texts), len(self.languages)))
        lengths = np.concatenate([np.minimum(SEGMENT, len(c) - SEGMENT * np.arange(n)) for c, n in zip(codes, counts)])
        grid = np.zeros((len(owner), SEGMENT), np.int32)
        at = 0
        for c, n in zip(codes, counts):
            if n:
                padded = np.zeros(n * SEGMENT, np.int32)
                padded[: len(c)] = self.of_code[np.minimum(c, len(self.of_code) - 1)]
                grid[at:at + n] = padded.reshape(n, SEGMENT)
                at += n
        order = np.argsort(-lengths, kind="stable")
        steps, lengths, owner = np.ascontiguousarray(grid[order].T), lengths[order], owner[order]
        state = np.repeat(self.start[:, None], len(owner), 1)
        found = np.zeros(state.shape, np.int64)
        open_ = len(owner)
        start, table = self.start[:, None], self.table.ravel()
        width = self.table.shape[1]
        for step in range(SEGMENT):
            while open_ and lengths[open_ - 1] <= step:
                open_ -= 1
            if not open_:
                break
            column = steps[step, :open_]
            now = state[:, :open_]
            to = table[now * width + column]
            ended = to == 0
            again = table[start * width + column]  # a new phrase begins with this character, if the language has it
            found[:, :open_] += ended
            found[:, :open_] += ended & (again == 0) & (now != start)  # besides the phrase that ends, an unknown character is one itself
            state[:, :open_] = np.where(ended, np.where(again == 0, start, again), to)
        found += state != start  # the phrase that the segment's end cuts off
        return np.stack([np.bincount(owner, row, len(texts)) for row in found], 1)

    def identify(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the runner-up's share of the two lowest estimates, 0.5 for a tie."""
        cleaned = [normal(t) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        estimate = self.phrases(cleaned) * self.bits
        out = []
        for text, row in zip(cleaned, estimate):
            if not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmin(row))
            rest = float(np.min(np.delete(row, best))) if len(row) > 1 else float(row[best])
            out.append((self.languages[best], rest / (rest + float(row[best])) if rest else 1.0))
        return out


def train(df: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """References from documents with a language outside the held-out fold.

    The rank per language is limited before the shuffle (a group limit per task), so a language with most rows stays cheap;
    only ids are ranked, and at most ``documents`` pieces a language come to the driver. Documents of any length take part.
    """
    known = df.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    rows = known.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.lit(11)).alias("_order"))
    ranked = Window.partitionBy("lang").orderBy("_order", "doc_id")
    chosen = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= fit.documents).select("doc_id", "lang").distinct()
    chosen = write_through(chosen, "language-sample")
    begin = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - fit.piece, F.lit(0)) + 1) + 1
    pieces = id_text(known, id_col, text_col).join(F.broadcast(chosen), "doc_id").withColumn("text", F.col("text").substr(begin.cast("int"), F.lit(fit.piece)))
    texts = pieces.groupBy("lang", "doc_id").agg(F.max("text").alias("text"))
    references: dict[str, str] = {}
    for row in texts.orderBy("lang", "doc_id").collect():
        held = references.get(row["lang"], "")
        if len(held) < fit.characters and (text := normal(row["text"])):
            references[row["lang"]] = (held + " " + text if held else text)[: fit.characters]
    return Model(references)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each whole text."""
    narrow = id_text(df, id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model.parser()
        for part in slices(batches):
            found = parser.identify(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return narrow.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
