"""Quality classifier: regularised quadratic discriminant over statistics of a document.

``statistics`` turns a text into ``NAMES``: shares and means of characters, words and lines, each transformed (logit of a smoothed share, or
logarithm) so that a normal density fits. Words and lines are compared inside blocks of ``BLOCK``, so that length by itself
moves nothing. Each class gets its mean and covariance; a covariance is shrunk towards its diagonal by the oracle approximating
shrinkage of its correlation matrix, whose amount follows from the number of documents, and ``FLOOR`` keeps a statistic that never varies
from having no variance. The score is the posterior of class 1: the difference of the two log densities (Mahalanobis distances through Cholesky
factors that a task computes once) plus the log odds of the classes.

The texts are read once: the statistics are written as a narrow table, joined to the labels for the fit and scored from there. The fit uses
every labelled row outside its held-out fold, in sums of products that are added up per task and then per class; only these sums
come to the driver.

Null and empty texts have the statistics of zero counts and get a score as any other; repeated rows count and are scored one by one; of several labels of
a document the highest counts; without ``least`` labelled rows of both classes every score is the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import id_text, slices
from riskspark.session import write_through

THRESHOLD = 0.3
BLOCK = 64
#: Observations that smooth a share of characters, words and lines, and the least share told apart from none.
PRIOR = 60, 20, 5
LEAST = 0.002, 0.005, 0.02
FLOOR = 0.05  # least standard deviation of a statistic

NAMES = [
    "capitals", "letters", "digits", "loud", "marks", "commas", "ends", "ascii",  # characters
    "word_length", "word_spread", "bare_marks", "marked_ends",  # words
    "distinct", "again", "commonest",  # words inside blocks
    "line_words", "closed_lines", "repeated_lines",  # lines
]
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_MARKS = np.array([b < 128 and chr(b) in "#$%&*+/<=>@[\\]^_`{|}~" for b in range(256)])


def _share(part: float, whole: float, often: float, prior: float, least: float) -> float:
    """Logit of a share, kept ``least`` away from 0 and 1, however long the text, and smoothed by ``prior`` observations at a usual
    share, so that short texts are judged by what they show."""
    p = least + (1 - 2 * least) * (part + prior * often) / (whole + prior)
    return math.log(p / (1 - p))


def statistics(text: str) -> list[float]:
    """The values of NAMES."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = lambda which: int(counts[which].sum())
    printed, letters = len(data) - count(_SPACE), count(_LETTER)
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    mean = (lengths.sum() + 5 * PRIOR[1]) / (n + PRIOR[1])
    spread = (np.square(lengths - mean).sum() + 6 * PRIOR[1]) / (n + PRIOR[1])
    last = "".join([w[-1] for w in words])
    ends = last.count(".") + last.count("!") + last.count("?")
    plain = sum(map(str.isalpha, last)) + last.count(",") + ends
    bare = n - sum(any(map(str.isalnum, w)) for w in words)
    lowered = text.lower().split()
    distinct = commonest = 0
    for at in range(0, n, BLOCK):
        block = lowered[at:at + BLOCK]
        kinds = set(block)
        distinct += len(kinds)
        commonest += max(map(block.count, kinds)) if len(kinds) < len(block) else 1
    again = sum(map(str.__eq__, lowered[1:], lowered))
    lines = [x for x in text.split("\n") if x.strip()]
    kinds_of_lines = sum(len(set(lines[at:at + BLOCK])) for at in range(0, len(lines), BLOCK))
    closed = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines)
    by_char, by_word, by_line = (functools.partial(_share, prior=size, least=least) for size, least in zip(PRIOR, LEAST))
    return [
        by_char(count(_CAPITAL), letters, 0.02), by_char(letters, printed, 0.97), by_char(count(_DIGIT), printed, 0.01),
        by_char(int(counts[33] + counts[63]), printed, 0.002), by_char(count(_MARKS), printed, 0.002), by_word(int(counts[44]), n, 0.05),
        by_word(ends, n, 0.08), by_char(int(counts[128:].sum()), printed, 0.03),
        math.log(mean), 0.5 * math.log(spread), by_word(bare, n, 0.005), by_word(n - plain, n, 0.01),
        by_word(distinct, n, 0.9), by_word(again, n, 0.01), by_word(commonest, n, 0.06),
        math.log((n + 36) / (len(lines) + 1)), by_line(closed, len(lines), 0.95), by_line(len(lines) - kinds_of_lines, len(lines), 0.02),
    ]


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that the fit leaves out: crc32 of the id as text divides by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Fit:
    least: int = 40  # labelled rows of each class that a covariance needs
    floor: float = FLOOR


@dataclass(frozen=True)
class Model:
    """Mean and covariance of each class and its number of rows, or a constant score where there is nothing to learn from."""

    means: tuple[np.ndarray, ...] = ()
    covariances: tuple[np.ndarray, ...] = ()
    counts: tuple[int, ...] = ()
    constant: float | None = None

    @functools.cached_property
    def factors(self) -> list[np.ndarray]:
        """Cholesky factors of the covariances, computed once in a process."""
        return [np.linalg.cholesky(c) for c in self.covariances]

    def log_density(self, values: np.ndarray, label: int) -> np.ndarray:
        """Of each row, without the constant that both classes share."""
        factor = self.factors[label]
        z = np.linalg.solve(factor, (values - self.means[label]).T)
        return -0.5 * np.square(z).sum(0) - np.log(np.diag(factor)).sum()

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row of statistics."""
        if self.constant is not None:
            return np.full(len(values), self.constant)
        logit = self.log_density(values, 1) - self.log_density(values, 0) + math.log(self.counts[1] / self.counts[0])
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def shrunk(covariance: np.ndarray, n: int, floor: float) -> np.ndarray:
    """The covariance with its correlations shrunk towards none (oracle approximating shrinkage for n rows)."""
    p = len(covariance)
    deviation = np.sqrt(np.diag(covariance) + floor**2)
    correlation = covariance / np.outer(deviation, deviation)
    np.fill_diagonal(correlation, 1.0)
    square = float(np.square(correlation).sum())
    amount = ((1 - 2 / p) * square + p**2) / ((n + 1 - 2 / p) * max(square - p, 1e-12))
    correlation *= 1 - min(1.0, amount)
    np.fill_diagonal(correlation, 1.0)
    return correlation * np.outer(deviation, deviation)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, values): the statistics of each document."""
    narrow = id_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values = pa.array([statistics(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), values], names=["doc_id", "values"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema[0].dataType.simpleString()}, values array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("values").flatten()).reshape(batch.num_rows, len(NAMES))


def train(measured: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from the rows of ``measure`` that have a label outside the held-out fold."""
    marks = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    marks = marks.agg(F.max((F.col(label_col) != 0).cast("int")).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(NAMES)
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            values, label = _matrix(batch), np.asarray(batch.column("label"))
            for k in (0, 1):
                x = values[label == k]
                sums[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["label", "sums"])

    partial = measured.join(marks, "doc_id").select("label", "values").mapInArrow(run, "label int, sums array<double>")
    added = partial.select("label", F.posexplode("sums").alias("at", "part")).groupBy("label", "at").agg(F.sum("part").alias("total"))
    found = {(r["label"], r["at"]): r["total"] for r in added.collect()}  # two classes x (1 + d + d x d) sums
    d = len(NAMES)
    counts = tuple(int(found.get((k, 0), 0)) for k in (0, 1))
    if min(counts) < fit.least:
        return Model(constant=counts[1] / sum(counts) if sum(counts) else 0.5)
    total = np.array([[found[k, at] for at in range(1 + d + d * d)] for k in (0, 1)])
    means = tuple(total[k, 1:1 + d] / counts[k] for k in (0, 1))
    covariances = tuple(shrunk(total[k, 1 + d:].reshape(d, d) / counts[k] - np.outer(means[k], means[k]), counts[k], fit.floor) for k in (0, 1))
    return Model(means, covariances, counts)


def score(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of ``measure``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(model.scores(_matrix(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "score"])

    return measured.mapInArrow(run, f"doc_id {measured.schema['doc_id'].dataType.simpleString()}, score double")


def classify(df: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) of each document, with a model learnt from the labels; texts are read once."""
    measured = write_through(measure(df, id_col, text_col), "quality-statistics")
    return score(measured, train(measured, labels, fit, id_col, label_col))
