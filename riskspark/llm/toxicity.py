"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A sentence's probability is logistic in the weights of its words; a document's is the noisy-or of its sentences
(1 - product of 1 - p), so one bad sentence is enough and weights are learnt from document labels alone. The same
sentence scores then locate what makes a document toxic.

Length alone is no evidence. Sentences without a known feature have no part in the product; a base rate counts once a document instead.
Of the sentences below the threshold only the likeliest counts, so texts that each stay below it do so together, at any length.

Features of a word are the word itself and its beginnings of four to seven letters, which catches inflected forms. A bounded
sample of labelled documents (``Fit.documents`` per class, by a hash of the id) gives the vocabulary and the weights; classes count
by their true share. Documents of any length are sampled; ``Fit.pairs`` bounds what is learnt from by known features in sentences, in the
order of the hash, so that no length is left out. Everything else runs over all rows.

Null and empty texts are one sentence without words and score as one; repeated rows are scored one by one; without labels of both
classes the score is the share of toxic labels (0.5 without any).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import held_out, id_text, per_text, slices
from riskspark.session import write_through

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
MEMO_ENTRIES = 100_000  # words whose weight a task remembers
THRESHOLD = 0.3


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit."""

    documents: int = 4000  # sampled per class
    pairs: int = 4_000_000  # (sentence, known feature) per class; the document that reaches it is the last
    vocabulary: int = 1000
    least_documents: int = 3  # toxic ones that hold a feature
    least_ratio: float = 2.0  # of its rates in toxic and other documents; words of clean documents need no weight
    steps: int = 300
    rate: float = 0.1
    penalty: float = 1e-5


@dataclass(frozen=True)
class Model:
    """Weights by feature, the logit of a sentence without any, or a constant score where there is nothing to learn from.

    ``base`` is the logit of a document without known features; without it every sentence counts in the noisy-or.
    """

    weights: dict[str, float]
    bias: float
    constant: float | None = None
    base: float | None = None

    def scorer(self):
        """text -> (score, [(start, end, probability)] of sentences that have words)."""
        memo: dict[str, float] = {}

        def weight(word: str) -> float:
            found = memo.get(word)
            if found is None:
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                found = memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
            return found

        bare = _softplus(self.bias if self.base is None else self.base)
        strong = 0.0 if self.base is None else -math.log1p(-THRESHOLD)  # what a sentence at the threshold adds

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            if self.constant is not None:
                return self.constant, []
            total, likeliest, found = 0.0, 0.0, []
            for match in _SENTENCE.finditer(text):
                added = sum(map(weight, set(_WORD.findall(match.group().lower()))))
                if added > 0:
                    found.append((match.start(), match.end(), _sigmoid(self.bias + added)))
                if not added:
                    total += bare if self.base is None else 0.0
                elif (own := _softplus(self.bias + added)) >= strong:
                    total += own
                else:
                    likeliest = max(likeliest, own)
            if self.base is not None:
                total += likeliest + bare
            return 1 - math.exp(-(total or bare)), found

        return score


def features(word: str) -> set[str]:
    """A word, and its beginnings of four to seven letters where it goes on."""
    return {word, *[word[:n] + "*" for n in range(4, min(8, len(word)))]}


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def train(
    df: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """A model from documents with a label outside the held-out fold; of several labels of a document the highest counts.

    The sample is chosen among the labels, so texts are read once and only sampled ones move.
    """
    marks = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    marks = write_through(marks.agg(F.max((F.col(label_col) != 0).cast("int")).alias("toxic")), "toxicity-labels")
    counts = dict(marks.groupBy("toxic").count().collect())  # two rows
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if not counts.get(0) or not counts.get(1):
        return Model({}, 0.0, prior)
    chosen = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(fit.documents) for t in (0, 1)]
    sample = id_text(df, id_col, text_col).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most 2 x documents ids
    sample = write_through(sample.dropDuplicates(["doc_id"]), "toxicity-sample")
    words = per_text(
        sample.select(F.struct("doc_id", "toxic").alias("row"), "text"), lambda: lambda text: (sorted(_present(text)),), "found array<string>"
    )
    sizes = dict(sample.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return Model({}, 0.0, prior)
    seen = words.select("row.toxic", F.explode("found").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    rates = (F.col("bad") + 0.5) / (sizes[1] + 1.0), (F.col("good") + 0.5) / (sizes[0] + 1.0)
    ratio = rates[0] / rates[1]
    telling = seen.where((F.col("bad") >= fit.least_documents) & (ratio >= fit.least_ratio))
    kept = telling.orderBy((F.col("bad") * F.log(ratio)).desc(), "feature").limit(fit.vocabulary)
    vocabulary = sorted(r["feature"] for r in kept.select("feature").collect())  # bounded by fit.vocabulary
    if not vocabulary:
        return Model({}, 0.0, prior)
    encoded = write_through(_encode(sample, vocabulary), "toxicity-encoded")
    encoded = _within(encoded, fit.pairs).toPandas()  # at most 2 x documents rows, of 2 x pairs known features and two documents' own
    share = {t: counts[t] / int((encoded["toxic"] == t).sum()) for t in (0, 1)}
    return _noisy_or(encoded, vocabulary, share, fit)


def _within(encoded: DataFrame, pairs: int) -> DataFrame:
    """Of each class the first documents by hash until they hold so many pairs."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = encoded.select("doc_id", "toxic", F.size("at").cast("long").alias("n"))  # at most 2 x documents short rows
    kept = sized.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < pairs).select("doc_id")
    return encoded.join(F.broadcast(kept), "doc_id").orderBy("doc_id")


def _present(text: str) -> set[str]:
    return {f for word in set(_WORD.findall(text.lower())) for f in features(word)}


def _encode(sample: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, toxic, sentences, at, feature): number of sentences, and (sentence, feature number) of every known feature."""
    number = {f: n for n, f in enumerate(vocabulary)}

    def encode(text: str) -> tuple:
        sentences = _SENTENCE.findall(text)
        pairs = [(at, number[f]) for at, s in enumerate(sentences) for f in sorted(_present(s)) if f in number]
        return max(1, len(sentences)), [a for a, _ in pairs], [f for _, f in pairs]

    packed = sample.select(F.struct("doc_id", "toxic").alias("row"), "text")
    return per_text(packed, lambda: encode, "sentences int, at array<int>, feature array<int>").select("row.doc_id", "row.toxic", "sentences", "at", "feature")


def _noisy_or(data, vocabulary: list[str], share: dict[int, float], fit: Fit) -> Model:
    """Gradient descent on the documents' log loss.

    With S = softplus(base) + sum of softplus(z) over a document's sentences with a known feature, its probability is 1 - exp(-S); the
    loss falls by p per unit of z in a clean document and grows by p exp(-S) / (1 - exp(-S)) in a toxic one, p being the sentence's probability.
    """
    y = data["toxic"].to_numpy(np.float64)
    n_sentences = data["sentences"].to_numpy(np.int64)
    doc = np.repeat(np.arange(len(data)), [len(a) for a in data["at"]])
    offsets = np.concatenate([[0], np.cumsum(n_sentences)[:-1]])
    whole = np.concatenate([np.asarray(a, np.int64) for a in data["at"]]) + offsets[doc]
    feature = np.concatenate([np.asarray(a, np.int64) for a in data["feature"]])
    sentences, row = np.unique(whole, return_inverse=True)  # those with a known feature
    owner = np.searchsorted(np.cumsum(n_sentences), sentences, side="right")
    weight = np.where(y > 0, share[1], share[0])
    weight /= weight.sum()
    w, b, base = np.zeros(len(vocabulary)), -6.0, -6.0
    moments = [np.zeros(len(w) + 2), np.zeros(len(w) + 2)]
    for step in range(1, fit.steps + 1):
        z = np.clip(b + np.bincount(row, w[feature], len(sentences)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        total = np.bincount(owner, np.log1p(np.exp(z)), len(y)) + _softplus(base)
        pull = weight * np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-9), 1.0)
        by_sentence = pull[owner] * p
        gradient = np.append(np.bincount(feature, by_sentence[row], len(w)) + fit.penalty * w, [by_sentence.sum(), pull.sum() * _sigmoid(base)])
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = fit.rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, b, base = w - move[:-2], min(b - move[-2], 5.0), min(base - move[-1], 5.0)
    return Model({f: float(x) for f, x in zip(vocabulary, w)}, float(b), base=float(base))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", locate: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, offending): the document's probability and the sentences of at least ``locate``, as code-point ranges."""

    def make():
        scored = model.scorer()

        def one(text: str) -> tuple:
            value, sentences = scored(text)
            return value, [{"start": a, "end": b, "score": p} for a, b, p in sentences if p >= locate]

        return one

    return per_text(id_text(df, id_col, text_col), make, "score double, offending array<struct<start: int, end: int, score: double>>")


def clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score stays below the threshold. A null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = model.scorer()
        for part in slices(batches):
            texts = part.column(text_col).to_pylist()
            yield part.filter(pa.array([scored(t or "")[0] < threshold for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)
