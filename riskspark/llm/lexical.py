"""Ranked lexical search with a length-stratified index.

Documents fall into strata of equal length normaliser m. In a stratum postings are grouped by term and, in the term, by tf: all documents of such
a group get the same impact, which is computed once per (m, tf). The largest tf of a term bounds what the term can add in the stratum, and
the sum over a query's terms bounds the stratum: strata are visited from the highest bound down and the visit ends when the bound
falls below the score of the last place held. No document that could be ranked is left out, so results are exact.

How it runs: one pass over the texts writes each document's length and its counts of query terms (narrow; texts are never shuffled). Three
aggregates of that table give N, L and every term's df. A second pass reads the table in shards of bounded size inside each task, builds the
stratified index of a shard and keeps the best ``depth`` documents of each query, with the places held so far as the next shard's bar. A task
emits at most queries x depth rows, and these are ranked in two steps, by (query, part) and by query. Queries come in blocks of
``QUERIES_AT_A_TIME`` that also hold at most ``TERMS_AT_A_TIME`` terms (a single longer query is a block of its own).

Null and empty texts have no terms: they count neither in N nor in L and are never ranked. Ties are ranked by ascending id, a null id last.
Repeated rows are documents of their own. Repeated rows of a query are ranked once; one query id with several texts gets a ranking for
each. A query without terms, or without a document that scores above 0, gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskspark.llm.common import id_text, per_text
from riskspark.session import write_through

QUERIES_AT_A_TIME = 5_000
TERMS_AT_A_TIME = 500_000
#: Postings in a shard's index; the document that reaches the number is its last.
SHARD_POSTINGS = 1_000_000
#: Parts in which a query's candidates are ranked first.
PARTS = 32
#: ASCII letters and digits and all bytes of other characters stay, A-Z become lower case, the rest divides terms.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_SPLIT).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def normaliser(n: int, documents: int, total: int) -> int:
    """m of a length, in integers that don't overflow."""
    return 25 + (75 * n * documents) // total


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Queries:
    """A block of queries as (term number, factor) pairs, factor being weight times occurrences in the query."""

    starts: np.ndarray  # of each query's pairs, and their end
    terms: np.ndarray
    factors: np.ndarray


class Shard:
    """The stratified index of some documents: groups (stratum, term, tf) of postings, in this order, highest tf first."""

    def __init__(self, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, vocabulary: int):
        self.m, stratum = np.unique(m, return_inverse=True)
        doc = np.repeat(np.arange(len(m)), sizes)
        at = stratum[doc].astype(np.int64)
        order = np.lexsort((doc, -tfs, terms, at))
        self.doc, tfs = doc[order], tfs[order]
        key = at[order] * vocabulary + terms[order]  # a list of postings of its own for each (stratum, term)
        pair, inverse = np.unique(np.stack([at[order], tfs]), axis=1, return_inverse=True) if len(key) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        self.impacts = impact(pair[1], self.m[pair[0]])[inverse.reshape(-1)]  # once for each (m, tf)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.keys, self.first = key[new], new
        self.last = np.append(new[1:], len(key))
        # The same lists by term, for the bounds: in a list the first posting has the highest impact.
        self.list_stratum, list_term = self.keys // vocabulary, self.keys % vocabulary
        by_term = np.argsort(list_term, kind="stable")
        self.by_term, self.term_start = by_term, np.searchsorted(list_term[by_term], np.arange(vocabulary + 1))
        self.vocabulary = vocabulary

    def bounds(self, terms: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """What a document of each stratum can score at most."""
        lists = _ranges(self.term_start[terms], self.term_start[terms + 1])
        found = self.by_term[lists]
        most = np.repeat(factors, self.term_start[terms + 1] - self.term_start[terms]) * self.impacts[self.first[found]]
        return _sums(self.list_stratum[found], most, len(self.m))

    def scores(self, strata: np.ndarray, terms: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of these strata that hold a term."""
        wanted = (strata[:, None] * self.vocabulary + terms).reshape(-1)
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        held = self.keys[at] == wanted
        at, factor = at[held], np.tile(factors, len(strata))[held]
        places = _ranges(self.first[at], self.last[at])
        value = np.repeat(factor, self.last[at] - self.first[at]) * self.impacts[places]
        docs, inverse = np.unique(self.doc[places], return_inverse=True)
        return docs, _sums(inverse, value, len(docs))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0]-1, first[1]..last[1]-1, ..."""
    sizes = last - first
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit integers by place; through doubles only where these are exact."""
    if values.sum(dtype=np.float64) < 2**52:
        return np.bincount(at, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


class Best:
    """The places held for each query: (score, id), best first."""

    def __init__(self, queries: Queries, depth: int):
        self.queries, self.depth = queries, depth
        self.held: list[list[tuple[int, object]]] = [[] for _ in range(len(queries.starts) - 1)]

    def search(self, shard: Shard, ids: list) -> None:
        order = np.empty(len(ids), np.int64)  # of documents by id, a null one last
        order[sorted(range(len(ids)), key=lambda n: (ids[n] is None, 0 if ids[n] is None else ids[n]))] = np.arange(len(ids))
        for number, held in enumerate(self.held):
            pairs = slice(self.queries.starts[number], self.queries.starts[number + 1])
            terms, factors = self.queries.terms[pairs], self.queries.factors[pairs]
            bounds = shard.bounds(terms, factors)
            visits = np.argsort(-bounds, kind="stable")
            at, step = 0, 1
            while at < len(visits):
                bar = held[-1][0] if len(held) == self.depth else 1
                now = visits[at:at + step]
                now = now[bounds[now] >= bar]
                if not len(now):
                    break
                docs, scores = shard.scores(now, terms, factors)
                docs, scores = docs[scores >= bar], scores[scores >= bar]
                best = np.lexsort((order[docs], -scores))[:self.depth]
                held += [(int(scores[b]), ids[docs[b]]) for b in best]
                held.sort(key=lambda p: (-p[0], p[1] is None, 0 if p[1] is None else p[1]))
                del held[self.depth:]
                at, step = at + step, step * 2


def index(df: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: its number of terms, and how often it holds those of the vocabulary, by their number."""

    def make():
        number = {t: n for n, t in enumerate(vocabulary)}

        def one(text: str) -> tuple:
            words = terms_of(text)
            counts = Counter(map(number.get, words, repeat(-1)))
            counts.pop(-1, None)
            return len(words), list(counts.keys()), list(counts.values())

        return one

    return per_text(id_text(df, id_col, text_col), make, "n long, terms array<int>, tfs array<int>")


def _shards(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.Table]:
    """Rows in lots of about so many postings."""
    held, size = [], 0
    for batch in batches:
        ends = np.asarray(pc.list_value_length(batch.column("terms"))).cumsum()
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(batch.num_rows, int(np.searchsorted(ends, before + postings - size)) + 1)
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1]) - before
            at = end
            if size >= postings:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _best(written: DataFrame, queries: Queries, documents: int, total: int, vocabulary: int, depth: int, postings: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents of each query."""
    out = written.limit(0).selectExpr("cast(0 as int) as query", "doc_id", "cast(0 as long) as score").schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, depth)
        for lot in _shards(batches, postings):
            column = lambda name: lot.column(name).combine_chunks()
            sizes = np.asarray(pc.list_value_length(column("terms")), np.int64)
            flat = lambda name: np.asarray(column(name).flatten(), np.int64)
            lengths, which = np.unique(np.asarray(column("n")), return_inverse=True)
            m = np.array([normaliser(n, documents, total) for n in lengths.tolist()], np.int64)[which]
            best.search(Shard(m, sizes, flat("terms"), flat("tfs"), vocabulary), column("doc_id").to_pylist())
        rows = [(number, doc, score) for number, held in enumerate(best.held) for score, doc in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    return written.where(F.size("terms") > 0).mapInArrow(run, out)


def _ranked(found: DataFrame, depth: int) -> DataFrame:
    """The best of each query, first inside parts of its candidates."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parted = found.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    first = parted.withColumn("place", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("place") <= depth)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= depth)


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Queries as (id, occurrences of terms), so many at a time as fit a block; rows come to the driver one by one."""
    held, terms = [], 0
    for row in items.toLocalIterator():
        counts = Counter(terms_of(row["text"]))
        if held and (len(held) >= QUERIES_AT_A_TIME or terms + len(counts) > TERMS_AT_A_TIME):
            yield held
            held, terms = [], 0
        if counts:
            held.append((row["item_id"], counts))
            terms += len(counts)
    if held:
        yield held


def search(
    df: DataFrame, items: DataFrame, depth: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``depth`` best documents of each item that score above 0."""
    spark = df.sparkSession
    queries = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    id_types = f"item_id {queries.schema[0].dataType.simpleString()}, query int"
    results = [_search_block(df, block, depth, shard_postings, id_col, text_col, id_types) for block in _blocks(queries)]
    if not results:
        doc_type = df.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {queries.schema[0].dataType.simpleString()}, rank int, doc_id {doc_type}, score long")
    return functools.reduce(DataFrame.unionByName, results)


def _search_block(df: DataFrame, block: list[tuple[object, Counter]], depth: int, postings: int, id_col: str, text_col: str, id_types: str) -> DataFrame:
    spark = df.sparkSession
    vocabulary = sorted({t for _, counts in block for t in counts})  # at most TERMS_AT_A_TIME, or those of one query
    written = write_through(index(df, vocabulary, id_col, text_col), "lexical-index")
    documents, total = written.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = dict(written.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row per term of the block
    number = {t: n for n, t in enumerate(vocabulary)}
    weights = [weight(documents, frequency.get(n, 0)) for n in range(len(vocabulary))]
    pairs = [sorted((number[t], weights[number[t]] * times) for t, times in counts.items() if number[t] in frequency) for _, counts in block]
    flat = np.array([p for q in pairs for p in q], np.int64).reshape(-1, 2)
    packed = Queries(np.cumsum([0, *map(len, pairs)]), flat[:, 0], flat[:, 1])
    found = _best(written, packed, documents, max(total, 1), len(vocabulary), depth, postings)
    ids = spark.createDataFrame([(item, n) for n, (item, _) in enumerate(block)], id_types)  # QUERIES_AT_A_TIME rows
    return _ranked(found, depth).join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
