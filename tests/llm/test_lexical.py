"""Lexical search against ranking every document, and the index's parts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from riskspark.llm import lexical
from riskspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, depth=10):
    """{item: [(doc_id, score)]} by scoring every document."""
    bags = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    documents, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        wanted = Counter(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for (doc, bag), n in zip(bags, sizes):
            if n:
                m = 100 - 75 + (75 * n * documents) // total
                s = sum(k * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, k in wanted.items() if t in bag)
                scored += [(doc, s)] if s > 0 else []
        best = sorted(scored, key=lambda p: (-p[1], p[0] is None, p[0] or 0))[:depth]
        if best:
            out[item] = best
    return out


def ranking(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        assert r["rank"] == len(out.setdefault(r["item_id"], [])) + 1
        out[r["item_id"]].append((r["doc_id"], r["score"]))
    return out


def corpus(rng, n):
    words = ["the", "of", "é", "straße", "x1", "20", "日本", *[f"w{k}" for k in range(60)]]
    odds = [40, 30, 5, 5, 5, 5, 3, *[60 / (k + 1) for k in range(60)]]
    mixed = lambda k: rng.choice([" ", ", ", "-", "\n", "_"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, odds, k=k))
    docs = [(i, mixed(rng.choice([0, 1, 2, 5, 5, 5, 5, 20, 20, 90]))) for i in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(0, n, 9)] + [(n + 100, None), (n + 101, ""), (n + 102, "... !"), (None, "the w3"), (n + 103, "w59 " * 30_000)]
    items = [(i, mixed(rng.choice([1, 3, 8, 30]))) for i in range(30)] + [(90, None), (91, ""), (92, "unseen words only"), (93, "THE the of of of w1"), (94, "É")]
    return docs, items


@pytest.mark.parametrize("postings, block, depth", [(1_000_000, 5000, 10), (40, 7, 10), (300, 5000, 1), (5, 1, 3)])
def test_equals_scoring_every_document(spark, monkeypatch, postings, block, depth):
    monkeypatch.setattr(lexical, "QUERIES_AT_A_TIME", block)
    docs, items = corpus(random.Random(postings), 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' as score", "1 as n", "2 as rank", "3 as query").repartition(3)
    asked = spark.createDataFrame(items + items[:2], "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as rank")
    assert ranking(lexical.search(df, asked, depth, shard_postings=postings)) == plain(docs, items, depth)


def test_shards_in_one_process():
    """Many small shards one after the other, where the places held so far are the next shard's bar."""
    rng = random.Random(3)
    for trial in range(20):
        vocabulary, size = 12, rng.randrange(1, 80)
        m = np.array([rng.choice([25, 25, 30, 60, 200]) for _ in range(size)], np.int64)
        bags = [{t: rng.choice([1, 1, 2, 9]) for t in rng.sample(range(vocabulary), rng.randrange(vocabulary))} for _ in range(size)]
        asked = [{t: rng.randrange(0, 5000) for t in rng.sample(range(vocabulary), rng.randrange(1, 6))} for _ in range(5)]
        flat = [p for q in asked for p in sorted(q.items())]
        packed = lexical.Queries(np.cumsum([0, *map(len, asked)]), np.array([t for t, _ in flat]), np.array([f for _, f in flat]))
        best = lexical.Best(packed, 4)
        for at in range(0, size, 7):
            part = bags[at:at + 7]
            array = lambda values: np.array(list(values), np.int64)
            shard = lexical.Shard(m[at:at + 7], array(map(len, part)), array(t for b in part for t in b), array(x for b in part for x in b.values()), vocabulary)
            for number, query in enumerate(asked):
                terms, factors = array(sorted(query)), array(query[t] for t in sorted(query))
                full = {d: sum(query[t] * lexical.impact(x, int(m[at + d])) for t, x in b.items() if t in query) for d, b in enumerate(part)}
                for level, most in zip(shard.m, shard.bounds(terms, factors)):
                    assert all(full[d] <= most for d in range(len(part)) if m[at + d] == level)
            best.search(shard, list(range(at, at + len(part))))
        for query, held in zip(asked, best.held):
            scored = [(sum(query[t] * lexical.impact(x, int(m[d])) for t, x in b.items() if t in query), d) for d, b in enumerate(bags)]
            assert held == sorted([p for p in scored if p[0] > 0], key=lambda p: (-p[0], p[1]))[:4]


def test_strata_below_the_bar_are_not_visited():
    n = 400
    m = np.arange(25, 25 + n)
    one = np.ones(n, np.int64)
    shard = lexical.Shard(m, one, np.zeros(n, np.int64), one, 1)
    visited = []
    whole = shard.scores
    shard.scores = lambda strata, *rest: (visited.extend(strata), whole(strata, *rest))[1]
    best = lexical.Best(lexical.Queries(np.array([0, 1]), np.array([0]), np.array([7])), 3)
    best.search(shard, list(range(n)))
    assert [d for _, d in best.held[0]] == [0, 1, 2] and len(visited) < 10


def test_sums_stay_exact():
    big = np.array([2**61, 3, 2**60, 1], np.int64)
    assert lexical._sums(np.array([0, 1, 0, 1]), big, 2).tolist() == [2**61 + 2**60, 4]
    assert lexical.normaliser(10**7, 3 * 10**10, 10**13) == 25 + 75 * 10**7 * 3 * 10**10 // 10**13


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking(lexical.search(docs.limit(0), items)) == {}
    assert lexical.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranking(lexical.search(docs, items.limit(0))) == {}
    assert lexical.search(docs.withColumn("doc_id", docs.doc_id.cast("string")), items).collect()[0]["doc_id"] == "1"


def test_query_over_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ranking(QUERIES["op12_lexical"](spark, SF)) == plain(docs, items)
