"""Near-duplicates, components and decontamination against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from riskspark.llm import blocks, decontam, itq, simhash
from riskspark.llm.components import components
from riskspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def reach(nodes, linked) -> dict:
    """Least node reachable, by repeated minima."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def plain_fingerprint(text: str, size: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two three", "a b c d", "A b c d e É f", "x " * 70_000, "tie tie", "b\x0bc\x0cd e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", range(8))
def test_every_guaranteed_minimum_holds_a_position_set(distance):
    from itertools import combinations

    sets = [set(s) for s in simhash.position_sets(distance)]
    assert all(any(s <= set(shared) for s in sets) for shared in combinations(range(8), 8 - distance))


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in rows}
    ids = sorted(prints)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= 4]
    least = reach(ids, linked)
    got = QUERIES["op1_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", least[i]) for i in ids}


@pytest.mark.parametrize("cap", [2, 7, 1024])
@pytest.mark.parametrize("distance", [1, 4, 5])
def test_links_in_split_blocks(spark, cap, distance):
    rng = random.Random(cap + distance)
    values = {rng.getrandbits(64) for _ in range(30)}
    for value in list(values)[:6]:  # dense clusters, so that buckets are split
        for _ in range(25):
            flipped = value
            for _ in range(rng.randrange(1, 6)):
                flipped ^= 1 << rng.randrange(64)
            values.add(flipped)
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    prints = spark.createDataFrame([(n, v) for n, v in enumerate(signed)], "doc_id long, fp long")
    expected = reach(signed, [(a, b) for n, a in enumerate(signed) for b in signed[n + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance])
    roots = {r["node"]: r["root"] for r in components(simhash.links(prints, distance, cap)).collect()}
    assert {v: roots.get(v, v) for v in signed} == expected


def test_near_duplicates_awkward(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "only null ids have this text"), (1, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (7, 7), (None, 7), (None, None), (1, 1)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, ""), (7, "a b c d e"), (None, "only null ids have this text"), (1, "w " * 50_000)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(5)
    linked = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    linked += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(50)]
    nodes = {x for pair in linked for x in pair}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    expected = reach(nodes, linked)
    assert {n: got.get(n, n) for n in nodes} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(1)
    near = rng.random((60, 60)) < 0.02
    near |= near.T
    edges = blocks.forest(60, lambda at, others: near[at, others])
    expected = reach(range(60), list(zip(*np.nonzero(near))))
    got = reach(range(60), edges)
    assert {n: got[n] for n in range(60)} == {n: int(expected[n]) for n in range(60)} and len(edges) == 60 - len(set(expected.values()))


def plain_itq(rows):
    good = []
    for number, (_, vector) in enumerate(rows):
        v = None if not vector or any(x is None for x in vector) else np.array(vector, float)
        if v is not None and np.isfinite(v).all() and v.any():
            good.append((number, v / np.linalg.norm(v)))
    linked = [(a, b) for n, (a, x) in enumerate(good) for b, y in good[n + 1:] if len(x) == len(y) and x @ y >= 0.9]
    return linked, reach(range(len(rows)), linked)


@pytest.mark.parametrize("cap", [4, 512])
def test_embedding_links(spark, cap):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.12 * rng.normal(size=24)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, None), (301, []), (302, [0.0] * 24), (303, [float("nan")] + [1.0] * 23), (304, [None] + [1.0] * 23), (305, rows[1][1][:20]), (306, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "1 as n")
    linked, least = plain_itq(rows)
    degree = [0] * len(rows)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in itq.near_duplicates(df, setting=itq.Setting(cap=cap, bits=8)).collect()}
    assert got == {rows[n][0]: (degree[n], rows[least[n]][0]) for n in range(len(rows))}


def test_embedding_recall_near_the_least_cosine(spark):
    """Pairs at cosines from 0.9 to 0.92, the hardest to retrieve."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        c = 0.9 + 0.02 * rng.random()
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert got / len(rows) >= 0.9


def test_embeddings_empty(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j - 1] + (x != y), last[j] + 1, now[-1] + 1))
        last = now
    return last[-1]


def plain_contamination(docs, items):
    found = set()
    for doc, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for item, wanted in items:
            wanted = re.findall(r"[^\W_]+", (wanted or "").lower())
            n = len(wanted)
            for at in range(max(1, len(words) - n + 1)) if n and words else ():
                if plain_distance(wanted, words[at:at + n]) <= int(0.2 * n + 1e-9):
                    found.add((doc, item))
                    break
    return found


def test_decontamination_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"]) < 1500]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(12).collect()]
    wanted = plain_contamination(docs, items)
    short = {d for d, _ in docs}
    chosen = {i for i, _ in items}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, SF).collect() if r["doc_id"] in short and r["item_id"] in chosen}
    assert got == wanted


def test_decontamination_of_edited_items(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(25)]
    docs = []
    for n in range(250):
        item, text = rng.choice(items)
        words = text.split()
        for _ in range(rng.randrange(len(words) // 5 + 2)):
            at = rng.randrange(len(words) + 1)
            words[at:at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
        docs.append((n, " ".join(rng.choices(vocabulary, k=rng.randrange(30)) + words + rng.choices(vocabulary, k=rng.randrange(30)))))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, "w1 " * 40_000 + items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as found")
    bench = spark.createDataFrame(items + [(98, None), (99, "")], "item_id long, text string")
    wanted = plain_contamination([d for d in docs if d[0] != 903], items) | {(903, 3)}
    got = decontam.find(frame, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] != 903} | {(903, r["item_id"]) for r in got if r["doc_id"] == 903 and r["item_id"] == 3}
    assert pairs <= wanted and len(pairs) >= 0.98 * len(wanted)
    kept = decontam.clean(frame, bench)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} >= {900, 901}
    assert not {r["doc_id"] for r in kept.collect()} & {902, 903}
    assert decontam.clean(frame, bench.limit(0)).count() == len(docs) and decontam.find(frame, bench.limit(0)).count() == 0
    assert decontam.find(frame.limit(0), bench).count() == 0


def test_benchmark_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_AT_A_TIME", 7)
    items = [(i, " ".join(f"{c}{i}" for c in "abcdefghij")) for i in range(30)]
    docs = spark.createDataFrame([(i, "x y " + t + " z") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find(docs, bench).collect()} == {(i, i, 0) for i, _ in items}
    assert decontam.clean(docs, bench).count() == 0


def filler(rng, n):
    return [f"f{rng.randrange(10**6)}" for _ in range(n)]


def test_recall_of_every_length():
    """Items of each length with as many edits as are allowed, some with words that repeat, also those far behind in the block."""
    rng = random.Random(2)
    common = [f"v{i}" for i in range(60)]
    lengths = [1, 4, 5, 10, 20, 30, 40, 50, 59, 80, 150, 400]
    items = [(n * 1000 + i, " ".join(rng.choices(common, k=n) if i % 4 == 0 else [f"u{rng.randrange(3000)}" for _ in range(n)])) for n in lengths for i in range(40)]
    rng.shuffle(items)
    setting = decontam.Setting()
    repetitions = decontam.repetitions_needed([t for _, t in items], setting)
    assert set(repetitions) == set(lengths) and repetitions[400] is None and repetitions[20]
    index = decontam.Index(items, repetitions, setting)
    texts, wanted = [], []
    for item, text in items:
        words = text.split()
        k = decontam.edits_allowed(len(words), setting.similarity)
        for _ in range(5):
            changed = decontam.edited(list(range(len(words))), k, rng)
            if decontam.edit_distance(list(range(len(words))), changed, k) <= k:
                window = [words[c] if c >= 0 else f"x{-c}y{rng.randrange(10**6)}" for c in changed]
                texts.append(" ".join(filler(rng, 15) + window + filler(rng, 15)))
                wanted.append((item, len(words)))
    hits = {n: [] for n in lengths}
    for (item, n), found in zip(wanted, index.search(texts)):
        hits[n].append(item in {f[0] for f in found})
    recall = {n: sum(h) / len(h) for n, h in hits.items() if h}
    assert len(recall) == len(lengths) and all(r >= 0.98 for r in recall.values()), recall
    assert sum(map(sum, hits.values())) / len(wanted) >= 0.99 and recall[400] == recall[150] == 1.0 or repetitions[150]
    exact = decontam.Index(items, dict.fromkeys(lengths), setting)  # all lengths searched exactly
    assert all(item in {f[0] for f in found} for (item, _), found in zip(wanted, exact.search(texts)))


def test_edit_distance_band():
    rng = random.Random(4)
    for _ in range(300):
        a, b = [rng.choices(range(4), k=rng.randrange(12)) for _ in range(2)]
        most = rng.randrange(6)
        assert decontam.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)
