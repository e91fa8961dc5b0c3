"""Near copies of the pipeline against the Jaccard of all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from riskspark.llm import nearcopies
from tests.llm.test_pairs import reach

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))} if words else set()


def near(a: set, b: set) -> bool:
    return len(a & b) >= 0.8 * len(a | b)


def kept_ids(texts: dict[int, str]) -> set[int]:
    sets, ids = {i: plain_shingles(t) for i, t in texts.items()}, sorted(texts)
    least = reach(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if near(sets[a], sets[b])])
    return {i for i in ids if least[i] == i}


def made(seed: int, groups: int, copies: int) -> dict[int, str]:
    """Groups of texts with one to six replaced words, on both sides of the bound."""
    rng, out = random.Random(seed), {}
    for group in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(copies):
            text = list(words)
            for _ in range(rng.randrange(7)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            out[len(out)] = " ".join(text)
    return out


def test_stage_drops_what_the_fingerprints_cannot_reach(spark):
    words = [f"w{n}" for n in range(200)]
    other = [f"{w}x" if n in (50, 120, 190) else w for n, w in enumerate(words)]
    assert near(plain_shingles(" ".join(words)), plain_shingles(" ".join(other)))
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, " ".join(other), "en", "s", 1)], SCHEMA)
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect()] == [1]


@pytest.mark.parametrize("cap", [2, 256])
def test_brute_force(spark, cap):
    texts = made(3, 12, 12) | {1000: "", 1001: "  ", 1002: "a b", 1003: "A b"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    got = [r["doc_id"] for r in nearcopies.keep_one(docs, setting=nearcopies.Setting(cap=cap)).collect()]
    assert len(got) == len(set(got)) and set(got) == kept_ids(texts)


def test_fingerprints_propose_pairs(spark):
    """One band of 400 minima proposes nothing here, so the pair is found by its fingerprints."""
    words = [f"w{n}" for n in range(1000)]
    texts = {1: " ".join(words), 2: " ".join(words[:-1]) + " x", 3: " ".join(words[::-1]), 4: "", 5: "a b"}
    sets = [nearcopies.shingles(texts[i], 5) for i in (1, 2)]
    one, two = (nearcopies.simhash.fingerprint_of_set(s) for s in sets)
    setting = nearcopies.Setting(bands=1, rows=400)
    keys = [nearcopies.Bands(setting).keys(s)[0] for s in sets]
    assert (one ^ two).bit_count() <= 4 and keys[0] != keys[1]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    assert {r["doc_id"] for r in nearcopies.keep_one(docs, setting=setting).collect()} == {1, 3, 4, 5}
