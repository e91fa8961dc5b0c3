"""Toxicity and language: accuracy on documents they haven't learnt from, definitions on small inputs, awkward rows."""

from __future__ import annotations

import math
import random
import zlib

import pytest

from riskspark.llm import langid, toxicity
from riskspark.llm.common import held_out
from riskspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def fold(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_fold(spark):
    rows = spark.range(200).select("id", held_out("id").alias("held")).collect()
    assert all(r["held"] == fold(r["id"]) for r in rows)


def test_toxicity_on_held_out_documents(spark):
    scored = QUERIES["op2_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rows = scored.select("score", "predicted", "toxic").collect()
    good = [r["score"] for r in rows if not r["toxic"]]
    bad = [r["score"] for r in rows if r["toxic"]]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc > 0.95
    assert sum(r["predicted"] for r in rows if r["toxic"]) / len(bad) > 0.85
    assert sum(r["predicted"] for r in rows if not r["toxic"]) / len(good) < 0.03


def toxic_corpus(spark, n=600):
    rng = random.Random(1)
    words = ["".join(rng.choices("abdeilmnorstu", k=rng.randrange(3, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randrange(1, 6))]
        bad = rng.random() < 0.3
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["zounds", "vexmore", "vexling"])
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_offending_sentences_are_located(spark):
    docs, labels, df, marks = toxic_corpus(spark)
    model = toxicity.train(df, marks)
    texts, truth = dict(docs), dict(labels)
    for row in toxicity.score(df, model).collect():
        assert 0 <= row["score"] <= 1 and (row["score"] >= 0.3) == bool(truth[row["doc_id"]])
        found = [texts[row["doc_id"]][s["start"]:s["end"]] for s in row["offending"]]
        assert len(found) == truth[row["doc_id"]] and all("vex" in s or "zounds" in s for s in found)
    kept = toxicity.clean(df.selectExpr("*", "1 as score"), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {i for i, bad in labels if not bad}


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels, df, marks = toxic_corpus(spark, 300)
    flipped = spark.createDataFrame([(i, 1 - t if fold(i) else t) for i, t in labels], "doc_id long, toxic int")
    assert toxicity.train(df, marks) == toxicity.train(df, flipped)


def test_noisy_or_of_sentences():
    model = toxicity.Model({"bad": 5.0, "worse": 7.0}, -6.0)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    score, found = model.scorer()("A bad one. Nothing here! Worse and bad")
    ps = [sigmoid(-1.0), sigmoid(-6.0), sigmoid(6.0)]
    assert math.isclose(score, 1 - math.prod(1 - p for p in ps), rel_tol=1e-9)
    assert [(a, b) for a, b, _ in found] == [(0, 9), (24, 38)]


def test_toxicity_awkward(spark):
    rows = [(1, None), (2, ""), (3, "x. " * 40_000), (4, "you"), (4, "you"), (None, "you")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 as score", "4 as toxic")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks, expected in [(none, 0.5), (spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int"), 0.0)]:
        got = toxicity.score(df, toxicity.train(df, marks)).collect()
        assert len(got) == 6 and all(r["score"] == expected for r in got)
    marks = spark.createDataFrame([(1, 1), (1, 0), (3, None), (4, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.train(df, marks)).count() == 6
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), marks)).count() == 0


def test_language_on_held_out_documents(spark):
    found = QUERIES["op6_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_phrases(text: str, reference: str) -> int:
    """Longest matches by substring search, in segments."""
    count = 0
    for first in range(0, len(text), langid.SEGMENT):
        part, at = text[first:first + langid.SEGMENT], 0
        while at < len(part):
            n = 1
            while at + n < len(part) and part[at:at + n + 1] in reference:
                n += 1
            count += 1
            at += n
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(6)
    references = {name: "".join(rng.choices(letters, k=400)) for name, letters in [("a", "abc "), ("b", "bcd "), ("c", "aé")]}
    parser = langid.Parser(references)
    texts = ["".join(rng.choices("abcdé xß", weights=[4, 4, 4, 2, 1, 2, 1, 1], k=rng.randrange(1300))) for _ in range(40)] + ["", "x", "a" * 513]
    got = parser.phrases(texts)
    assert got.tolist() == [[plain_phrases(t, references[n]) for n in parser.languages] for t in texts]


def test_suffix_automaton_holds_exactly_the_substrings():
    text = "abcbcabbabcab"
    edges = langid.suffix_automaton(text)

    def holds(part: str) -> bool:
        at = 0
        for c in part:
            if c not in edges[at]:
                return False
            at = edges[at][c]
        return True

    rng = random.Random(1)
    for _ in range(500):
        part = "".join(rng.choices("abc", k=rng.randrange(6)))
        assert holds(part) == (part in text)


def test_language_awkward(spark):
    rows = [(i, "the quick brown fox jumps over it " * 3, "en") for i in range(20)] + [(100 + i, "der schnelle braune fuchs springt " * 3, "de") for i in range(20)]
    rows += [(900, None, "en"), (901, "12 34 !?", "de"), (902, "", None), (903, "the fox", None), (903, "the fox", None), (904, "schnelle fuchs " * 20_000, None), (None, "fuchs springt", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred")
    got = langid.identify(df, langid.train(df)).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows) and by[900] == by[901] == by[902] == ("und", 0.0)
    assert by[903][0] == "en" and by[904][0] == "de" and by[None][0] == "de"
    assert {r["lang_pred"] for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.train(df)).count() == 0
    few = langid.train(df, langid.Fit(documents=2, characters=50))
    assert all(len(r) <= 50 for r in few.references.values())


@pytest.mark.parametrize("word, expected", [("abc", {"abc"}), ("abcdef", {"abcdef", "abcd*", "abcde*"})])
def test_features(word, expected):
    assert toxicity.features(word) == expected


def test_language_of_long_documents_only(spark):
    """A language whose labelled texts are all very long is learnt too."""
    rows = [(i, "the quick brown fox jumps over it " * 3, "en") for i in range(30)] + [(100 + i, "pikku kettu hyppää aidan yli nopeasti " * 2000, "fi") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert set(model.references) == {"en", "fi"} and len(model.references["fi"]) > 2000
    asked = spark.createDataFrame([(1, "kettu hyppää nopeasti"), (2, "the fox jumps over")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, model).collect()} == {1: "fi", 2: "en"}
