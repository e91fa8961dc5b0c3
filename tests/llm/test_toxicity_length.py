"""Toxicity of long texts: clean ones stay clean, and long labelled documents take part in the fit."""

from __future__ import annotations

import pytest

from riskspark.llm import toxicity
from tests.llm.test_models import SF, fold, toxic_corpus


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    score = model.scorer()
    rows = docs.join(labels, "doc_id").where("toxic is not null").orderBy("doc_id").select("doc_id", "text", "toxic").collect()
    held = [(r["text"] or "", r["toxic"]) for r in rows if fold(r["doc_id"])]
    clean = [t for t, bad in held if not bad and score(t)[0] < toxicity.THRESHOLD]
    return score, clean, [t for t, bad in held if bad and score(t)[0] >= toxicity.THRESHOLD]


@pytest.mark.parametrize("characters", [100_000, 1_000_000, 3_000_000])
def test_long_clean_texts_stay_clean(trained, characters):
    score, clean, bad = trained
    text, at = "", 0
    while len(text) < characters:
        text += clean[at % len(clean)] + "\n"
        at += 1
    assert score(text)[0] < toxicity.THRESHOLD
    assert score(f"{text}\n{bad[0]}")[0] >= toxicity.THRESHOLD


def test_long_documents_are_learnt_from(spark):
    docs, labels, _, marks = toxic_corpus(spark)
    df = spark.createDataFrame([(i, t + "\n" + "so it is. " * 6000) for i, t in docs], "doc_id long, text string")
    model = toxicity.train(df, marks)
    assert model.constant is None
    assert all((r["score"] >= 0.3) == bool(dict(labels)[r["doc_id"]]) for r in toxicity.score(df, model).select("doc_id", "score").collect())


def test_the_bound_on_pairs_takes_documents_of_any_length(spark):
    docs, labels, df, marks = toxic_corpus(spark)
    few = toxicity.train(df, marks, toxicity.Fit(pairs=40))
    assert few.weights and few != toxicity.train(df, marks)
