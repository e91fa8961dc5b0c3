"""Each stage of the pipeline against what its operator says about the stage's own input."""

from __future__ import annotations

import corpus_pipeline
from riskspark.llm import secrets
from riskspark.llm.queries import QUERIES
from tests.llm.test_digests import LIBRARY, digest
from tests.llm.test_nearcopies import kept_ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_through(stage(spark, docs, SF), f"test-{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "toxicity":
            assert set(after) == {i for i in before if not scores[i]}
        elif name == "simhash":
            assert set(after) == kept_ids({i: r["text"] or "" for i, r in before.items()})
        elif name == "decontamination":
            leaks = {r["doc_id"] for r in QUERIES["op5_decontamination"](spark, SF).collect()}
            assert set(after) == set(before) - leaks
        elif name == "secrets":
            assert {i: r["text"] for i, r in after.items()} == {i: secrets.mask(r["text"]) for i, r in before.items()}
        else:
            for i, r in after.items():
                assert r["ids"] == LIBRARY.encode_ordinary(before[i]["text"]) and r["decoded_sha256"] == digest(before[i]["text"])
        if name != "bpe":
            assert docs.columns == columns
            assert all(after[i] == before[i] for i in after) or name == "secrets"
        before = after
    assert corpus_pipeline.run(spark, SF).count() == len(before)


def test_stages_on_awkward_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "token=abcdef12345 x", "de", None, 18), (5, "w " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_through(stage(spark, docs, SF), "test-awkward")
    assert {r["doc_id"] for r in docs.collect()} == {1, None, 5}
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
