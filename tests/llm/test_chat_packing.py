"""Chat formatting round trips, and packing against its rules."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskspark.llm import chat, packing
from riskspark.llm.queries import ORACLES, QUERIES
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_chat_equals_its_sql(spark):
    ok, text = compare(spark, duck(SF), SF, "op7_chat", QUERIES, ORACLES)
    assert ok, text


def test_itq_equals_its_sql(spark):
    ok, text = compare(spark, duck(SF), SF, "op3_itq", QUERIES, ORACLES)
    assert ok, text


def test_chat_plan_is_native(spark):
    plan = QUERIES["op7_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def read(spark, done):
    return done.select("conv_id", "formatted", "loss_spans", "n_turns", "attachments", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_controls_anywhere_survive(spark):
    rng = random.Random(3)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "|", "\n", "é", "😀", "ok ", "<|", "[", "[/"]
    said = [(c, t, rng.choice(["user", "assistant", "sy\nstem", "a\\", "<|im_end|>"]), "".join(rng.choices(bits, k=rng.randrange(9)))) for c in range(40) for t in range(rng.randrange(1, 7))]
    got = {r["conv_id"]: r for r in read(spark, chat.format_conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")))}
    for conv in {s[0] for s in said}:
        turns = [(role, text) for c, _, role, text in sorted(said, key=lambda s: s[1]) if c == conv]
        row = got[conv]
        assert [(t["role"], t["text"]) for t in row["turns"]] == turns
        assert row["loss"] == [text for role, text in turns if role == "assistant"]
        data = row["formatted"].encode()
        for span in row["loss_spans"]:
            assert row["formatted"][span["start"]:span["end"]] == data[span["byte_start"]:span["byte_end"]].decode()


def test_chat_awkward(spark):
    rows = [(1, 0, "user", None), (1, 0, "assistant", "a"), (1, None, None, "first"), (1, 0, "assistant", "a"), (None, 5, "user", "nobody's"), (2, 1, "user", "long " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "2 as formatted", "3 as files")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read(spark, chat.format_conversations(df))}
    assert got == {1: [("", "first"), ("assistant", "a"), ("assistant", "a"), ("user", "")], None: [("user", "nobody's")], 2: [("user", "long " * 30_000)]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_parts_become_placeholders_in_order(spark):
    part = lambda **k: tuple(k.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [
        part(type="text", text="see <|image|> "), part(type="image", ref="a.png", width=57, height=28), part(type="audio", ref="b.wav", seconds=1.5),
        part(type="text", text=" and"), part(type="document", ref="c.pdf", pages=3), part(type="video", ref="d"), part(ref="e"), part(type="new", text="[INST]"),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = read(spark, chat.format_conversations(df, parts="parts", text=None))[0]
    assert row["turns"][0]["text"] == "see <|image|> <|image|><|audio|> and<|document|><|file|><|file|>[INST]"
    assert row["formatted"].count("<|image|>") == 1 and "<\\|image|>" in row["formatted"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("video", "d", 1), ("file", "e", 1)]
    assert row["turns"][1]["text"] == "" and row["loss"] == [""]


def unpacked(rows, end):
    """Ids of each document, put together from its segments."""
    found: dict = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"]:] == end).all()
        assert r["resets"] == r["cu_seqlens"][:-1] and len(r["doc_ids"]) == len(r["starts"]) == len(r["resets"])
        for a, b, doc, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
    return found


@pytest.mark.parametrize("row, cell", [(64, 500), (2048, 4_000_000)])
def test_packing_is_lossless(spark, row, cell):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(docs, PATH, public_tokenizers.PATTERN, row, cell).collect()
    encoding, end = packing.tokenizer(PATH, public_tokenizers.PATTERN)
    found = unpacked(packed, end)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(found) == set(texts) and len({r["pack_id"] for r in packed}) == len(packed)
    for doc, pieces in found.items():
        pieces.sort()
        ids = [x for _, piece in pieces for x in piece]
        assert ids == [*encoding.encode_ordinary(texts[doc]), end]
        assert [s for s, _ in pieces] == list(range(0, len(ids), row))
    tokens = sum(r["n_tokens"] for r in packed)
    if cell > 10_000:
        assert len(packed) <= 1.02 * tokens / row + 1


def test_packing_query(spark):
    assert QUERIES["op4_packing"](spark, SF).count() > 0


def plain_best_fit(sizes, row):
    free, rows = [], []
    for piece in sorted(range(len(sizes)), key=lambda n: -sizes[n]):
        fits = [n for n in range(len(rows)) if free[n] >= sizes[piece]]
        if fits:
            at = min(fits, key=lambda n: free[n])
            rows[at].append(piece)
            free[at] -= sizes[piece]
        else:
            rows.append([piece])
            free.append(row - sizes[piece])
    return sorted(free)


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(9)
    for _ in range(60):
        row = rng.randrange(1, 50)
        sizes = [rng.randrange(1, row + 1) for _ in range(rng.randrange(120))]
        rows = packing.best_fit_decreasing(sizes, row)
        assert sorted(p for r in rows for p in r) == list(range(len(sizes)))
        assert sorted(row - sum(sizes[p] for p in r) for r in rows) == plain_best_fit(sizes, row)


def test_packing_awkward(spark):
    rows = [(1, None), (2, ""), (3, "w " * 20_000), (4, "x"), (4, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as pack_id")
    packed = packing.pack(df.coalesce(1), PATH, public_tokenizers.PATTERN, 100, 1000).collect()
    found = unpacked(packed, 50256)
    assert found[1] == found[2] == [(0, [50256])] and len(found[4]) == 2 and len(found[None]) == 1
    assert packing.pack(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_position_resets():
    assert packing.position_ids([0, 3, 4], 7).tolist() == [0, 1, 2, 0, 0, 1, 2]


def test_written_rows_read_back(spark, tmp_path):
    packed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), PATH, public_tokenizers.PATTERN, 512)
    packing.write(packed, str(tmp_path / "packed"))
    digest = lambda df: sorted(hashlib.sha256(bytes(r["ids"])).hexdigest() for r in df.collect())
    assert digest(spark.read.parquet(str(tmp_path / "packed"))) == digest(packed)


def test_chat_visits_texts_and_parts_alike(spark):
    """A text goes through the visitor as one typed part; images, audio, documents and references are kept in order."""
    said = [(1, 0, "user", "look <|image|> [INST]"), (1, 1, "assistant", "fine"), (2, 0, "user", None)]
    plain = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    typed = spark.createDataFrame([(c, t, r, [{"type": "text", "text": x}]) for c, t, r, x in said], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    columns = ["conv_id", "formatted", "loss_spans", "attachments", "n_turns"]
    sorted_rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert sorted_rows(chat.format_conversations(plain)) == sorted_rows(chat.format_conversations(typed, parts="parts", text=None))
    parts = [
        {"type": "text", "text": "see"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "note", "text": "and", "ref": "n.txt"},
        {"type": "audio", "ref": "b.wav", "seconds": 1.01}, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "odd", "ref": "d"}, {"type": None, "text": "end"},
    ]
    df = spark.createDataFrame([(5, 0, "user", parts), (5, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = read(spark, chat.format_conversations(df, parts="parts", text=None))[0]
    assert "see<|image|>and<|file|><|audio|><|document|><|file|>end<|im_end|>" in row["formatted"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [
        ("image", "a.png", 3), ("file", "n.txt", 1), ("audio", "b.wav", 26), ("document", "c.pdf", 1024), ("odd", "d", 1)]
