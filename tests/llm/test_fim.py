"""Fill-in-middle over frames: against plain string cutting, exact round trips, awkward rows."""

import hashlib
import random
import re

import pytest
import zstandard

from riskspark.llm import fim
from riskspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(doc_id, text, setting=fim.Setting(), unit="line"):
    """(n, form, prefix, middle, output) by cutting the whole string."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    hex_ = hashlib.sha256(f"{setting.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hex_[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= setting.rate:
        return n, "plain", None, None, text
    if h[3] % 100 < setting.spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def awkward():
    rng = random.Random(13)
    texts = ["".join(rng.choices("ab é\n😀<", k=rng.randrange(400))) for _ in range(80)]
    texts += [None, "", "\n", "\n\n", "one", "one\n", "a<P>b\nc", "x\n<S>", "<M>", "<", "<P", "a\r\nb", "é" * 70_000, "line\n" * 30_000, "x" * 200_000 + "\nend", "<P" * 50_000]
    return [(n if n % 17 else None, t) for n, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5])]


@pytest.mark.parametrize("unit, frame, setting", [("line", 64, fim.Setting()), ("line", 1 << 16, fim.Setting(seed=3, rate=60, spm=20)), ("char", 100, fim.Setting(seed=11)), ("char", 1, fim.Setting())])
def test_equals_plain_cutting(spark, unit, frame, setting):
    rows = [r for r in awkward() if frame >= 64 or len(r[1] or "") < 2000]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as form", "1 as n", "2 as frames", "3 as output")
    done = fim.transform(fim.store(df, unit, frame), setting, unit)
    found = fim.texts(done).collect()
    key = lambda r: tuple(map(str, r))
    wanted = [(i, *plain(i, t, setting, unit), t or "") for i, t in rows]
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_text"], r["restored_text"]) for r in found]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    by_digest = fim.digests(done).select("doc_id", "output_sha256", "restored_sha256").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(key, by_digest)) == sorted(key((i, sha(w[-1]), sha(t or ""))) for (i, t), w in zip(rows, (plain(i, t, setting, unit) for i, t in rows)))


def test_only_divided_frames_are_opened():
    text = "".join(f"line {n}\n" for n in range(20_000))
    frames, units, chars, packer = [], 0, 0, zstandard.ZstdCompressor()
    for part in fim.pieces(text.encode(), 1000):
        units += part.count(b"\n")
        chars += len(part)
        frames.append({"data": packer.compress(part), "units": units, "chars": chars})

    class Counting:
        opened = 0

        def decompress(self, data):
            self.opened += 1
            return zstandard.ZstdDecompressor().decompress(data)

    opener = Counting()
    reader = fim.Reader(frames, 20_000, "line", packer, opener)
    a, b = reader.locate(4321), reader.locate(15_000)
    parts = [reader.between(x, y) for x, y in (((0, 0, 0), a), (a, b), (b, (len(frames), 0, 0)))]
    assert opener.opened <= 6 < len(frames)
    joined = [b"".join(map(zstandard.ZstdDecompressor().decompress, p)).decode() for p in parts]
    lines = text.splitlines(keepends=True)
    assert joined == ["".join(lines[:4321]), "".join(lines[4321:15_000]), "".join(lines[15_000:])]
    assert sum(f["data"] in p for f in frames for p in parts) >= len(frames) - 2  # the others move as they are


def test_forms_rates_and_bad_arguments(spark):
    df = spark.range(400).selectExpr("id as doc_id", "concat('a\n', id, '\nb\n') as text")
    forms = [r["form"] for r in fim.transform(fim.store(df)).collect()]
    assert "plain" not in forms and 120 < forms.count("spm") < 280
    forms = [r["form"] for r in fim.transform(fim.store(df), fim.Setting(rate=30, spm=100)).collect()]
    assert set(forms) == {"plain", "spm"} and 70 < forms.count("spm") < 170
    assert fim.digests(fim.transform(fim.store(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        fim.store(df, unit="page")
    with pytest.raises(ValueError):
        list(fim.restored([zstandard.compress(b"no marks")], "psm", zstandard.ZstdDecompressor()))


def test_query_over_whole_table(spark):
    given = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op13_fim"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(given)
    for r in found:
        n, form, prefix, middle, output = plain(r["doc_id"], given[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((given[r["doc_id"]] or "").encode()).hexdigest()
