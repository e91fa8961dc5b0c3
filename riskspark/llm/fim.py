"""Fill-in-middle transformation over seekable compressed frames.

``store`` keeps a text as independent Zstandard frames of at most ``FRAME`` bytes, each with the number of units (lines or code points) and
code points up to its end. ``transform`` looks the two cuts up in these counts and decompresses only the frames that a cut divides; all
other frames move to their new place as they are, so a whole text is never put together. Its output is again a list of frames whose
contents, in order, are the document's output. Digests and the restored text are streamed from the frames, one at a time.

The cuts are a function of seed and id alone, so a lost task repeats them. Every row is handled by itself, without a shuffle: repeated
rows get equal results, a null text counts as empty and has no frames, a null id is read as an empty one. Texts that hold a sentinel
stay as they are, as do empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import id_text, per_text

#: Bytes of text in a frame, at most.
FRAME = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: What follows what in the two rearranged forms; the text itself reads prefix, middle, suffix.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
FRAMES = "n long, marked boolean, frames array<struct<data: binary, units: long, chars: long>>"


@dataclass(frozen=True)
class Setting:
    seed: int = 7
    rate: int = 100  # of 100 texts so many are rearranged
    spm: int = 50  # of 100 rearranged texts so many put the suffix first


def _unit_ends(data: bytes, unit: str) -> np.ndarray:
    """Places in ``data`` behind the units that end in it."""
    codes = np.frombuffer(data, np.uint8)
    if unit == "line":
        return np.flatnonzero(codes == 10) + 1
    return np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(codes))[1:]


def _chars(data: bytes) -> int:
    """Code points that start in ``data``."""
    return int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum())


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most ``size`` bytes (a code point at least) that divide no code point."""
    at = 0
    while at < len(data):
        end = min(len(data), at + max(size, 4))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def store(df: DataFrame, unit: str = "line", frame: int = FRAME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, marked, frames): number of units, whether the text holds a sentinel, and frames with cumulative counts of units and code points.

    Units are lines (``[^\\n]*\\n|[^\\n]+``) or code points (``char``).
    """
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")

    def make():
        packer = zstandard.ZstdCompressor(level=3)

        def one(text: str) -> tuple:
            data, units, chars, out = text.encode(), 0, 0, []
            for part in pieces(data, frame):
                units += len(_unit_ends(part, unit))
                chars += _chars(part)
                out.append({"data": packer.compress(part), "units": units, "chars": chars})
            open_end = unit == "line" and len(data) > 0 and data[-1] != 10
            return units + open_end, any(s in data for s in (PREFIX, SUFFIX, MIDDLE)), out

        return one

    return per_text(id_text(df, id_col, text_col), make, FRAMES)


def cuts(doc_id: object, n: int, setting: Setting) -> tuple[int, int, bool, bool]:
    """(units before the middle, units up to its end, rearranged, suffix first)."""
    key = f"{setting.seed}:{'' if doc_id is None else doc_id}"
    h = [int(x, 16) for x in map("".join, zip(*[iter(hashlib.sha256(key.encode()).hexdigest()[:32])] * 8))]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return low, high, h[2] % 100 < setting.rate, h[3] % 100 < setting.spm


class Reader:
    """The frames of one stored text; decompresses those that a cut divides."""

    def __init__(self, frames: list[dict], n: int, unit: str, packer: zstandard.ZstdCompressor, opener: zstandard.ZstdDecompressor):
        self.frames, self.n, self.unit, self.packer, self.opener = frames, n, unit, packer, opener
        self.units = [f["units"] for f in frames]
        self.chars = [f["chars"] for f in frames]

    def locate(self, k: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) of the place behind the first k units."""
        if k >= self.n:
            return len(self.frames), 0, self.chars[-1] if self.frames else 0
        if k == 0:
            return 0, 0, 0
        at = int(np.searchsorted(self.units, k))
        data = self.opener.decompress(self.frames[at]["data"])
        place = int(_unit_ends(data, self.unit)[k - (self.units[at - 1] if at else 0) - 1])
        return at, place, (self.chars[at - 1] if at else 0) + _chars(data[:place])

    def between(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> list[bytes]:
        """Frames of what lies between two places; whole ones as they are."""
        out = []
        for at in range(a[0], min(b[0] + 1, len(self.frames))):
            first, last = a[1] if at == a[0] else 0, b[1] if at == b[0] else None
            if last == 0:
                continue
            whole = self.frames[at]["data"]
            if first or last is not None:
                part = self.opener.decompress(whole)[first:last]
                out += [self.packer.compress(part)] if part else []
            else:
                out.append(whole)
        return out


def transform(stored: DataFrame, setting: Setting = Setting(), unit: str = "line") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the form (plain, psm or spm), code points of prefix and middle (null if
    plain) and the output as Zstandard frames. ``stored`` comes from ``store`` with the same unit."""
    rows = stored.select(F.col("doc_id"), F.struct(F.col("doc_id").alias("id"), "n", "marked", "frames").alias("held"))

    def make():
        packer, opener = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        sentinel = {s: packer.compress(s) for s in (PREFIX, SUFFIX, MIDDLE)}

        def one(held: dict) -> tuple:
            frames, n = held["frames"], held["n"]
            low, high, rearranged, suffix_first = cuts(held["id"], n, setting)
            if not frames or held["marked"] or not rearranged:
                return n, "plain", None, None, [f["data"] for f in frames]
            reader = Reader(frames, n, unit, packer, opener)
            a, b = reader.locate(low), reader.locate(high)
            part = {PREFIX: reader.between((0, 0, 0), a), MIDDLE: reader.between(a, b), SUFFIX: reader.between(b, (len(frames), 0, 0))}
            form = "spm" if suffix_first else "psm"
            out = [f for mark in ORDERS[form] for f in [sentinel[mark], *part[mark]]]
            return n, form, a[2], b[2] - a[2], out

        return one

    return per_text(rows, make, "n long, form string, prefix_chars long, middle_chars long, output array<binary>")


def contents(frames: list[bytes], opener: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """What the frames hold, one frame at a time."""
    return map(opener.decompress, frames)


def _find(frames: list[bytes], mark: bytes, opener: zstandard.ZstdDecompressor) -> int:
    """The first place of ``mark`` in the frames' contents, also where it goes over frames."""
    before, tail = 0, b""
    for data in contents(frames, opener):
        at = (tail + data).find(mark)
        if at >= 0:
            return before - len(tail) + at
        before += len(data)
        tail = (tail + data)[-len(mark) + 1:]
    raise ValueError(f"no {mark!r} in this output")


def _range(frames: list[bytes], start: int, end: int | None, opener: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The contents' bytes from start to end (to the last one, if None)."""
    before = 0
    for data in contents(frames, opener):
        if end is not None and before >= end:
            return
        yield data[max(0, start - before):None if end is None else max(0, end - before)]
        before += len(data)


def restored(frames: list[bytes], form: str, opener: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The text behind an output, read from its sentinels; the first ones count, as prefix and suffix hold none."""
    if form == "plain":
        yield from contents(frames, opener)
        return
    starts = [_find(frames, mark, opener) for mark in ORDERS[form]]
    ends = [*starts[1:], None]
    place = {mark: (start + len(mark), end) for mark, start, end in zip(ORDERS[form], starts, ends)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from _range(frames, *place[mark], opener)


def _sha256(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _per_output(done: DataFrame, function, columns: str) -> DataFrame:
    rest = [c for c in done.columns if c != "output"]
    rows = done.select(F.struct(*rest).alias("row"), F.struct("output", "form").alias("held"))

    def make():
        opener = zstandard.ZstdDecompressor()
        return lambda held: function(held["output"], held["form"], opener)

    return per_text(rows, make, columns).select("row.*", *[f.split()[0] for f in columns.split(", ")])


def digests(done: DataFrame) -> DataFrame:
    """The rows of ``transform`` with output_sha256 and restored_sha256 in place of the frames; both are streamed."""
    made = lambda output, form, opener: (_sha256(contents(output, opener)), _sha256(restored(output, form, opener)))
    return _per_output(done, made, "output_sha256 string, restored_sha256 string")


def texts(done: DataFrame) -> DataFrame:
    """The rows of ``transform`` with output_text and restored_text in place of the frames."""
    made = lambda output, form, opener: (b"".join(contents(output, opener)).decode(), b"".join(restored(output, form, opener)).decode())
    return _per_output(done, made, "output_text string, restored_text string")
