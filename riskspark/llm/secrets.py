"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Patterns find assignments to secret-like names, access keys and long hex strings. The entropy part takes strings
of characters that keys are made of, slides a window over each, keeps counts per character incrementally (one in, one
out), and reports the whole string once a window reaches the entropy asked for its character class. The least entropies are the 1st
percentile of windows of random keys, so a key of one window is missed once in a hundred, a longer one far less often. An
allow-list suppresses entropy findings that are known to be harmless; pattern findings always stay.

Null texts count as empty; texts of any length are scanned whole; rows are independent, so repeated ids give repeated rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import id_text, per_text

Span = tuple[int, int, str]

KINDS = ["assign", "access", "hex", "entropy_base64", "entropy_hex", "entropy_alnum", "entropy_lower"]

_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class Entropy:
    """Window length and the bits per character that each class of characters must reach."""

    window: int = 20
    base64: float = 3.64
    alnum: float = 3.64
    lower: float = 3.4  # digits and letters of one case
    hex: float = 2.9


#: Harmless strings that look random: identifiers of the usual shapes, documented example keys, runs of the alphabet.
ALLOWED = [
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:[a-z0-9+/_=-]*example[a-z0-9+/_=-]*)",
    r"(?i:[a-z0-9+/_=-]*abcdefghijklmnop[a-z0-9+/_=-]*)",
    r"[A-Za-z0-9+/_=-]*0123456789[A-Za-z0-9+/_=-]*",
    r"[A-Za-z]+[0-9]{0,2}(?:[-_/=](?:[A-Za-z]+[0-9]{0,2}|[0-9]{1,8}))+",
    r"[A-Za-z]+",
    r"[0-9_=/+-]+",
]
_ALLOWED = re.compile("|".join(f"(?:{p})" for p in ALLOWED))


def character_class(text: str) -> str:
    """The narrowest class that holds all characters."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    if not text.isalnum():
        return "base64"
    return "lower" if text in (text.lower(), text.upper()) else "alnum"


def window_entropies(text: str, window: int) -> list[float]:
    """Shannon entropy, in bits a character, of every window, from counts updated by the character that leaves and the one that enters.

    H = log2(w) - (sum of c log2 c) / w, so each step changes two terms of the sum. Texts below one window have none.
    """
    if len(text) < window:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, found, base = 0.0, [], math.log2(window)
    for at, entering in enumerate(text):
        if at >= window:
            leaving = text[at - window]
            c = counts[leaving]
            counts[leaving] = c - 1
            total += term[c - 1] - term[c]
        c = counts.get(entering, 0)
        counts[entering] = c + 1
        total += term[c + 1] - term[c]
        if at >= window - 1:
            found.append(base - total / window)
    return found


def base_spans(text: str) -> list[Span]:
    """Pattern findings as (start, end, kind), leftmost and non-overlapping within a kind."""
    found: list[Span] = []
    lowered = text.lower()  # a gate only; the pattern itself decides
    if any(name in lowered for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def entropy_spans(text: str, setting: Entropy) -> list[Span]:
    """Candidate strings, whole, with a window as uneven as random keys are."""
    found: list[Span] = []
    for match in _CANDIDATE.finditer(text):
        word = match.group()
        if _ALLOWED.fullmatch(word):
            continue
        kind = character_class(word)
        if any(bits >= getattr(setting, kind) for bits in window_entropies(word, setting.window)):
            found.append((match.start(), match.end(), f"entropy_{kind}"))
    return found


def spans_of(text: str, setting: Entropy = Entropy()) -> list[Span]:
    """All findings by start, then kind in the order of ``KINDS``."""
    return sorted(base_spans(text) + entropy_spans(text, setting), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(df: DataFrame, setting: Entropy = Entropy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): code-point ranges, end exclusive, of every finding in the whole text."""

    def make():
        return lambda text: ([{"start": a, "end": b, "kind": k} for a, b, k in spans_of(text, setting)],)

    return per_text(id_text(df, id_col, text_col), make, "spans array<struct<start: int, end: int, kind: string>>")


def mask(text: str, setting: Entropy = Entropy(), mark: str = "[SECRET]") -> str:
    """The text with each stretch covered by findings replaced by the mark."""
    parts, done = [], 0
    for start, end, _ in spans_of(text, setting):
        if end <= done:
            continue
        if start >= done:
            parts += [text[done:start], mark]
        done = end
    return "".join([*parts, text[done:]])


def redact(df: DataFrame, setting: Entropy = Entropy(), text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets masked; the character count follows. Null texts stay null."""

    def make():
        return lambda text: (None if text is None else mask(text, setting),)

    packed = df.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    masked = per_text(packed, make, "_masked string")
    columns = []
    for field in df.schema.fields:
        column = F.col("_row")[field.name]
        if field.name == text_col:
            column = F.col("_masked")
        elif field.name == chars_col:
            column = F.when(F.col("_masked") == F.col("_row")[text_col], column).otherwise(F.length("_masked").cast(field.dataType))
        columns.append(column.alias(field.name))
    return masked.select(columns)
