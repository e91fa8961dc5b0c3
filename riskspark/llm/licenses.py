"""License scans by ordered signature rules.

A keyword automaton runs over the text first; only rules with a keyword in it are tried, and the keywords are read off each rule's own regex, so
that the gate loses nothing. Detections are taken by priority
(then length, place, rule order); one that lies inside an interval already taken is suppressed, so "GPL version 3"
leaves no bare "GPL" behind. Three base phrases are found on words besides and always stay.

Null texts count as empty; texts without words have zero words and no places; repeated rows are scanned one by one.
"""

from __future__ import annotations

import functools
from bisect import bisect_right

from pyspark.sql import DataFrame

from riskspark.llm.common import id_text, per_text
from riskspark.llm.license_rules import Rule, rules

#: Fixed phrases and labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
BASE_CONFIDENCE = 0.5

#: ASCII letters lowered, digits and non-ASCII bytes as they are, everything else a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

Detection = tuple[int, int, str, float]


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (first word, label) of every place of a base phrase."""
    words = text.encode().translate(_WORDS).split()
    places: list[tuple[int, str]] = []
    if b"license" in words:
        line = b" " + b" ".join(words) + b" "
        for phrase, label in BASE:
            wanted, at = f" {phrase} ".encode(), -1
            while (at := line.find(wanted, at + 1)) >= 0:
                places.append((line.count(b" ", 0, at), label))
    return len(words), sorted(places)


class Scanner:
    """The rules behind their keyword automaton."""

    def __init__(self, table: list[Rule]):
        import ahocorasick

        self.rules = table
        self.gate = ahocorasick.Automaton()
        behind: dict[str, list[int]] = {}
        for number, rule in enumerate(table):
            for keyword in rule.keywords:
                behind.setdefault(keyword, []).append(number)
        self.always = {number for number, rule in enumerate(table) if not rule.keywords}
        for keyword, numbers in behind.items():
            self.gate.add_word(keyword, numbers)
        self.gate.make_automaton()

    def tried(self, lowered: str) -> set[int]:
        """Numbers of the rules that the gate lets through."""
        return self.always.union(*(numbers for _, numbers in self.gate.iter(lowered)))

    def detect(self, text: str) -> list[Detection]:
        """(start, end, label, confidence) by start, after suppression; code points, end exclusive."""
        lowered = text.encode().translate(_LOWER).decode()  # keeps every position, unlike full lower-casing
        raw = []
        for number in self.tried(lowered):
            rule = self.rules[number]
            group = "extent" if "extent" in rule.regex.groupindex else 0
            raw += [(-rule.priority, m.start(group) - m.end(group), m.start(group), number) for m in rule.regex.finditer(lowered)]
        taken: list[Detection] = []
        starts: list[int] = []  # of what is taken, in order, and the furthest end up to each: containment without comparing all pairs
        furthest: list[int] = []
        for _, length, start, number in sorted(raw):
            end = start - length
            if not _inside(starts, furthest, start, end):
                taken.append((start, end, self.rules[number].label, self.rules[number].confidence))
                _insert(starts, furthest, start, end)
        return sorted(taken)


def _inside(starts: list[int], furthest: list[int], start: int, end: int) -> bool:
    at = bisect_right(starts, start) - 1
    return at >= 0 and furthest[at] >= end


def _insert(starts: list[int], furthest: list[int], start: int, end: int) -> None:
    at = bisect_right(starts, start)
    starts.insert(at, start)
    furthest.insert(at, max(end, furthest[at - 1] if at else end))
    for later in range(at + 1, len(furthest)):
        if furthest[later] >= end:
            break
        furthest[later] = end


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, found): base places by word number, rule detections by code points."""

    def make():
        detect = scanner().detect

        def one(text: str) -> tuple:
            n_words, places = base_places(text)
            found = [{"start": a, "end": b, "label": label, "confidence": c} for a, b, label, c in detect(text)]
            return n_words, [{"word": w, "label": label} for w, label in places], found

        return one

    columns = (
        "n_words long, places array<struct<word: long, label: string>>, "
        "found array<struct<start: int, end: int, label: string, confidence: double>>"
    )
    return per_text(id_text(df, id_col, text_col), make, columns)
