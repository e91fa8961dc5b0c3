"""The keyword gate lets every rule see the texts that its regex finds."""

from __future__ import annotations

from re import _parser

import pytest

from riskspark.llm import licenses


def example(parts, space: str, longest: bool) -> str:
    """A text that the parsed regex finds, with ``space`` where a rule has a space; the last branch and optional parts on request."""
    out = ""
    for kind, value in parts:
        if kind is _parser.LITERAL:
            out += chr(value)
        elif kind is _parser.IN:
            wide = any(v is _parser.CATEGORY_SPACE for _, v in value)
            out += space if wide else next(chr(v) if k is _parser.LITERAL else chr(v[0]) if k is _parser.RANGE else "x" for k, v in value)
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            inner = value[2]
            wide = inner[0][0] is _parser.IN and any(v is _parser.CATEGORY_SPACE for _, v in inner[0][1])
            single = wide and value[1] == 1
            out += (" " if single else example(inner, space, longest)) * max(value[0], int(longest and value[1] == 1))
        elif kind is _parser.SUBPATTERN:
            out += example(value[-1], space, longest)
        elif kind is _parser.BRANCH:
            out += example(value[1][-1 if longest else 0], space, longest)
        elif kind in (_parser.ANY, _parser.NOT_LITERAL):
            out += "x"
    return out


@pytest.mark.parametrize("space", [" ", "\n", "\n * ", "\n# "])
@pytest.mark.parametrize("longest", [False, True])
def test_every_rule_passes_its_own_example(space, longest):
    scanner = licenses.scanner()
    found = 0
    for number, rule in enumerate(scanner.rules):
        text = example(_parser.parse(rule.regex.pattern), space, longest)
        if rule.regex.search(text):  # a line break can't stand for [-\s], which takes one character
            found += 1
            assert number in scanner.tried(text), (rule.label, text)
    assert found >= 0.9 * len(scanner.rules)


@pytest.mark.parametrize("text, label", [
    ("GNU General\n * Public License version 3", "gpl-3.0"), ("Creative\nCommons", "cc"), ("All rights\nreserved", "proprietary"),
    ("Common\nPublic License", "cpl-1.0"), ("same terms as Perl itself", "artistic-1.0"), ("unauthorized copying of this file", "proprietary"),
    ("waived all copyright and related or neighboring rights", "cc0-1.0"), ("altered source versions must be plainly marked as such", "zlib"),
])
def test_named_texts(text, label):
    assert label in {found for _, _, found, _ in licenses.scanner().detect(text)}
