"""Signature rules of the license scan, written by hand: one line per license, one regex per way of naming it.

Columns: label | name | tag | address | wording. A dash leaves a way out; several wordings are separated by " ;; ". Regexes run on text with A-Z lowered; a space stands for any run of
white space, comment marks included. Ways differ in priority: wording and tags say more than a name does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

TABLE = r"""
mit | \b(?:the )?mit(?:/expat)? licen[sc]e\b | \bmit | opensource\.org/licenses/mit(?:-license)? | permission is hereby granted, free of charge, to any person obtaining a copy ;; released under (?:the )?mit\b ;; licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit\b
mit-0 | \bmit no attribution\b ;; \bmit-0 licen[sc]e\b | \bmit-0 | opensource\.org/licenses/mit-0 | -
apache-2.0 | \bapache(?: software)? licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?\b | \bapache-2\.0 | apache\.org/licenses/license-2\.0 | licen[sc]ed under (?:the )?apache licen[sc]e ;; you may not use this file except in compliance with the licen[sc]e
apache-1.1 | \bapache(?: software)? licen[sc]e,? (?:version |v\.? ?)?1\.1\b | \bapache-1\.1 | apache\.org/licenses/license-1\.1 | products derived from this software may not be called "?apache
apache-1.0 | \bapache(?: software)? licen[sc]e,? (?:version |v\.? ?)?1\.0\b | \bapache-1\.0 | apache\.org/licenses/license-1\.0 | -
gpl-2.0 | \bgnu general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?\b ;; \bgpl[- ]?v?\.? ?2(?:\.0)?\b | \bgpl-2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0 | either version 2 of the licen[sc]e, or \(at your option\)
gpl-3.0 | \bgnu general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b ;; \bgpl[- ]?v?\.? ?3(?:\.0)?\b | \bgpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/gpl-3\.0 | either version 3 of the licen[sc]e, or \(at your option\)
gpl | \bgnu general public licen[sc]e\b ;; \bgnu gpl\b ;; \bgpl licen[sc]e\b | \bgpl | gnu\.org/(?:copyleft|licenses)/gpl | terms of the gnu general public licen[sc]e
lgpl-2.1 | \b(?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1\b ;; \blgpl[- ]?v?\.? ?2\.1\b | \blgpl-2\.1(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1 | -
lgpl-3.0 | \b(?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?\b ;; \blgpl[- ]?v?\.? ?3(?:\.0)?\b | \blgpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/lgpl-3\.0 | -
lgpl | \b(?:gnu )?(?:lesser|library) general public licen[sc]e\b ;; \bgnu lgpl\b | \blgpl | gnu\.org/(?:copyleft|licenses)/lgpl | terms of the gnu (?:lesser|library) general public licen[sc]e
agpl-3.0 | \b(?:gnu )?affero general public licen[sc]e(?:,? (?:version |v\.? ?)3(?:\.0)?)?\b ;; \bagpl[- ]?v?\.? ?3?(?:\.0)?\b | \bagpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/agpl | terms of the gnu affero general public licen[sc]e
gfdl-1.3 | \bgnu free documentation licen[sc]e\b ;; \bgfdl\b | \bgfdl-1\.[123] | gnu\.org/(?:copyleft|licenses)/fdl | permission is granted to copy, distribute and/or modify this document
bsd-2-clause | \b(?:the )?(?:simplified|freebsd|2[- ]clause) (?:bsd )?licen[sc]e\b ;; \bbsd[- ]2[- ]clause\b | \bbsd-2-clause | opensource\.org/licenses/bsd-2-clause | -
bsd-3-clause | \b(?:new|revised|modified|3[- ]clause) bsd licen[sc]e\b ;; \bbsd[- ]3[- ]clause\b | \bbsd-3-clause | opensource\.org/licenses/bsd-3-clause | neither the names? of .{1,80} nor the names? of its contributors may be used
bsd-4-clause | \b(?:original|old) bsd licen[sc]e\b ;; \bbsd[- ]4[- ]clause\b | \bbsd-4-clause | directory\.fsf\.org/wiki/license:bsd[-_]4clause | all advertising materials mentioning features or use of this software
0bsd | \bzero[- ]clause bsd\b ;; \b0bsd licen[sc]e\b | \b0bsd | opensource\.org/licenses/0bsd | -
bsd | \bbsd[- ](?:style )?licen[sc]e\b | \bbsd | opensource\.org/licenses/bsd-license | redistribution and use in source and binary forms, with or without modification
isc | \bisc licen[sc]e\b | \bisc | opensource\.org/licenses/isc | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee
mpl-2.0 | \bmozilla public licen[sc]e,? (?:version |v\.? ?)2\.0\b ;; \bmpl[- ]?v?\.? ?2(?:\.0)?\b | \bmpl-2\.0 | mozilla\.org/(?:en-us/)?mpl/2\.0 | subject to the terms of the mozilla public licen[sc]e, v\. 2\.0
mpl-1.1 | \bmozilla public licen[sc]e,? (?:version |v\.? ?)1\.1\b ;; \bmpl[- ]?v?\.? ?1\.1\b | \bmpl-1\.1 | mozilla\.org/mpl/mpl-1\.1 | contents of this file are subject to the mozilla public licen[sc]e
mpl | \bmozilla public licen[sc]e\b | \bmpl | mozilla\.org/mpl | -
epl-1.0 | \beclipse public licen[sc]e,? (?:- )?(?:version |v\.? ?)1\.0\b | \bepl-1\.0 | eclipse\.org/legal/epl-v10 | -
epl-2.0 | \beclipse public licen[sc]e,? (?:- )?(?:version |v\.? ?)2\.0\b | \bepl-2\.0 | eclipse\.org/legal/epl-(?:2\.0|v20) | -
epl | \beclipse public licen[sc]e\b | \bepl | eclipse\.org/legal/epl | made available under the terms of the eclipse public licen[sc]e
cddl-1.0 | \bcommon development and distribution licen[sc]e\b ;; \bcddl(?:[- ]?v?1\.0)?\b | \bcddl-1\.[01] | opensource\.org/licenses/cddl1? | -
cpl-1.0 | \bcommon public licen[sc]e\b | \bcpl-1\.0 | opensource\.org/licenses/cpl1?\.0 | -
artistic-2.0 | \bartistic licen[sc]e,? (?:version |v\.? ?)?2\.0\b | \bartistic-2\.0 | opensource\.org/licenses/artistic-license-2\.0 | -
artistic-1.0 | \b(?:perl )?artistic licen[sc]e\b | \bartistic-1\.0(?:-perl)? | dev\.perl\.org/licenses/artistic | same terms as perl itself
bsl-1.0 | \bboost software licen[sc]e\b | \bbsl-1\.0 | boost\.org/license_1_0 | -
busl-1.1 | \bbusiness source licen[sc]e\b | \bbusl-1\.1 | mariadb\.com/bsl11 | -
sspl-1.0 | \bserver side public licen[sc]e\b | \bsspl-1\.0 | mongodb\.com/licensing/server-side-public-license | -
elastic-2.0 | \belastic licen[sc]e(?: 2\.0)?\b | \belastic-2\.0 | elastic\.co/licensing/elastic-license | -
unlicense | \bthe unlicen[sc]e\b | \bunlicense | unlicense\.org | this is free and unencumbered software released into the public domain
wtfpl | \bwtfpl\b ;; \bdo what the f\S* you want to public licen[sc]e\b | \bwtfpl | wtfpl\.net | -
zlib | \bzlib(?:/libpng)? licen[sc]e\b | \bzlib | zlib\.net/zlib_license | altered source versions must be plainly marked as such
libpng | \blibpng licen[sc]e\b | \blibpng(?:-2\.0)? | libpng\.org/pub/png/src/libpng-license | -
psf-2.0 | \bpython software foundation licen[sc]e\b ;; \bpsf licen[sc]e\b | \b(?:psf|python)-2\.0 | python\.org/(?:psf/license|download/releases/[0-9.]+/license) | -
ruby | \bruby licen[sc]e\b | \bruby | ruby-lang\.org/en/about/license | -
php-3.01 | \bphp licen[sc]e\b | \bphp-3\.0?1? | php\.net/license | this product includes php software
postgresql | \bpostgresql licen[sc]e\b | \bpostgresql | postgresql\.org/about/licen[sc]e | -
openssl | \bopenssl licen[sc]e\b | \bopenssl | openssl\.org/source/license | this product includes software developed by the openssl project
ofl-1.1 | \bsil open font licen[sc]e\b ;; \bopen font licen[sc]e\b | \bofl-1\.1 | scripts\.sil\.org/ofl | -
vim | \bvim licen[sc]e\b | \bvim | vimhelp\.org/uganda | -
ms-pl | \bmicrosoft public licen[sc]e\b | \bms-pl | opensource\.org/licenses/ms-pl | -
ms-rl | \bmicrosoft reciprocal licen[sc]e\b | \bms-rl | opensource\.org/licenses/ms-rl | -
eupl-1.2 | \beuropean union public licen[sc]e\b ;; \beupl(?: v?\.? ?1\.[12])?\b | \beupl-1\.[12] | joinup\.ec\.europa\.eu/.{0,60}eupl | -
osl-3.0 | \bopen software licen[sc]e\b | \bosl-3\.0 | opensource\.org/licenses/osl-3\.0 | -
afl-3.0 | \bacademic free licen[sc]e\b | \bafl-3\.0 | opensource\.org/licenses/afl-3\.0 | -
ncsa | \b(?:university of illinois/)?ncsa open source licen[sc]e\b | \bncsa | opensource\.org/licenses/ncsa | -
upl-1.0 | \buniversal permissive licen[sc]e\b | \bupl-1\.0 | opensource\.org/licenses/upl | -
ecl-2.0 | \beducational community licen[sc]e\b | \becl-2\.0 | opensource\.org/licenses/ecl-2\.0 | -
cecill-2.1 | \bcecill(?:-[bc])?(?: licen[sc]e)?\b | \bcecill-2\.1 | cecill\.info/licences | -
mulanpsl-2.0 | \bmulan permissive software licen[sc]e\b | \bmulanpsl-2\.0 | license\.coscl\.org\.cn/mulanpsl2 | -
blueoak-1.0.0 | \bblue oak model licen[sc]e\b | \bblueoak-1\.0\.0 | blueoakcouncil\.org/license | -
cc0-1.0 | \bcc0(?: 1\.0)?(?: universal)?\b | \bcc0-1\.0 | creativecommons\.org/publicdomain/zero | waived all copyright and related or neighbou?ring rights
cc-by-4.0 | \bcc[- ]by 4\.0\b ;; \bcreative commons attribution 4\.0\b | \bcc-by-4\.0 | creativecommons\.org/licenses/by/4\.0 | -
cc-by-3.0 | \bcc[- ]by 3\.0\b ;; \bcreative commons attribution 3\.0\b | \bcc-by-3\.0 | creativecommons\.org/licenses/by/3\.0 | -
cc-by-sa-4.0 | \bcc[- ]by[- ]sa 4\.0\b ;; \bcreative commons attribution[- ]share ?alike 4\.0\b | \bcc-by-sa-4\.0 | creativecommons\.org/licenses/by-sa/4\.0 | -
cc-by-sa-3.0 | \bcc[- ]by[- ]sa 3\.0\b ;; \bcreative commons attribution[- ]share ?alike 3\.0\b | \bcc-by-sa-3\.0 | creativecommons\.org/licenses/by-sa/3\.0 | -
cc-by-nc-4.0 | \bcc[- ]by[- ]nc 4\.0\b ;; \bcreative commons attribution[- ]non ?commercial 4\.0\b | \bcc-by-nc-4\.0 | creativecommons\.org/licenses/by-nc/4\.0 | -
cc-by-nc-sa-4.0 | \bcc[- ]by[- ]nc[- ]sa 4\.0\b | \bcc-by-nc-sa-4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0 | -
cc-by-nc-nd-4.0 | \bcc[- ]by[- ]nc[- ]nd 4\.0\b | \bcc-by-nc-nd-4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0 | -
cc-by-nd-4.0 | \bcc[- ]by[- ]nd 4\.0\b | \bcc-by-nd-4\.0 | creativecommons\.org/licenses/by-nd/4\.0 | -
cc | \bcreative commons\b(?: licen[sc]e)? | - | creativecommons\.org/licenses | -
odbl-1.0 | \bopen database licen[sc]e\b ;; \bodbl\b | \bodbl-1\.0 | opendatacommons\.org/licenses/odbl | -
odc-by-1.0 | \bopen data commons attribution\b | \bodc-by-1\.0 | opendatacommons\.org/licenses/by | -
pddl-1.0 | \bpublic domain dedication and licen[sc]e\b | \bpddl-1\.0 | opendatacommons\.org/licenses/pddl | -
openrail | \bopenrail(?:-?\+?\+?m?)\b ;; \bresponsible ai licen[sc]e\b | \b(?:bigscience-)?openrail-m | huggingface\.co/spaces/bigscience/license | -
llama | \bllama ?[23]?(?:\.[0-9])? community licen[sc]e\b | \bllama[23](?:\.[0-9])? | llama\.meta\.com/.{0,20}license | -
public-domain | \b(?:released|placed) (?:in|into) the public domain\b | - | - | this (?:work|file|code|software) is in the public domain
proprietary | \ball rights reserved\b | \blicenseref-proprietary | - | proprietary and confidential ;; unauthori[sz]ed copying of this file
"""

#: Priority and confidence of each way of naming a license.
WAYS = {"wording": (4, 1.0), "tag": (3, 1.0), "address": (2, 0.9), "name": (1, 0.8)}
_TAG = r"spdx-license-identifier: ?(?:[a-z0-9.+-]+ (?:or|and|with) )*"


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    regex: re.Pattern[str]


def compiled(body: str) -> re.Pattern[str]:
    """A space in a rule stands for a run of white space and comment marks; a group ``extent`` is the part that counts as detected."""
    body = body.replace("[- ]", r"[-\s]").replace(" ?", r"[\s]?")
    return re.compile(body.replace(" ", r"[\s*#/]+"))


#: Words that many rules or texts share; another word of a rule tells more.
_COMMON = {"new", "old", "licen", "public", "general", "software", "source", "under", "version", "this", "file", "license", "the"}


def gate_words(regex: re.Pattern[str]) -> tuple[str, ...]:
    """Pieces of plain text of which every match holds at least one, read off the regex itself; none if it has no such pieces."""
    return tuple(sorted(_needed(_parser.parse(regex.pattern))))


def _needed(parts) -> set[str]:
    """The most telling of the sets that a sequence offers: its runs of letters, and what its groups and branches need."""
    offers: list[set[str]] = []
    run = ""
    for kind, value in [*parts, (None, None)]:
        if kind is _parser.LITERAL:
            run += chr(value)
            continue
        if kind is _parser.AT:  # takes no text, so a run goes on
            continue
        offers.append({run} if run else set())
        run = ""
        if kind is _parser.SUBPATTERN:
            offers.append(_needed(value[-1]))
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            offers.append(_needed(value[2]))
        elif kind is _parser.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            offers.append(set().union(*each) if all(each) else set())
    return max(offers, key=lambda words: (bool(words), not words & _COMMON, min(map(len, words), default=0)))


def rules(table: str = TABLE) -> list[Rule]:
    """The rules in order: an earlier license goes before a later one of the same priority and extent."""
    found = []
    for line in filter(None, map(str.strip, table.splitlines())):
        label, name, tag, address, wording = (part.strip() for part in re.split(r" \| ", line))
        for way, cell in (("wording", wording), ("tag", tag), ("address", address), ("name", name)):
            for body in [] if cell == "-" else cell.split(" ;; "):
                regex = compiled(f"{_TAG}(?P<extent>{body})(?![a-z0-9.+-])" if way == "tag" else body)
                found.append(Rule(label, gate_words(regex), *WAYS[way], regex))
    return found
