"""License scans by ordered signature rules.

Some hundreds of regular expressions over words, each tried only where its keyword,
the rarest of its words, stands, and matched to both sides of it. Detections are
word intervals; one that lies inside another of the same or better priority is
suppressed. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick

NOT_WORD_RE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (words of a phrase, label): fixed values of the contract.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Confidence by priority.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.6}
BASE_CONFIDENCE = 0.5
#: What makes the name of a licence a grant (priority 2), if it stands right before it.
GRANT = r"(?:licensed|released|distributed|available|published|covered|redistributed|provided|offered|shared|usable)(?: to you)? (?:under|by|per|on)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: following)?"
#: A version after a name.
VERSION = r"(?:(?:version |v)?[0-9]+(?: [0-9]+){0,2}[a-z]?(?: only| or later| or newer| or any later version| or at your option any later version)?)"
#: label: names in full (priority 4, with a version 3). Words are in lower case and single spaces stand for
#: whatever divides them; {} marks the keyword; "license" is spelled either way.
NAMES = """
gpl: gnu general public {license}
gpl: general public {license}
gpl: gnu {gpl}
lgpl: gnu (?:lesser|library) general public {license}
lgpl: (?:lesser|library) general public {license}
lgpl: gnu {lgpl}
agpl: gnu {affero} general public license
agpl: {affero} (?:general public )?license
agpl: gnu {agpl}
gfdl: (?:gnu )?free documentation {license}
gfdl: gnu {fdl}
apache: apache (?:software |public )?{license}
mit: (?:mit|expat|x11) {license}
mit: mit x11 {license}
bsd: bsd(?: style| like)? {license}
bsd: {berkeley} software distribution license
bsd: (?:modified|simplified|revised|new|original|freebsd|two clause|three clause|four clause|2 clause|3 clause|4 clause) bsd {license}
bsd: (?:2|3|4) {clause} bsd(?: license)?
bsd: {bsd} (?:2|3|4|two|three|four) clause(?: license)?
bsd-protection: bsd {protection} license
0bsd: (?:zero clause bsd|bsd zero clause|0bsd) {license}
isc: isc {license}
isc: internet (?:systems|software) {consortium} license
mpl: {mozilla} public license
epl: {eclipse} public license
edl: {eclipse} distribution license
cpl: common public {license}
ipl: ibm public {license}
cddl: common development and distribution {license}
cpal: common public attribution {license}
eupl: european (?:union )?public {license}
osl: open software {license}
osl: non profit open software {license}
afl: academic free {license}
ecl: educational community {license}
upl: universal {permissive} license
ms-pl: microsoft public {license}
ms-rl: microsoft {reciprocal} license
ms-lpl: microsoft limited public {license}
artistic: (?:perl )?{artistic} license
artistic: {clarified} artistic license
boost: {boost} software license
busl: business source {license}
commons-clause: {commons} clause(?: license condition)?
sspl: server side public {license}
elastic: elastic {license}
confluent: {confluent} community license
polyform: {polyform} (?:noncommercial|small business|shield|strict|internal use|perimeter|free trial) license
zlib: zlib(?: libpng)? {license}
libpng: {libpng} license
libpng: png reference library {license}
openssl: {openssl} license
openssl: original {ssleay} license
curl: {curl} license
python: python software foundation {license}
python: (?:psf|python) {license}
php: php {license}
ruby: ruby {license}
vim: vim {license}
w3c: w3c (?:software |document |test suite )?(?:notice and )?{license}
unicode: unicode (?:inc )?{license}(?: agreement)?
icu: icu {license}
ofl: (?:sil )?open font {license}
ofl: (?:ubuntu|bitstream vera|arphic public) (?:font )?{license}
lppl: {latex} project public license
ncsa: university of {illinois}(?: ncsa)? open source license
ncsa: {ncsa} open source license
postgresql: {postgresql} license
sleepycat: {sleepycat} license
qpl: q public {license}
apsl: apple public source {license}
nposl: non profit open software {license}
rpl: {reciprocal} public license
rpsl: {realnetworks} public source license
spl: sun public {license}
sissl: sun industry standards source {license}
npl: {netscape} public license
intel: intel open source {license}
nasa: {nasa} open source agreement
odbl: open database {license}
odc-by: open data commons attribution {license}
pddl: (?:open data commons )?public domain {dedication} and license
pddl: {pddl} license
ogl: open government {license}
odl-de: data {license} germany(?: attribution| zero)?
etalab: {etalab} open license
etalab: license {ouverte}(?: open license)?
cecill: {cecill}(?: b| c)?(?: free software)? license
mulan: {mulan} (?:permissive software|public) license
hippocratic: {hippocratic} license
parity: {parity} public license
blueoak: {blue} oak model license
unlicense: {unlicense}(?: license)?
wtfpl: do what the {fuck} you want to public license
beerware: (?:beerware|beer ware) {license}
json: json {license}
jython: {jython} license
tcl: tcl tk {license}
info-zip: info zip {license}
freetype: {freetype}(?: project)? license
ijg: independent {jpeg} group license
imagemagick: {imagemagick} license
fair: fair {license}
ntp: ntp {license}
naumen: {naumen} public license
zpl: {zope} public license
eiffel: {eiffel} forum license
watcom: {watcom} public license
vovida: {vovida} software license
openldap: {openldap} public license
open-group: open group test suite {license}
rail: (?:open|creativeml open|bigscience|bigcode|llama) ?rail(?: m)? {license}
rail: {openrail}(?: m)?(?: license)?
llama: llama [0-9]+ community {license}(?: agreement)?
gemma: {gemma} terms of use
cc0: creative {commons} zero
cc0: {cc0}(?: public domain dedication| universal)?
cc-by: creative {commons} attribution
cc-by: {cc} by
cc-by-sa: creative {commons} attribution share ?alike
cc-by-sa: {cc} by sa
cc-by-nd: creative {commons} attribution no ?deriv(?:s|atives|ative works)
cc-by-nd: {cc} by nd
cc-by-nc: creative {commons} attribution non ?commercial
cc-by-nc: {cc} by nc
cc-by-nc-sa: creative {commons} attribution non ?commercial share ?alike
cc-by-nc-sa: {cc} by nc sa
cc-by-nc-nd: creative {commons} attribution non ?commercial no ?deriv(?:s|atives|ative works)
cc-by-nc-nd: {cc} by nc nd
"""
#: Names too short to count without a version (3): "gpl v3".
SHORT = """
gpl: {gpl}
lgpl: {lgpl}
agpl: {agpl}
gfdl: {gfdl}
apache: {apache}
bsd: {bsd}
mpl: {mpl}
epl: {epl}
cddl: {cddl}
cpl: {cpl}
osl: {osl}
afl: {afl}
eupl: {eupl}
artistic: {artistic}
boost: {bsl}
sspl: {sspl}
ofl: {ofl}
lppl: {lppl}
odbl: {odbl}
zpl: {zpl}
apsl: {apsl}
cecill: {cecill}
"""
#: Short names that count only after a grant (2): "released under MIT". Where the name is a common word in some
#: language, the grant's verb is the keyword.
GRANTED = """
mit: {licensed|relicensed|released|distributed} (?:under|by)(?: the)?(?: terms of)?(?: the)? mit
mit: {expat}
bsd: (?:(?:2|3|two|three) clause )?{bsd}
isc: {isc}
apache: {apache}
gpl: (?:gnu )?{gpl}
lgpl: (?:gnu )?{lgpl}
agpl: (?:gnu )?{agpl}
mpl: {mpl}
epl: {epl}
boost: {boost}
zlib: {zlib}
unlicense: (?:the )?{unlicense}
python: {psf}
php: {php}
ruby: same terms as {ruby}
artistic: same terms as {perl}
public-domain: public {domain}
proprietary: commercial {license}
"""
#: label: SPDX names (priority 1 after the tag).
SPDX = """
gpl: gpl
lgpl: lgpl
agpl: agpl
gfdl: gfdl
apache: apache
mit: mit(?: 0| cmu| feh| advertising)?
bsd: bsd
0bsd: 0bsd
isc: isc
mpl: mpl
epl: epl
cddl: cddl
cpl: cpl
eupl: eupl
osl: osl
afl: afl
ecl: ecl
upl: upl
ms-pl: ms pl
ms-rl: ms rl
artistic: artistic
boost: bsl
busl: busl
sspl: sspl
elastic: elastic
zlib: zlib
libpng: libpng
openssl: openssl
curl: curl
python: (?:psf|python)
php: php
ruby: ruby
vim: vim
w3c: w3c
unicode: unicode(?: dfs)?
icu: icu
ofl: ofl
lppl: lppl
ncsa: ncsa
postgresql: postgresql
sleepycat: sleepycat
qpl: qpl
apsl: apsl
zpl: zpl
odbl: odbl
odc-by: odc by
pddl: pddl
cecill: cecill
mulan: mulanpsl
unlicense: unlicense
wtfpl: wtfpl
beerware: beerware
json: json
cc0: cc0
cc-by: cc by
cc-by-sa: cc by sa
cc-by-nd: cc by nd
cc-by-nc: cc by nc
cc-by-nc-sa: cc by nc sa
cc-by-nc-nd: cc by nc nd
"""
#: label: priority: sentences, headers, exception clauses and addresses, keyword in {}.
NOTICES = """
mit: 2: permission is {hereby} granted free of charge to any person obtaining a copy(?: of this software)?
mit: 3: the above copyright notice and this {permission} notice shall be included in all copies
mit: 3: software is provided as is without {warranty} of any kind express or implied including
mit: 2: {opensource} org licenses mit(?: license)?(?: php)?
mit: 3: without restriction including without limitation the rights to use copy modify merge publish distribute {sublicense}
mit: 2: {choosealicense} com licenses mit
bsd: 2: {redistribution} and use in source and binary forms with or without modification are permitted
bsd: 3: {redistributions} of source code must retain the above copyright notice
bsd: 3: {redistributions} in binary form must reproduce the above copyright notice
bsd: 3: neither the names? of [^ ]+(?: [^ ]+){0,10} nor the names of (?:its|their|any) {contributors}
bsd: 3: all advertising materials mentioning features or use of this software must display the following {acknowledgement}
bsd: 2: {opensource} org licenses bsd(?: [23] clause)?(?: license)?(?: php)?
isc: 2: permission to use copy modify and or distribute this software for any purpose with or without fee is {hereby} granted
isc: 3: the author {disclaims} all warranties with regard to this software
isc: 2: {opensource} org licenses isc(?: license)?(?: txt)?
gpl: 2: this program is free software you can {redistribute} it and or modify
gpl: 3: this program is distributed in the {hope} that it will be useful but without any warranty
gpl: 3: you should have received a copy of the {gnu} general public license along with
gpl: 2: {gnu} org (?:licenses|copyleft) (?:old licenses )?gpl(?: [0-9]+ [0-9]+)?(?: html| txt)?
gpl: 2: as a special {exception} to the gnu general public license
gpl: 2: gcc runtime library {exception}
gpl: 2: {classpath} exception
gpl: 3: either version [23] of the license or at your {option} any later version
gpl: 2: {opensource} org licenses gpl(?: [23] 0)?
gpl: 2: font {exception} gpl
gpl: 2: {autoconf} (?:configure script )?exception
gpl: 2: {bison} exception
lgpl: 2: this library is free software you can {redistribute} it and or modify
lgpl: 3: you should have received a copy of the {gnu} (?:lesser|library) general public license
lgpl: 2: {gnu} org (?:licenses|copyleft) (?:old licenses )?lgpl(?: [0-9]+ [0-9]+)?(?: html| txt)?
lgpl: 2: static or dynamic {linking} exception
agpl: 2: {gnu} org licenses agpl(?: [0-9]+ [0-9]+)?(?: html| txt)?
agpl: 3: remote network interaction use with the gnu general public {license}
gfdl: 2: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {license}
gfdl: 3: with no {invariant} sections no front cover texts and no back cover texts
gfdl: 2: {gnu} org (?:licenses|copyleft) fdl(?: html| txt)?
apache: 2: you may not use this file except in {compliance} with the license
apache: 1: licensed to the {apache} software foundation asf under one or more contributor license agreements
apache: 2: {apache} org licenses license(?: [12] [01])?(?: txt| html)?
apache: 3: unless required by {applicable} law or agreed to in writing software distributed under the license is distributed on an as is basis
apache: 2: {opensource} org licenses apache(?: 2 0)?
apache: 3: this product includes software developed (?:at|by) the {apache} software foundation
mpl: 1: this source code form is subject to the terms of the {mozilla} public license
mpl: 2: {mozilla} org mpl(?: [12] [01])?
mpl: 3: the contents of this file are subject to the {mozilla} public license
mpl: 2: incompatible with {secondary} licenses
epl: 1: this program and the accompanying materials are made available under the terms of the {eclipse} public license
epl: 2: {eclipse} org (?:legal|org documents) epl(?: v10| 2 0)?(?: html)?
edl: 2: {eclipse} org org documents edl v10(?: html| php)?
cddl: 2: the contents of this file are subject to the terms of the common development and distribution {license}
cddl: 2: {opensource} org licenses cddl(?: 1 0)?
cpl: 2: this program and the accompanying materials are made available under the terms of the common public {license}
boost: 2: permission is {hereby} granted free of charge to any person or organization obtaining a copy
boost: 2: {boost} org license 1 0 txt
zlib: 2: this software is provided as is without any express or implied {warranty} in no event will the authors
zlib: 3: altered source versions must be plainly marked as such and must not be {misrepresented}
unlicense: 1: this is free and {unencumbered} software released into the public domain
unlicense: 2: {unlicense} org
wtfpl: 2: {wtfpl} net
wtfpl: 2: you just do what the {fuck} you want to
beerware: 2: if we meet some day and you think this {stuff} is worth it you can buy me a beer
cc0: 1: to the extent possible under law [^ ]+(?: [^ ]+){0,6} has {waived} all copyright and related or neighboring rights
cc0: 2: {creativecommons} org publicdomain zero 1 0
cc-by: 2: {creativecommons} org licenses by [1-4] [05]
cc-by-sa: 2: {creativecommons} org licenses by sa [1-4] [05]
cc-by-nd: 2: {creativecommons} org licenses by nd [1-4] [05]
cc-by-nc: 2: {creativecommons} org licenses by nc [1-4] [05]
cc-by-nc-sa: 2: {creativecommons} org licenses by nc sa [1-4] [05]
cc-by-nc-nd: 2: {creativecommons} org licenses by nc nd [1-4] [05]
public-domain: 2: {creativecommons} org publicdomain mark 1 0
public-domain: 3: (?:released|placed|dedicated|donated|put) (?:in|to|into) the public {domain}
public-domain: 3: (?:is|are) in the public {domain}
public-domain: 3: no known {copyright} restrictions
public-domain: 3: not {copyrighted}
public-domain: 3: work of the (?:united states|us|u s) {government}
ofl: 2: this font software is licensed under the sil open font {license}
ofl: 2: {scripts} sil org ofl
ofl: 3: with {reserved} font name
postgresql: 2: permission to use copy {modify} and distribute this software and its documentation for any purpose without fee
python: 2: {python} software foundation all rights reserved
php: 3: this product includes {php} software(?: freely available)?
openssl: 3: this product includes software developed by the {openssl} project
openssl: 3: this product includes cryptographic software written by {eric} young
json: 2: the software shall be used for good not {evil}
curl: 2: {curl} se docs copyright html
w3c: 2: {w3} org consortium legal (?:copyright software|[0-9]{4} copyright software and document)
unicode: 2: {unicode} org (?:copyright|license) (?:html|txt)
llama: 2: llama [0-9]+ is licensed under the llama [0-9]+ community {license}
odbl: 2: {opendatacommons} org licenses odbl(?: 1 0)?
odc-by: 2: {opendatacommons} org licenses by(?: 1 0)?
pddl: 2: {opendatacommons} org licenses pddl(?: 1 0)?
ogl: 2: contains public {sector} information licensed under the open government license
etalab: 2: {etalab} gouv fr license ouverte
cecill: 2: {cecill} info
eupl: 2: {joinup} ec europa eu software page eupl
artistic: 3: you may {redistribute} it and or modify it under the same terms as perl itself
ruby: 3: you can {redistribute} it and or modify it under either the terms of the 2 clause bsdl
proprietary: 4: all rights {reserved}
proprietary: 3: {proprietary} and confidential
proprietary: 3: confidential and {proprietary}
proprietary: 3: trade {secrets} (?:of|and)
proprietary: 4: {unauthorized} (?:copying|reproduction|distribution|use)
proprietary: 3: may not be (?:reproduced|copied|redistributed) (?:or [^ ]+ )?without (?:the )?(?:prior |express )?(?:written )?{permission}
proprietary: 3: for {evaluation} (?:purposes )?only
proprietary: 3: end user {license} agreement
proprietary: 3: {eula}
proprietary: 3: non transferable non {exclusive} license
non-commercial: 3: for (?:non )?{commercial|noncommercial} (?:use|purposes) only
non-commercial: 3: not for {commercial} (?:use|purposes|redistribution)
non-commercial: 3: free for {personal|academic|educational} (?:and (?:personal|academic|educational) )?use only
"""


@dataclass(frozen=True)
class Signature:
    """``before`` must match the words that end right before one of ``keywords``, ``ahead`` those from it on."""

    keywords: tuple[str, ...]
    before: str
    ahead: str
    label: str
    priority: int


def _lines(text: str, fields: int = 2) -> list[list[str]]:
    return [line.split(": ", fields - 1) for line in text.strip().splitlines()]


def _signature(pattern: str, label: str, priority: int) -> Signature:
    before, words, rest = re.fullmatch(r"(.*?)\{([a-z0-9|]*)\}(.*)", pattern).groups()
    return Signature(tuple(words.split("|")), before, f"(?:{words}){rest}", label, priority)


@cache
def signatures() -> tuple[Signature, ...]:
    """All rules, best priority first."""
    out = [_signature(p, label, int(priority)) for label, priority, p in _lines(NOTICES, 3)]
    out += [_signature(f"{{spdx}} license identifier {p}(?: {VERSION})?", label, 1) for label, p in _lines(SPDX)]
    out += [_signature(p, label, 4) for label, p in _lines(NAMES)]
    out += [_signature(f"{p} {VERSION}", label, 3) for label, p in _lines(NAMES) + _lines(SHORT)]
    out += [_signature(p if "|" in p.split("}")[0].split("{")[1] else f"{GRANT} {p}", label, 2) for label, p in _lines(GRANTED)]
    return tuple(sorted(out, key=lambda s: (s.priority, s.label, s.ahead, s.before)))


def most_spaces(pattern: str) -> int:
    """The most spaces that a pattern can match: literals, groups, classes without a space, and bounded repeats."""

    def branch(i: int) -> tuple[int, int]:
        best = now = 0
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                best, now, i = max(best, now), 0, i + 1
                continue
            if pattern.startswith("(?:", i):
                n, i = branch(i + 3)
                i += 1
            elif pattern[i] == "[":
                n, i = 0, pattern.index("]", i) + 1
            else:
                n, i = int(pattern[i] == " "), i + 1
            if pattern[i:i + 1] == "{":
                end = pattern.index("}", i)
                n, i = n * int(pattern[i + 1:end].split(",")[-1]), end + 1
            elif pattern[i:i + 1] in ("?", "+", "*") and pattern[i:i + 1]:
                if n and pattern[i] != "?":
                    raise ValueError(f"a signature has no bound: {pattern}")
                i += 1
            now += n
        return max(best, now), i

    return branch(0)[0]


#: Words before a keyword, or before a name for a grant, and from a keyword on, that are looked at: as many as the longest signature spans.
BEFORE = max(max(most_spaces(s.before) for s in signatures()), most_spaces(GRANT) + 1)
SPAN = max(most_spaces(s.ahead) + 1 for s in signatures())


def keywords() -> list[str]:
    """Words at which something is tried; the base phrases' are the last of theirs but for "cc by"."""
    return sorted({w for s in signatures() for w in s.keywords} | {"license", "licence", "cc"})


def _base_at(words: Column, phrase: str, i: Column) -> Column:
    """Whether ``phrase`` ends at word ``i``, or begins there if that is "cc"."""
    parts = phrase.split()
    first = i if parts[0] == "cc" else i - (len(parts) - 1)
    here = [(first + k >= 0) & (F.get(words, first + k) == w) for k, w in enumerate(parts)]
    return F.coalesce(reduce(lambda a, b: a & b, here), F.lit(False))


def _first(phrase: str, i: Column) -> Column:
    """Where a phrase begins that was met at word ``i``."""
    return i if phrase.startswith("cc ") else i - (len(phrase.split()) - 1)


def _around(words: str, begin: str, end: str) -> str:
    """Words ``begin`` to before ``end``, a space on either side of each."""
    return f"concat(' ', CASE WHEN {end} > {begin} THEN concat(array_join(slice({words}, {begin} + 1, {end} - {begin}), ' '), ' ') ELSE '' END)"


def _count(spoken: str) -> str:
    """Words in " word word "; -1 in an empty text."""
    return f"(size(split({spoken}, ' ')) - 2)"


def _tried(s: Signature) -> str:
    ahead, before = f"regexp_extract(x.ahead, '^ (?:{s.ahead}) ', 0)", f"regexp_extract(x.before, ' (?:{s.before})$', 0)"
    fits, start = (f"{ahead} <> '' AND {before} <> ''", f"i - {_count(before)}") if s.before else (f"{ahead} <> ''", "i")
    return f"CASE WHEN {fits} THEN named_struct('start', {start}, 'less_end', -(i + {_count(ahead)}), 'priority', {s.priority}, 'label', '{s.label}') END"


def detections(words: str, places: str) -> Column:
    """``array<struct<start, less_end, priority, label>>`` in the order of starts, the longest of equals first.

    ``words`` and ``places`` are columns' names. At each place, only the rules of the
    word that stands there are tried, so the work grows with the number of keywords
    in the text. One text of SQL, as so many expressions are sooner parsed than put
    together one by one.
    """
    by_words: dict[tuple[str, ...], list[Signature]] = {}
    for s in signatures():
        by_words.setdefault(s.keywords, []).append(s)
    here = []
    for known, rules in by_words.items():
        listed = ", ".join(f"'{k}'" for k in known)
        here.append(f"CASE WHEN get({words}, i) IN ({listed}) THEN array({', '.join(map(_tried, rules))}) END")
    around = f"named_struct('before', {_around(words, f'greatest(i - {BEFORE}, 0)', 'i')}, 'ahead', {_around(words, 'i', f'least(i + {SPAN}, size({words}))')})"
    # one-element transforms bind the words around, and the length of a grant, to a name
    found = f"flatten(transform({places}, i -> flatten(transform(array({around}), x -> filter(flatten(array_compact(array({', '.join(here)}))), d -> d IS NOT NULL)))))"
    behind = _around(words, f"greatest(d.start - {BEFORE}, 0)", "d.start")
    grant = _count(f"regexp_extract({behind}, ' (?:{GRANT} )$', 0)")
    # a name after a grant reaches back over it and is as good as one
    better = "n > 0 AND d.priority > 2"
    longer = f"named_struct('start', CASE WHEN {better} THEN d.start - n ELSE d.start END, 'less_end', d.less_end, 'priority', CASE WHEN {better} THEN 2 ELSE d.priority END, 'label', d.label)"
    return F.expr(f"sort_array(transform({found}, d -> get(transform(array({grant}), n -> {longer}), 0)))")


def unsuppressed(found: Column) -> Column:
    """(labels, best priority) of the detections that lie in no other of the same or better priority.

    In the order of ``detections`` whatever holds an interval comes before it, so the
    furthest end seen at each priority tells.
    """
    levels = sorted(CONFIDENCE)
    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(9).alias("best"), *[F.lit(-1).alias(f"end{p}") for p in levels])

    def step(acc: Column, d: Column) -> Column:
        end = -d["less_end"]
        hidden = F.lit(False)
        for p in levels:
            hidden = hidden | ((d["priority"] >= p) & (acc[f"end{p}"] >= end))
        return F.struct(
            F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(hidden, acc["best"]).otherwise(F.least(acc["best"], d["priority"])).alias("best"),
            *[F.when(d["priority"] == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in levels],
        )

    return F.aggregate(found, start, step)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Base phrases count wherever their words stand in a row. ``labels`` adds those of
    the signatures that were not suppressed; ``score`` is the confidence of the best
    of them, 0.5 for base phrases alone, else 0.

    * null and empty texts have no words and no labels (empty strings; ``first_word`` and ``last_word`` null);
    * each row is scanned by itself: repeated rows and null ids need no care;
    * an empty table gives an empty result; extra columns are not read.

    One pass without a shuffle. Texts without any keyword stop at the prefilter.
    """
    keys = keywords()
    src = pick(docs, id=id_col, text=text_col)
    w = src.select("id", F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), NOT_WORD_RE), "").alias("words"))
    known = F.array(*[F.lit(k) for k in keys])
    words = F.col("words")
    places = F.filter(
        F.transform(words, lambda x, i: F.when(F.array_contains(known, x), i)), lambda i: i.isNotNull()
    )
    none = F.array().cast("array<int>")
    w = w.select("id", "words", F.when(F.arrays_overlap(words, known), places).otherwise(none).alias("places"))
    w = w.withColumn("canonical", F.when(F.size("places") > 0, F.transform(words, lambda x: F.when(x == "licence", "license").otherwise(x))))
    hits = [F.transform(F.filter("places", partial(_base_at, words, phrase)), partial(_first, phrase)) for phrase, _ in BASE]
    w = w.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        *[h.alias(f"base{k}") for k, h in enumerate(hits)],
        F.when(F.size("places") > 0, unsuppressed(detections("canonical", "places"))).alias("seen"),
    )
    all_hits = F.concat(*[F.col(f"base{k}") for k in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"base{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    no_labels = F.array().cast("array<string>")
    score = F.coalesce(*[F.when(F.col("seen.best") == p, F.lit(c)) for p, c in CONFIDENCE.items()], F.when(F.size(all_hits) > 0, F.lit(BASE_CONFIDENCE)), F.lit(0.0))
    return w.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(all_hits).cast("long").alias("n_base"),
        F.array_min(all_hits).cast("long").alias("first_word"),
        F.array_max(all_hits).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("seen.labels", no_labels))), ",").alias("labels"),
        score.alias("score"),
    )
