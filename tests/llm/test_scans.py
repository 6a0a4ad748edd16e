import random
import re
from collections import Counter, defaultdict

import pytest

from cohortloom.llm.license_scan import BASE, BEFORE, CONFIDENCE, GRANT, SPAN, keywords, license_scan, signatures
from cohortloom.llm.url_filter import MAX_CHILDREN, MIN_LABELLED, MIN_SHARE, RULES, SIMILAR, SMOOTHING, url_filter


def plain_scan(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]
    base = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    same = ["license" if w == "licence" else w for w in words]

    def text(part):
        return " " + "".join(w + " " for w in part)

    found = []
    for i, w in enumerate(same):
        for s in signatures():
            if w not in s.keywords:
                continue
            m = re.match(f" (?:{s.ahead}) ", text(same[i : i + SPAN]))
            n = re.search(f" (?:{s.before})$", text(same[max(0, i - BEFORE) : i]))
            if not m or (s.before and not n):
                continue
            a, p = i - (len(n.group().split()) if s.before else 0), s.priority
            if p > 2 and (g := re.search(f" (?:{GRANT} )$", text(same[max(0, a - BEFORE) : a]))):
                a, p = a - len(g.group().split()), 2
            found.append((a, i + len(m.group().split()), p, s.label))
    kept = []
    for k, (a, z, p, label) in enumerate(found):
        hidden = any(b <= a and y >= z and o <= p and ((b, -y, o, other) < (a, -z, p, label)) for j, (b, y, o, other) in enumerate(found) if j != k)
        if not hidden:
            kept.append((p, label))
    labels = {x for _, x in base} | {x for _, x in kept}
    score = CONFIDENCE[min(p for p, _ in kept)] if kept else 0.5 if base else 0.0
    at = [i for i, _ in base]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


TEXTS = [
    "Released under the MIT License.", "mit license mit LICENSE", "Licensed under the Apache License, Version 2.0.", "This is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "GNU Lesser General Public License v2.1", "mit der license, nicht", "Apache license", "apache\nlicense!", "gnu general public",
    "BSD 3-Clause", "Modified BSD License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "All rights reserved.", "released into the public domain", "Creative Commons Attribution-ShareAlike 4.0",
    None, "", "...", "über license Änd", "the unlicense", "cc by", "Proprietary and confidential", "Mozilla Public License 2.0 and Eclipse Public License 1.0",
]


def scan(df):
    return sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in license_scan(df).collect())


def test_scan_against_plain_loop(docs_of):
    rnd = random.Random(3)
    names = [t for t in TEXTS if t]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rnd.choices(names + ["plain words", "mit", "license", "gnu", "-"], k=rnd.randint(1, 8)))) for i in range(60)]
    rows += [(3, TEXTS[0]), (3, TEXTS[0]), (None, TEXTS[2]), (400, ("filler words here " * 50 + TEXTS[3] + "\n") * 40)]
    assert scan(docs_of(rows)) == sorted((str(i), *plain_scan(t)) for i, t in rows)


def test_scan_labels(docs_of):
    got = {r[0]: (r[5], r[6], r[7]) for r in scan(docs_of(TEXTS))}
    assert got["3"] == ("gpl", "gpl", 0.9) and got["4"] == ("cc-by", "cc-by,cc-by-nc", 0.9) and got["5"][1:] == ("gpl", 1.0) and got["6"] == ("", "lgpl", 0.8)
    assert got["7"][1] == "" and got["8"][:2] == ("apache", "apache")
    assert scan(docs_of([])) == [] and len(signatures()) > 400
    assert [s.priority for s in signatures()] == sorted(s.priority for s in signatures())


#: Texts and what a reader would label them with.
LABELLED = [
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 2 of the License, or (at your option) any later version.", "gpl"),
    ("You should have received a copy of the GNU Lesser General Public License along with this library.", "lgpl"),
    ("Available under the GNU Affero General Public License v3.0 or later", "agpl"),
    ("see https://www.gnu.org/licenses/gpl-3.0.html", "gpl"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
    ("https://opensource.org/licenses/MIT", "mit"), ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa"), ("// SPDX-License-Identifier: MPL-2.0", "mpl"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used", "bsd"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("Boost Software License - Version 1.0", "boost"), ("Released under the MIT licence", "mit"), ("released under MIT", "mit"), ("distributed under the terms of the MIT", "mit"), ("dual-licensed under GPLv2", ""),
    ("GPL v3", "gpl"), ("the eclipse of the sun", ""), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "cc-by-nc-nd"), ("CC0", "cc0"), ("released under the BSL 1.1", "boost"),
    ("The Software shall be used for Good, not Evil.", "json"), ("Llama 3 Community License Agreement", "llama"), ("as a special exception to the GNU General Public License", "gpl"), ("Classpath exception", "gpl"),
    ("This work has been put into the public domain.", "public-domain"), ("No known copyright restrictions", "public-domain"), ("All rights reserved.", "proprietary"), ("Proprietary and confidential", "proprietary"),
    ("fish licence, driving license", ""), ("mit dem Hund", ""), ("For non-commercial use only", "non-commercial"), ("SIL Open Font License 1.1", "ofl"), ("under the PostgreSQL Licence", "postgresql"),
]


def test_labels_a_reader_would_give(docs_of):
    got = {int(r[0]): r[6] for r in scan(docs_of([t for t, _ in LABELLED]))}
    wrong = [(t, want, got[i]) for i, (t, want) in enumerate(LABELLED) if got[i] != want]
    assert not wrong


def test_few_documents_pass_the_prefilter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    words = "split(lower(coalesce(text, '')), '[^a-z0-9\\u0080-\\uffff]+')"
    known = ", ".join(f"'{k}'" for k in keywords())
    assert docs.selectExpr(f"arrays_overlap({words}, array({known})) as passes").where("passes").count() < 0.1 * docs.count()


def plain_urls(rows):
    """Verdicts by a loop over hosts and levels."""
    parsed = []
    for i, url in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        segs = []
        parts = [p for p in path.split("/") if p]
        for s in parts:
            segs.append("{n}" if re.fullmatch(r"[0-9]+(\.[a-z]{1,5})?", s) else "{x}" if re.fullmatch(r"[0-9a-fA-F-]{8,}", s) else "{s}" if len(s) > 40 or re.search("-.*-.*-", s) else s)
        parsed.append((i, host, path, rule, tuple(segs)))
    prefix = {(h, s): "" for _, h, _, _, s in parsed}
    live = set(prefix)

    def count(keys, some=lambda h, s: True):
        c = defaultdict(lambda: [0, 0, 0])
        for _, h, _, r, s in (p for p in parsed if some(p[1], p[4])):
            x = c[keys(h, s)]
            x[0] += 1
            x[1] += r is not None and r.verdict == "allow"
            x[2] += r is not None and r.verdict == "block"
        return c

    level = 0
    while live:
        def seg(s, level=level):
            return s[level] if len(s) > level else ""

        nodes = count(lambda h, s: (h, prefix[h, s], seg(s)), lambda h, s: (h, s) in live)
        parents = count(lambda h, s: (h, prefix[h, s]), lambda h, s: (h, s) in live)
        children = Counter((h, p) for h, p, _ in nodes)
        names, ends = {}, set()
        for (h, p, g), (n, a, b) in nodes.items():
            all_n, all_a, all_b = parents[h, p]
            if all_a + all_b < MIN_LABELLED or not all_b or all_n == all_a + all_b:
                names[h, p, g] = "/**"
                ends.add((h, p, g))
                continue
            if g == "":
                ends.add((h, p, g))
            pooled = all_a / (all_a + all_b)
            told = a + b >= MIN_LABELLED
            similar = told and abs(a / (a + b) - pooled) <= SIMILAR * (pooled * (1 - pooled) / (a + b)) ** 0.5 + 1e-12 and children[h, p] > 1
            rare = children[h, p] > MAX_CHILDREN and n < MIN_SHARE * all_n and not told
            names[h, p, g] = "" if g == "" else "/*" if rare or similar else "/" + g
        at = {(h, s): (h, prefix[h, s], seg(s)) for h, s in live}
        prefix |= {k: prefix[k] + names[x] for k, x in at.items()}
        live = {k for k, x in at.items() if x not in ends}
        level += 1
    leaves, hosts = count(lambda h, s: (h, prefix[h, s])), count(lambda h, s: h)
    a, b = sum(x[1] for x in hosts.values()), sum(x[2] for x in hosts.values())
    p0 = (a + 1) / (a + b + 2)
    out = []
    for i, h, path, rule, s in parsed:
        (_, ha, hb), (_, la, lb) = hosts[h], leaves[h, prefix[h, s]]
        purity = (la + SMOOTHING * (ha + SMOOTHING * p0) / (ha + hb + SMOOTHING)) / (la + lb + SMOOTHING)
        verdict = rule.verdict if rule else "block" if la + lb >= MIN_LABELLED and purity < 0.5 else "allow"
        out.append((str(i), h, path, rule.name if rule else None, verdict, h + prefix[h, s], round(purity, 6)))
    return sorted(out, key=str)


def urls(spark, rows):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, Path string")
    return sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 6)) for r in url_filter(df).collect()), key=str)


def test_urls_against_plain_loop(spark):
    rnd = random.Random(11)
    hosts = ["a.com", "www.a.COM", "b.net", "x.example.org", "example.org", "notexample.org", "com", "a.com:80"]
    rows = [(i, f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}/{rnd.choice(['fr', 'de', 'en', 'es', 'FR'])}/{rnd.choice([str(rnd.randrange(300)), 'tag', 'a-b-c-d', 'deadbeef99', 'page' + str(rnd.randrange(40))])}{rnd.choice(['', '/', '/more/and/more', '.html', '?q=1', '#x'])}") for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "no scheme"), (1003, "http://"), (1004, "http://a.com"), (1005, "http://a.org?x=/y"), (1006, "x://y://z.com/fr/1"), (1007, "http://example.org/en/19"), (1008, "http://example.org/en/2"), (5, "http://a.com/fr/1"), (5, "http://a.com/fr/1"), (None, "http://a.com/de/")]
    assert urls(spark, rows) == plain_urls(rows)
    assert urls(spark, []) == []


def test_hot_urls(spark):
    """A third of all pages without a url, and a host with most paths: the joins deal them out, with the results of a plain loop."""
    rows = [(i, None) for i in range(400)] + [(1000 + i, f"http://big.com/{'fr' if i % 3 else 'de'}/{i % 150}/x{i % 7}") for i in range(600)] + [(2000 + i, f"http://h{i}.net/a") for i in range(200)]
    assert urls(spark, rows) == plain_urls(rows)


@pytest.mark.parametrize("url, want", [
    ("http://sub.example.org/es/1", ("example.org/es/", "block")), ("http://example.org/en/1", ("example.org/en/1", "block")), ("http://example.org/en/2", ("org/", "allow")),
    ("http://x.com/fr/a", ("com/fr/", "allow")), ("http://x.com/de/a", ("com/de/", "block")), ("http://x.net/de/a", (None, "allow")), ("http://a.org", (None, "allow")),
])
def test_rules(spark, url, want):
    assert urls(spark, [(1, url)])[0][3:5] == want


def test_templates_below_any_level(spark):
    """Pages far down a path are told apart there; a large blocked branch among many is no wildcard."""
    from pyspark.sql import functions as F

    from cohortloom.llm.url_filter import templates

    rows = [("h", ["a", "b", "c", "d", "e", f"good{i % 3}"], "allow") for i in range(60)] + [("h", ["a", "b", "c", "d", "e", "bad"], "block") for _ in range(30)]
    rows += [("h", ["a", "b", "c", "d", "e", "bad"], None), ("h", ["a", "b", "c", "d", "e", "good1"], None)]
    rows += [("w", [f"clean{i % 30}"], "allow") for i in range(3000)] + [("w", ["spam"], "block")] * 80 + [("w", ["spam"], None), ("w", ["clean7"], None)]
    rows += [("deep", [str(i) for i in range(3000)], "allow")] * 5
    t = templates(spark.createDataFrame(rows, "host string, segs array<string>, label string"))
    got = {(r.host, r.segs[-1]): r for r in t.collect()}
    assert got["h", "bad"].template == "h/a/b/c/d/e/bad" and got["h", "bad"].purity < 0.5 < got["h", "good1"].purity
    assert got["w", "spam"].template == "w/spam" and got["w", "spam"].purity < 0.5 < got["w", "clean7"].purity
    assert got["deep", "2999"].template == "deep/**" and t.agg(F.count("*")).first()[0] == len({(h, tuple(s)) for h, s, _ in rows})


def spoken(pattern, choose):
    """A text that a signature's pattern matches; ``choose`` picks among alternatives and numbers of repeats."""

    def branch(i):
        options, now = [], ""
        while i < len(pattern) and pattern[i] != ")":
            if pattern[i] == "|":
                options.append(now)
                now, i = "", i + 1
                continue
            if pattern.startswith("(?:", i):
                one, i = branch(i + 3)
                i += 1
            elif pattern[i] == "[":
                end = pattern.index("]", i)
                inside = pattern[i + 1:end]
                one, i = ("x" if inside.startswith("^") else inside[0]), end + 1
            else:
                one, i = pattern[i], i + 1
            least = most = 1
            if i < len(pattern) and pattern[i] == "{":
                end = pattern.index("}", i)
                bounds = pattern[i + 1:end].split(",")
                least, most, i = int(bounds[0]), int(bounds[-1]), end + 1
            elif i < len(pattern) and pattern[i] in "?+*":
                least, most = {"?": (0, 1), "+": (1, 2), "*": (0, 2)}[pattern[i]]
                i += 1
            now += one * choose([least, most])
        return choose([*options, now]), i

    return branch(0)[0]


def test_every_rule_finds_its_own_text(spark):
    """A rule's shortest, longest and some other texts, between other words: it is detected with its label and priority."""
    import random

    from cohortloom.llm.license_scan import detections, most_spaces

    rnd = random.Random(7)
    rows = []
    for n, s in enumerate(signatures()):
        texts = {spoken(s.before + s.ahead, c) for c in (lambda x: min(x, key=lambda v: (v if isinstance(v, int) else len(v))), lambda x: max(x, key=lambda v: (v if isinstance(v, int) else len(v))), rnd.choice, rnd.choice)}
        rows += [(n, ("some other words " + t + " and more").split(), s.label, s.priority) for t in texts]
    assert len({r[0] for r in rows}) == len(signatures()) and max(len(r[1]) for r in rows) > BEFORE
    df = spark.createDataFrame(rows, "n int, words array<string>, label string, priority int")
    known = ", ".join(f"'{k}'" for k in keywords())
    df = df.selectExpr("*", f"filter(transform(words, (w, i) -> CASE WHEN array_contains(array({known}), w) THEN i END), i -> i IS NOT NULL) AS places")
    got = df.select("n", "words", "label", "priority", detections("words", "places").alias("found")).collect()
    lost = [(r.n, " ".join(r.words)) for r in got if not any(d.label == r.label and d.priority <= r.priority for d in r.found)]
    assert not lost, lost[:5]
    assert [most_spaces(p) for p in ("a b", "a(?: b(?: c){0,3})? d|e", "[^ ]+ [0-9]+", "")] == [1, 5, 1, 0]
    with pytest.raises(ValueError):
        most_spaces("a(?: b)+")
