import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cohortloom.llm import resampling as rs
from cohortloom.llm.resampling import importance, resampled

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(t, longest):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(t)
    return w, Counter(" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))


def plain(rows, target, longest=1, buckets=10000, min_words=20, percent=10, seed="2024"):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, x in rows:
        for f, n in plain_features(x, longest)[1].items():
            s[bucket(f)] += n
    for x in target:
        for f, n in plain_features(x, longest)[1].items():
            t[bucket(f)] += n
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        words, found = plain_features(x, longest)
        weight = sum(n * math.floor(1000 * math.log((t[bucket(f)] + 1) * (ss + buckets) / ((s[bucket(f)] + 1) * (tt + buckets)))) for f, n in found.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    enough = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {id(r): k + 1 for k, r in enumerate(enough[:percent * len(enough) // 100])}
    return sorted(((*r[:4], places.get(id(r))) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(n=300):
    rnd = random.Random(8)
    pool = ["the", "The", "of", "naïve", "ÉCOLE", "x1", "don't", "a-b", "日本", *[f"word{k}" for k in range(60)], "y" * 100, "z" * 65, "é" * 40]
    rows = [(i, " ".join(rnd.choices(pool, k=rnd.randint(1, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " .,"), (None, "word1 the " * 15), (3, rows[3][1]), (3, rows[3][1]), (n + 3, "the of " * 20000)]


TARGET = ["word1 word2 the naïve", "word1 " + "y" * 100, None, "", "日本 nowhere else"]


@pytest.mark.parametrize("longest,common,percent", [(1, 20_000, 10), (1, 40, 35), (3, 100, 50)])
def test_against_plain_loop(docs_of, spark, monkeypatch, longest, common, percent):
    monkeypatch.setattr(rs, "COMMON", common)
    rows = some_rows()
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id int, text string")
    assert got(importance(docs_of(rows).repartition(5), target, longest=longest, percent=percent)) == plain(rows, TARGET, longest=longest, percent=percent)


def test_small_stores(docs_of, spark, monkeypatch):
    monkeypatch.setattr(rs, "HELD_FEATURES", 30)
    target = spark.createDataFrame([("a",)], "text string")
    assert got(importance(docs_of(some_rows(50)), target, buckets=7)) == plain(some_rows(50), ["a"], buckets=7)


def test_empty_tables(docs_of, spark):
    none = spark.createDataFrame([], "text string")
    assert importance(docs_of([]), none).count() == 0
    rows = [(i, "one two three four five " * 5) for i in range(20)]
    assert got(importance(docs_of(rows), none)) == plain(rows, [])


def test_drawn_rows(docs_of, spark):
    rows = some_rows()
    df = docs_of(rows)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = resampled(df, target, percent=20)
    ids = Counter(r[0] for r in plain(rows, TARGET, percent=20) if r[4])
    assert out.dtypes == df.dtypes
    assert {r[0] for r in out.collect()} == set(ids)


def test_ties_go_to_the_smaller_id(docs_of, spark, monkeypatch):
    monkeypatch.setattr(rs.F, "sha2", lambda c, bits, f=rs.F.sha2: f(rs.F.lit("same"), bits))
    target = spark.createDataFrame([("a",)], "text string")
    out = importance(docs_of([(i, "same words here " * 10) for i in (5, 3, 9, 1, 7, 2, 8, 4, 6, 0)]), target, percent=30)
    assert {r.doc_id: r["rank"] for r in out.collect() if r["rank"]} == {0: 1, 1: 2, 2: 3}
