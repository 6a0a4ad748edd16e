import random
import re
import zlib
from collections import Counter

import pytest

from cohortloom.llm import spelling
from cohortloom.llm.spelling import near_words, spelling_variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows, typo=97):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo and h % typo == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain(rows, typo=97):
    n = plain_counts(rows, typo)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def some_rows(n=200):
    rnd = random.Random(11)
    base = ["colour", "naïveté", "straße", "licence", "recieve", "abcde", "zzzzz", "École", "ÉCOLE", "übermut"]

    def edited(w):
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2, 3])):
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice("abzéÿ") + w[i:], w[:i] + rnd.choice("abzéÿ") + w[i + 1:]]) or "a"
        return w

    pool = [edited(rnd.choice(base)) for _ in range(400)] + base * 10
    rows = [(i, rnd.choice([" ", "-", "\n", "1"]).join(rnd.choices(pool, k=rnd.randint(1, 60)))) for i in range(n)]
    return rows + [(n, None), (n, ""), (None, "colour colour colour"), (5, rows[5][1]), (n + 1, "licence licenze " * 5000), (n + 2, "x" * 30000 + " ") , (n + 3, ("y" * 3000 + " ") * 3 + ("y" * 2999 + " ") * 9)]


@pytest.mark.parametrize("typo", [97, 3, 0])
def test_against_plain_loop(docs_of, typo):
    rows = some_rows()
    want = plain(rows, typo)
    assert any(r[1] and r[1] != r[2] for r in want)
    assert got(spelling_variants(docs_of(rows).repartition(3), typo=typo)) == want


def test_small_stores_and_no_rows(docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    assert got(spelling_variants(docs_of(some_rows(40)))) == plain(some_rows(40))
    assert spelling_variants(docs_of([])).count() == 0


def test_every_pair_of_short_words(spark):
    letters = "abé"
    words = [""]
    for _ in range(6):
        words += [w + c for w in words if len(w) == max(map(len, words)) for c in letters]
    rnd = random.Random(2)
    words = rnd.sample(words, 400)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    found = [tuple(r) for r in near_words(df).select("a", "b").collect()]
    assert sorted(tuple(sorted(p)) for p in found) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_chain_of_forms(docs_of):
    # each word one edit from the next, twice as frequent
    chain = ["aaaaaaa"]
    for i in range(7):
        chain.append(chain[-1][:i] + "b" + chain[-1][i + 1:])
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2 ** k))
    out = {r.word: r for r in spelling_variants(docs_of([(1, text)]), typo=0).collect()}
    assert {r.root for r in out.values()} == {chain[-1]} and out[chain[0]].form == chain[1]
