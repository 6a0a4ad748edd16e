import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortloom.llm.packing import Piece, Windows, pack, pack_pieces, word_ids
from cohortloom.llm.token_counts import counter, token_counts

WORDS, BYTES = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", " ", "\n\n", "a  b", " lead", "trail ", "tab\there", "I'll we'Re don't ''s", "İstanbul ΣΑΣ", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "naïve é ŁÓDŹ ß ẞ", "12³½ 12345",
    "你好 世界", " x y\x1cz", "!!! $$$ a%%% b.,;", "\r\n mixed \x0b ends \x0c", "word " * 700, "ñ" * 500, "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "\u0085x", "don’t",
]
text = st.text(st.one_of(st.sampled_from(" \n\t'abcdefgstTHE,.%0159éÉß"), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def exact():
    return {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


@pytest.mark.parametrize("t", ODD)
def test_odd_texts(exact, t):
    assert counter(BYTES).count(t) == len(exact[BYTES].encode(t, add_special_tokens=False).ids)
    assert list(word_ids(WORDS).ids(t)) == exact[WORDS].encode(t, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(text)
def test_any_text(t):
    exact = {p: Tokenizer.from_file(p) if p not in _cache else _cache[p] for p in (WORDS, BYTES)}
    _cache.update(exact)
    assert counter(BYTES).count(t) == len(exact[BYTES].encode(t, add_special_tokens=False).ids)
    assert list(word_ids(WORDS).ids(t)) == exact[WORDS].encode(t, add_special_tokens=False).ids


_cache: dict = {}


def test_counts_of_a_table(spark, docs_of, exact, sf):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, None), (3, None)]
    out = token_counts(docs_of(rows), BYTES)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    want = [(str(i), len((t or "").encode()), n := len(exact[BYTES].encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert got == sorted(want)
    assert token_counts(docs_of([]), BYTES).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(exact[BYTES].encode(texts[r.doc_id], add_special_tokens=False).ids) for r in token_counts(docs, BYTES).collect())


def test_caches_that_overflow(monkeypatch, exact):
    import cohortloom.llm.packing as p
    import cohortloom.llm.token_counts as c

    monkeypatch.setattr(p, "WORDS", 5)
    monkeypatch.setattr(c, "REMEMBERED", 5)
    w, n = p.WordIds(WORDS), c.PairCounter(BYTES)
    for t in ODD + ["one two three four five six seven eight nine ten " * 3]:
        assert list(w.ids(t)) == exact[WORDS].encode(t, add_special_tokens=False).ids
        assert n.count(t) == len(exact[BYTES].encode(t, add_special_tokens=False).ids)


def check_packing(pieces, docs, exact, window=2048):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_seq.setdefault(p[5], []).append(p)
    assert by_doc.keys() == docs.keys()
    for d, t in docs.items():
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for _, start, n, crc, total, _, _, _ in sorted(by_doc[d], key=lambda p: p[1]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + n].tobytes()))
            at += n
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at == window or at & (at - 1) == 0


def test_packing_of_a_table(spark, docs_of, exact, sf):
    rows = list(enumerate(ODD + [None, "many words " * 5000]))
    check_packing([tuple(r) for r in pack(docs_of(rows), WORDS).collect()], dict(rows), exact[WORDS])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pack(docs, WORDS).collect()
    check_packing([tuple(r) for r in out], {r.doc_id: r.text for r in docs.collect()}, exact[WORDS])
    assert pack(docs_of([]), WORDS).count() == 0
    twice = pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), WORDS).collect()
    assert sum(r.length for r in twice) == 3 + 3 + 2 and sum(r.doc_id is None for r in twice) == 1


def test_ids_come_back_exactly(spark):
    """Large ids beside null ones, which no double can hold, and ids that are text."""
    big = [(1 << 60) + 1, (1 << 53) + 1, -(1 << 62) - 1, None]
    df = spark.createDataFrame([(i, "a b") for i in big], "doc_id long, text string")
    assert sorted(map(str, [r.doc_id for r in pack(df, WORDS).select("doc_id").distinct().collect()])) == sorted(map(str, big))
    named = spark.createDataFrame([("x", "a b"), (None, "c")], "name string, body string")
    assert {r["name"] for r in pack(named, WORDS, "name", "body").collect()} == {"x", None}


@pytest.mark.parametrize("most_open", [1, 3, 2048])
def test_few_windows_open(exact, most_open):
    docs = {i: "some words to pack " * (i % 37) for i in range(300)}
    check_packing(list(pack_pieces(iter(docs.items()), word_ids(WORDS).ids, most_open=most_open)), docs, exact[WORDS])


def test_most_tokens_stay_where_the_rule_put_them(spark):
    """On a thousand documents in one task; the more there are, the less moves."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    row = pack(docs, WORDS).selectExpr("sum(length) as n", "sum(if(moved, length, 0)) as moved").first()
    assert row.moved < 0.1 * row.n


def test_sum_of_squares_choice():
    w = Windows(10)
    for size in (6, 6, 3, 4, 2, 5, 1, 7, 3, 3, 8, 2):
        n = w.levels.copy()
        before = int((n[1:10] ** 2).sum())
        costs = {}
        for level in range(0, 10 - size + 1):
            if level and not n[level]:
                continue
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 10:
                m[level + size] += 1
            costs[level] = int((m[1:10] ** 2).sum()) - before
        assert costs[w.choose(size)] == min(costs.values())
        list(w.place(Piece(None, 0, np.zeros(size, "<u4"), size)))
