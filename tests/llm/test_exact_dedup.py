import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import exact_dedup as ed
from cohortloom.llm import quotient_filter as qf
from cohortloom.llm.exact_dedup import distinct_texts, exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, order[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(order)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(n=400, seed=3):
    rnd = random.Random(seed)
    pool = ["", " ", "\t\n", "one text", "one  text", "one\ntext", "One text", " one text", "ünï", "x" * 5000, "word " * 9000] + [f"text {k}" for k in range(150)]
    return [(i, rnd.choice(pool)) for i in range(n)] + [(n, None), (None, "one text"), (None, "only without id"), (None, "only without id"), (7, "shared id"), (7, "shared id"), (7, "else")]


@pytest.mark.parametrize("bits", [64, 6])
def test_against_plain_loop(docs_of, bits):
    rows = some_rows()
    assert got(exact_dedup(docs_of(rows), bits=bits)) == plain(rows)


def test_small_filters_blocks_and_hot_text(docs_of, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ed, "HOT_TEXTS", 20)
    monkeypatch.setattr(ed, "SALTS", 7)
    rows = some_rows(300, 4) + [(1000 + i, "hot text") for i in range(300)]
    assert got(exact_dedup(docs_of(rows).repartition(13))) == plain(rows)


def test_empty_table(docs_of):
    assert exact_dedup(docs_of([])).count() == 0 and distinct_texts(docs_of([])).count() == 0


def test_text_ids_and_clashing_names(spark):
    df = spark.createDataFrame([("b", "t", 1, "x"), ("a", "t ", 2, "y"), ("c", "u", 3, "z"), ("d", "t ", 4, "v")], "doc_id string, text string, fp int, kept string")
    assert got(exact_dedup(df))[:2] == [("a", "a", 2, True, hashlib.sha256(b"t ").hexdigest()), ("b", "b", 1, True, hashlib.sha256(b"t").hexdigest())]
    assert got(distinct_texts(df)) == [("a", "t ", 2, "y"), ("b", "t", 1, "x"), ("c", "u", 3, "z")] and distinct_texts(df).dtypes == df.dtypes


@pytest.mark.parametrize("bits", [64, 4])
def test_rows_that_stay(docs_of, bits):
    rows = some_rows()
    df = docs_of(rows)
    out = distinct_texts(df, bits=bits)
    assert out.dtypes == df.dtypes
    assert sorted(((r[0], norm(r[1])) for r in out.collect()), key=str) == sorted(((keep, t) for t, keep in {norm(t): min((i for i, u in rows if norm(u) == norm(t) and i is not None), default=None) for _, t in rows}.items()), key=str)


def test_without_a_checkpoint_folder(spark, docs_of, monkeypatch):
    from cohortloom.llm import common

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default, f=type(spark.conf).get: default[0] if key == "spark.checkpoint.dir" else f(self, key, *default))
    assert common.checkpoint_dir(spark) == common.checkpoint_dir(spark)
    assert got(exact_dedup(docs_of([(1, "a"), (2, "a")]))) == plain([(1, "a"), (2, "a")])


values = st.lists(st.tuples(st.integers(0, 2**64 - 1), st.sampled_from([1, 2, 254, 255, 256, 10**12])), max_size=80, unique_by=lambda x: x[0])


@settings(max_examples=300, deadline=None)
@given(values, st.sampled_from([0, 1, 7]))
def test_filters_lose_nothing(pairs, top):
    block = 1 if top else 0
    width = 64 - top
    pairs = sorted({(p & ((1 << width) - 1)) | (block << width): c for p, c in pairs}.items())
    prints, counts = np.array([p for p, _ in pairs], np.uint64), np.array([c for _, c in pairs], np.int64)
    back = qf.decode(qf.encode(prints, counts, top), top, block)
    assert back[0].tolist() == prints.tolist() and back[1].tolist() == counts.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=30), min_size=1, max_size=5))
def test_merge_adds_counts(lists):
    parts = []
    for xs in lists:
        prints, counts = np.unique(np.array(xs, np.uint64) << np.uint64(58), return_counts=True)
        parts.append(qf.decode(qf.encode(prints, counts)))
    prints, counts = qf.merge(parts)
    whole = np.unique(np.array([x for xs in lists for x in xs], np.uint64) << np.uint64(58), return_counts=True)
    assert prints.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()
