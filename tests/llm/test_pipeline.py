import pytest

import corpus_pipeline
from cohortloom.llm.queries import oracle_sql, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == COLUMNS
            assert 0 < after.count() <= docs.count()
            docs = after
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert whole.select("sequence_id", "offset").distinct().count() == whole.count()


def test_names_and_sql():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert oracle_sql().keys() <= queries().keys()


def test_sql_twins(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, sf)
        got = sorted((tuple(r[k] for k in sorted(df.columns)) for r in df.collect()), key=str)
        q = c.execute(sql)
        cols = [d[0] for d in q.description]
        order = [cols.index(k) for k in sorted(df.columns)]
        want = sorted((tuple(r[i] for i in order) for r in q.fetchall()), key=str)
        assert got == want, name


def kept_lines(rows):
    from test_lines_and_rules import plain_line_dedup

    return {i: t for i, t, _, _ in plain_line_dedup(rows)}


def near_copies(texts):
    """Ids that go: all but the smallest of each group of pairs of 0.8 and more."""
    from test_links import Groups

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, g = {i: shingles(t) for i, t in texts.items()}, Groups()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                g.join(a, b)
    return {i for i in sets if g.find(i) != i}


def test_run_against_brute_force(spark, sf):
    """All stages again by plain loops, on two hundred documents."""
    import math
    import zlib

    import numpy as np
    import public_tokenizers
    from test_tokens import check_packing
    from tokenizers import Tokenizer

    from cohortloom.llm import quality as q
    from cohortloom.llm.decontaminate import align
    from cohortloom.llm.tokens import plain_words

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    _, scorer = q.train(q.read_texts(docs))

    def score(text):
        words = text.split()
        b = [zlib.crc32(q.shape(w).encode()) % (q.BUCKETS - 1) for w in words] + [q.BUCKETS - 1 for x, y in zip(words, words[1:]) if x == y]
        return scorer.bias + sum(scorer.weights[k] for k in b) / max(len(words), 1)

    good = {i: t for i, t in texts.items() if 1 / (1 + math.exp(-max(-35, min(35, score(t))))) >= 0.5}
    assert 0.7 * len(texts) < len(good) < len(texts)
    unlike = kept_lines(list(good.items()))
    gone = near_copies(unlike)
    assert gone
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := plain_words(r.text))]

    def leaks(text):
        words = plain_words(text)
        for item in items:
            code = {w: k for k, w in enumerate(dict.fromkeys(item))}
            need = len(item) if len(item) < 8 else 0.5 * len(item)
            if align(np.array([code[w] for w in item]), np.array([code.get(w, -1) for w in words], np.int64))[0] >= need:
                return True
        return False

    want = {i: t for i, t in unlike.items() if i not in gone and not leaks(t)}
    assert len(want) < len(unlike) - len(gone)
    pieces = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    check_packing(pieces, want, Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))))


@pytest.mark.parametrize("rows", [
    [],
    [(None, None), (None, "no id"), (1, None), (1, ""), (2, "same words here"), (2, "same words here"), (3, "same words here"), (4, "long " * 60_000), (5, "\n" * 3000)],
])
def test_run_on_odd_tables(spark, tmp_path, rows):
    """No rows; null ids and texts, repeated rows, ties, long texts and columns with the stages' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, mark int, seen int, hits string, c0 int"
    full = [(i, t, "en", None, None, "x", 1, 2, "y", None) for i, t in rows]
    spark.createDataFrame(full, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item of the benchmark that no text holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {i for i, _ in rows} and (not rows or None in {r.doc_id for r in got})
    by_doc = {}
    for r in got:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert 3 not in by_doc


def test_tables_between_stages_go(spark, sf):
    """A run leaves its result in the shared folder and nothing else."""
    from pathlib import Path

    from cohortloom.llm.common import checkpoint_dir

    root = Path(checkpoint_dir(spark).removeprefix("file://"))
    before = set(root.iterdir())
    corpus_pipeline.run(spark, sf)
    new = set(root.iterdir()) - before
    assert len(new) == 1 and [p.name for p in new.pop().iterdir()] == [str(len(corpus_pipeline.STAGES) - 1)]
