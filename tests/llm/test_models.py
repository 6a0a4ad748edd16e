import math
import random
import zlib

import numpy as np
import pytest

from cohortloom.llm import quality as q
from cohortloom.llm import toxicity as x
from cohortloom.llm.quality import fit_labellers, keep_good, quality
from cohortloom.llm.tokens import plain_words
from cohortloom.llm.toxicity import fit, toxicity

SF = "/root/testdata/sf0.1"


def test_ordinal_model_recovers_order():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(4000):
        b = np.unique(np.concatenate([rng.integers(0, 400, 20), rng.integers(3, 43, 1)]))
        margin = 3.0 * ((b == 3).any() + (b == 4).any()) - 4 + rng.logistic()
        rows.append((b, np.ones(len(b), np.int64)))
        grades.append(int(margin > 0) + int(margin > 3))
    m = fit(rows, np.array(grades), 3)
    assert m.thresholds[0] < m.thresholds[1]
    assert min(m.weights[3], m.weights[4]) > 1.5 and all(abs(v) < 1 for b, v in m.weights.items() if b not in (3, 4))
    p = m.over(np.array([-9.0, 0.0, 9.0]))
    assert (np.diff(p.sum(1)) > 0).all() and (p[:, 0] >= p[:, 1]).all()


def test_ordinal_model_without_data():
    for rows, grades in (([], []), ([(np.array([1]), np.array([1]))] * 3, [0, 0, 0])):
        m = fit(rows, np.array(grades), 3)
        assert m.weights == {} and m.over(np.zeros(1))[0, 0] < 1e-9


def test_ordinal_gradient():
    """The fit is a stationary point: no small step of a threshold lowers the loss."""
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 200, 6)), None) for _ in range(400)]
    rows = [(b, np.ones(len(b), np.int64)) for b, _ in rows]
    grades = rng.integers(0, 3, 400)
    m = fit(rows, grades, 3, rounds=2000)

    def loss(t):
        margin = np.array([sum(m.weights.get(int(i), 0.0) for i in b) for b, _ in rows])
        over = np.c_[np.ones(400), 1 / (1 + np.exp(t[None, :] - margin[:, None])), np.zeros(400)]
        return -np.log(over[np.arange(400), grades] - over[np.arange(400), grades + 1]).sum()

    at = loss(m.thresholds)
    for d in (np.array([0.02, 0.0]), np.array([0.0, 0.02]), np.array([0.02, 0.02])):
        assert loss(m.thresholds + d) >= at - 1e-3 and loss(m.thresholds - d) >= at - 1e-3


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rest = labels.where("pmod(hash(doc_id), 5) = 0")
    out = toxicity(docs, labels.join(rest, "doc_id", "left_anti"))
    got = out.join(rest.where("quality = 1").selectExpr("doc_id", "toxic as label"), "doc_id").toPandas()
    hit, clean = got[got.label == 1].toxic.mean(), got[got.label == 0].toxic.mean()
    assert hit > 0.9 and clean < 0.01, (hit, clean)
    order = got.severity.rank()
    auc = (order[got.label == 1].mean() - (sum(got.label == 1) + 1) / 2) / sum(got.label == 0)
    assert auc > 0.97
    assert out.count() == docs.count()


def test_toxicity_edge_rows(docs_of, spark):
    rows = [(i, "you are a fool indeed" if i % 3 == 0 else "calm plain words here") for i in range(90)] + [(200, None), (201, ""), (202, "fool " * 4000), (None, "fool"), (5, "again"), (5, "again")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), "z") for i in range(90)] + [(7, 1, None, "z"), (None, 1, 1, "z"), (999, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")
    got = [(r.doc_id, r.toxic) for r in toxicity(docs_of(rows), labels).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert all(by[i] == (i % 3 == 0) for i in range(90) if i != 5) and not by[200] and not by[201] and by[202]
    assert not any(r.toxic for r in toxicity(docs_of(rows), labels.where("toxic = 0")).collect())
    assert not any(r.toxic for r in toxicity(docs_of(rows), labels.where("doc_id < 0")).collect())
    assert toxicity(docs_of([]), labels).count() == 0


def test_near_copies_are_fitted_once():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 18, 300)) for _ in range(30)]
    copies = [np.unique(np.concatenate([b[10:], rng.integers(0, 1 << 18, 10)])) for b in base]
    assert len(x.unlike(base)) == 30 and len(x.unlike(base + copies)) <= 32


def test_copies_are_fitted_when_asked(spark, monkeypatch):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fitted = []
    monkeypatch.setattr(x, "fit", lambda rows, grades, n: fitted.append(len(rows)))
    for copies in (False, True):
        x.train(docs, labels, fit_copies=copies)
    assert fitted[0] < fitted[1] == labels.join(docs, "doc_id").select("doc_id").distinct().count()


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    n, m = 20_000, len(q.LABELLERS)
    good = rng.random(n) < 0.8
    acc = np.linspace(0.75, 0.97, m)
    votes = np.where(rng.random((n, m)) < 0.15, q.NONE, np.where(rng.random((n, m)) < acc, good[:, None], ~good[:, None]).astype(int))
    patterns, counts = np.unique((votes * 3 ** np.arange(m)).sum(1), return_counts=True)
    model = fit_labellers(patterns, counts)
    assert abs(model.good - 0.8) < 0.02 and np.abs(model.accuracy() - acc).max() < 0.03
    p = model.posterior((votes * 3 ** np.arange(m)).sum(1))
    assert ((p > 0.5) == good).mean() > 0.98


def test_quality_against_labels(spark):
    """The labels are never trained on; they measure the whole method."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality(docs).join(labels.withColumnRenamed("quality", "label"), "doc_id").toPandas()
    assert got[got.label == 1].kept.mean() > 0.995 and got[got.label == 0].kept.mean() < 0.1


def test_quality_edge_rows(docs_of):
    rnd = random.Random(8)
    words = "the river bends where old trees lean over quiet water and birds call".split()

    def prose():
        return "\n".join(" ".join(rnd.choices(words, k=12)).capitalize() + "." for _ in range(6))

    rows = [(i, prose() if i % 5 else " ".join(w + "%%%" for w in rnd.choices(words, k=60))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "short."), (503, prose() + " tail" * 1), (None, prose()), (3, prose()), (504, (prose() + "\n") * 300)]
    df = docs_of(rows)
    out = quality(df).collect()
    assert len(out) == len(rows) and all(0 <= r.quality <= 1 for r in out)
    kept = {r.doc_id for r in out if r.kept}
    assert {i for i in range(200) if i % 5} <= kept and not {i for i in range(200) if i % 5 == 0} & kept and {503, 504, None} <= kept
    assert keep_good(df).columns == df.columns and keep_good(df).count() == sum(r.kept for r in out)
    assert quality(docs_of([])).count() == 0


@pytest.mark.parametrize("word, want", [("Hello", "Aa"), ("Of%%%", "Aa%"), ("ABC!!", "A!"), ("a1b22", "a0a0"), ("a1" * 40, "a0" * 40), ("", "")])
def test_shapes(word, want):
    assert q.shape(word) == want


def test_long_shapes_tell_words_apart_and_are_not_remembered():
    a, b = "a1" * 30 + "-", "a1" * 30 + "+"
    before = q._short_bucket.cache_info().currsize
    assert q.describe(a)[-1] == zlib.crc32(("a0" * 30 + "-").encode()) % (q.BUCKETS - 1) != q.describe(b)[-1]
    assert q._short_bucket.cache_info().currsize == before


def test_reader_forgets_and_tells_the_same(monkeypatch):
    rnd = random.Random(5)
    words = [f"{rnd.choice(['word', 'Odd%', 'BIG!!', '|', 'x1', '<a>'])}{k}" for k in range(60)] + ["|", "|"]
    texts = [" ".join(rnd.choices(words, k=30)) for _ in range(40)] + [None, "", "|"]
    whole = q.Reader()
    want = [whole.read(t) for t in texts]
    monkeypatch.setattr(q, "REMEMBERED", 25)
    small = q.Reader()
    for t, (s, n, b, v) in zip(texts, want):
        got = small.read(t)
        assert got[0].tolist() == s.tolist() and got[1] == n and dict(zip(got[2], got[3])) == dict(zip(b, v))
    assert len(small.known) < 120


def test_toxicity_against_brute_force(spark, docs_of):
    """Every score again from the fitted weights, word by word."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = x.train(docs, labels)
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys() and len(model.weights) > 5
    for i, text in texts.items():
        counts = {}
        for w in plain_words(text):
            letters = w.decode()
            for b in {zlib.crc32(w) % x.BUCKETS} | {zlib.crc32(b"^" + letters[:n].encode()) % x.BUCKETS for n in (5, 6, 7, 8) if len(letters) > n}:
                counts[b] = counts.get(b, 0) + 1
        margin = sum(model.weights.get(b, 0.0) * (1 + math.log(n)) for b, n in counts.items())
        over = [1 / (1 + math.exp(-(margin - t))) for t in model.thresholds]
        assert abs(got[i].severity - sum(over)) < 1e-6 and abs(got[i].p_toxic - over[0]) < 1e-6
        if abs(over[0] - 0.5) > 1e-9:
            assert got[i].toxic == (over[0] >= 0.5)


def plain_shares(text):
    """The labellers' shares by plain loops."""
    words = (text or "").split()
    n = len(words)
    if n < q.MIN_WORDS:
        return None
    letters = sum(c.isalpha() for w in words for c in w)
    lines = [y.rstrip() for y in text.split("\n") if y.strip()]
    return [
        sum(w != "|" and any(c in "#*$%&|<>" for c in w) for w in words) / n,
        sum(c.isupper() for w in words for c in w if c.isalpha()) / max(letters, 1),
        sum("!!" in w for w in words) / n,
        sum(w == "|" for w in words) / n,
        sum(not c.isalnum() for w in words for c in w) / sum(map(len, words)),
        sum(not q.CLEAN.fullmatch(w) for w in words) / n,
        sum(words[i] == words[i - 1] for i in range(1, n)) / (n - 1),
        sum(words[i] == words[i - 1] == words[i - 2] for i in range(2, n)) / (n - 2),
        sum(words[i] in (words[i - 2], words[i - 3]) for i in range(3, n)) / (n - 3),
        max(words.count(w) for w in set(words)) / n,
        sum(not y.endswith(q.ENDS) for y in lines) / max(len(lines), 1),
        sum(len(w) > 40 for w in words) / n,
    ]


def plain_em(votes, weights, rounds):
    """EM over rows of votes, written out."""
    p = [0.1 if 0 in v else 0.95 for v in votes]
    m = len(votes[0])
    for _ in range(rounds):
        total = [sum(w * (1 - y) for w, y in zip(weights, p)), sum(w * y for w, y in zip(weights, p))]
        share = (total[1] + 1) / (sum(weights) + 2)
        chance = [[[(sum(w * (y if side else 1 - y) for v, w, y in zip(votes, weights, p) if v[j] == k) + 1) / (total[side] + 3) for k in range(3)] for j in range(m)] for side in (0, 1)]
        new = []
        for v in votes:
            logs = [sum(math.log(chance[side][j][v[j]]) for j in range(m)) for side in (0, 1)]
            odds = logs[1] - logs[0] + math.log(share) - math.log(1 - share)
            new.append(1 / (1 + math.exp(-max(-35, min(35, odds)))))
        p = new
    return p


def test_quality_against_brute_force(spark):
    """Votes of all texts, the posterior and every score again by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    patterns = {}
    for text in texts.values():
        s = plain_shares(text)
        v = tuple([2] * 12 if s is None else [1 if a <= g else 0 if a >= b else 2 for a, (_, g, b) in zip(s, q.LABELLERS)])
        patterns[v] = patterns.get(v, 0) + 1
        assert q.pattern(q.Reader().read(text)[0]) == sum(k * 3**j for j, k in enumerate(v))
    votes, weights = list(patterns), list(patterns.values())
    codes = np.array([sum(k * 3**j for j, k in enumerate(v)) for v in votes])
    model = fit_labellers(codes, np.array(weights), rounds=30)
    assert np.abs(model.posterior(codes) - plain_em(votes, weights, 30)).max() < 1e-6
    _, scorer = q.train(q.read_texts(docs))
    got = {r.doc_id: (r.quality, r.kept) for r in quality(docs).collect()}
    for i, text in texts.items():
        words = (text or "").split()
        counts = {}
        for w in words:
            b = zlib.crc32(q.shape(w).encode()) % (q.BUCKETS - 1)
            counts[b] = counts.get(b, 0) + 1
        if echoes := sum(a == b for a, b in zip(words, words[1:])):
            counts[q.BUCKETS - 1] = echoes
        margin = scorer.bias + sum(scorer.weights[b] * n / len(words) for b, n in counts.items())
        want = 1 / (1 + math.exp(-max(-35, min(35, margin))))
        assert abs(got[i][0] - want) < 1e-6 and (got[i][1] == (want >= 0.5) or abs(want - 0.5) < 1e-6)


@pytest.mark.parametrize("repeats", [1, 50])
def test_ids_of_least_hash(spark, repeats):
    """The same ids as by sorting all of them, whatever part of the rows repeats."""
    from pyspark.sql import functions as F

    from cohortloom.llm.quality import least_hashed

    ids = spark.range(3000).select((F.col("id") / repeats).cast("long").alias("id")).unionAll(spark.sql("SELECT CAST(NULL AS LONG) AS id"))
    want = [r.id for r in ids.distinct().orderBy(F.xxhash64("id"), "id").limit(20).collect()]
    assert [r.id for r in least_hashed(ids, 3001, 20).orderBy(F.xxhash64("id"), "id").collect()] == want


def test_many_rows_of_one_id(docs_of, spark):
    """A sampled id that many rows share is gathered once, and the bytes gathered have a bound."""
    rows = [(7, f"copy number {i} of a fool")  for i in range(3000)] + [(i, "you are a fool" if i % 3 == 0 else "calm plain words") for i in range(100, 160)]
    labels = spark.createDataFrame([(7, 1)] + [(i, int(i % 3 == 0)) for i in range(100, 160)], "doc_id long, toxic int")
    some = x.labelled(docs_of(rows), labels, "doc_id", "text", "toxic", 50)
    assert some.count() == 50 and some.select("id").distinct().count() == 50
    out = toxicity(docs_of(rows), labels)
    assert out.count() == len(rows) and out.where("toxic").count() == 3020
    assert x.train(docs_of(rows), labels, max_gathered=0).weights == {}
    _, scorer = q.train(q.read_texts(docs_of(rows)), max_gathered=0)
    assert scorer.bias == 35.0 and quality(docs_of(rows)).count() == len(rows)
