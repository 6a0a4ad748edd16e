import random

import numpy as np
import pytest
import xxhash

from cohortloom.llm.components import components
from cohortloom.llm.decontaminate import align, all_seeds, decontaminate, drop_leaking, passages
from cohortloom.llm import simhash as near
from cohortloom.llm.tokens import plain_words
from cohortloom.llm.simhash import joined, one_per_group, shingle_hashes, simhash, simhash_groups, sketch


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_simhash_against_brute_force(docs_of):
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([1, 2, 3, 5, 400, 900]))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            edited = base[:]
            edited[rnd.randrange(len(base))] = rnd.choice(words)
            texts.append(rnd.choice([" ", "\n", "\t "]).join(edited))
    texts += [None, "", " \n", "UPPER Case Words", "upper case words", "Ü ü x", "ü ü x"] + texts[:3]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts))
    fp = {i: plain_fingerprint(t) for i, t in rows}
    g = Groups()
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                g.join(a, b)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs_of(rows)).collect()}
    assert got == {(i, f"{fp[i]:016x}", g.find(i)) for i in fp}
    assert len({g.find(i) for i in fp}) < len(fp)


def test_simhash_edge_rows(docs_of):
    assert simhash_groups(docs_of([])).count() == 0
    got = sorted((str(r.doc_id), r.component_id) for r in simhash_groups(docs_of([(4, "a b"), (4, "a b"), (None, "a b"), (9, "A  B")])).collect())
    assert got == [("4", 4), ("4", 4), ("9", 4), ("None", 4)]


def test_salted_join(spark):
    """Hot and rare keys, empty sides: the rows of a plain join."""
    from pyspark.sql import functions as F

    from cohortloom.llm.common import salted

    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 1500).cast("string")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = salted(left, right, ["k"], "n", ["id"])
    assert got.columns == ["k", "id", "least"]
    assert sorted(got.collect()) == sorted(left.join(right.drop("n"), ["k"]).collect())
    assert salted(left.limit(0), right.limit(0), ["k"], "n", ["id"]).count() == 0


def test_chains_join(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (50, 60), (60, 50)]
    rnd = random.Random(2)
    rnd.shuffle(path)
    edges = spark.createDataFrame(path, "a long, b long")
    got = {(r.node, r.component) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100), (50, 50), (60, 50)}
    assert components(edges.where("a < 0")).count() == 0


def test_one_per_group(docs_of):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(5000)]

    def text(n):
        return rnd.choices(words, k=n)

    def edited(base, n):
        out = base[:]
        for i in range(n):
            out[(i + 1) * len(base) // (n + 1)] = "changed"
        return out

    a, b, c = text(400), text(400), text(300)
    rows = [(10, a), (3, edited(a, 2)), (11, edited(a, 4)), (20, b), (21, b), (30, c), (31, text(300)), (32, c[:150] + text(150)), (40, edited(b, 30))]
    rows = [(i, " ".join(w)) for i, w in rows] + [(50, None), (51, ""), (60, "two words"), (61, "two words"), (61, "two words"), (None, "no id")]
    df = docs_of(rows)
    out = one_per_group(df)
    assert out.dtypes == df.dtypes
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [3, 20, 30, 31, 32, 40, 50, 60, None]))
    assert one_per_group(docs_of([])).count() == 0


def test_one_per_group_against_brute_force(docs_of):
    """Copies edited around the least similarity: those of a group go, those of 78 % and less stay."""
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(20_000)]
    rows = []
    for _ in range(30):
        base = rnd.choices(words, k=500)
        rows.append(base)
        for n in rnd.sample(range(4, 16), 4):  # each edit takes five of 496 shingles
            out = base[:]
            for i in range(n):
                out[(2 * i + 1) * 250 // n] = f"edit{rnd.random()}"
            rows.append(out)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    g = Groups()
    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                g.join(a, b)
    want = {i for i in sets if g.find(i) == i}
    assert 30 < len(want) < len(rows)
    assert {r.doc_id for r in one_per_group(docs_of(rows)).collect()} == want


def test_rows_that_share_an_id(docs_of):
    """Only copies go: a text on a repeated id is judged by itself."""
    rnd = random.Random(5)
    a, b, c = (" ".join(rnd.choices([f"w{k}" for k in range(3000)], k=120)) for _ in range(3))

    def kept(*rows):
        return sorted((r.doc_id, r[1]) for r in one_per_group(docs_of(list(rows))).collect())

    assert kept((1, a), (1, b), (2, b)) == sorted([(1, a), (1, b)])
    assert kept((1, a), (1, b), (2, c)) == sorted([(1, a), (1, b), (2, c)])
    assert kept((2, a), (2, b), (1, b), (2, a), (3, a + " end")) == sorted([(2, a), (1, b)])
    assert kept((1, a), (1, a), (1, a.upper())) in ([(1, a)], [(1, a.upper())])


def test_unlike_texts_with_equal_fingerprints_stay(docs_of):
    """One run of words repeated often settles the fingerprint, whatever else two texts hold."""
    rows = [(i, "round and about " * 60 + " ".join(f"own{i}x{k}" for k in range(40))) for i in range(6)]
    assert len({plain_fingerprint(t) for _, t in rows}) < 6
    rows.append((9, rows[3][1] + " more"))
    assert {r.doc_id for r in one_per_group(docs_of(rows)).collect()} == set(range(6))


def test_a_chain_of_half_alike_texts_is_linear(spark, docs_of, monkeypatch):
    """Neighbours share half their shingles: they meet in bands here and there, but no text is compared with more than a few."""
    compared = []
    monkeypatch.setattr(near, "_rest", lambda texts, labelled, buckets, similarity, f=near._rest: compared.append(buckets.where("n > 3").count()) or f(texts, labelled, buckets, similarity))
    words = [f"w{k}" for k in range(40_000)]
    rnd = random.Random(3)
    rnd.shuffle(words)
    rows = [(i, " ".join(words[i * 20:i * 20 + 60])) for i in range(1500)]
    assert one_per_group(docs_of(rows)).count() == 1500
    assert compared[0] < 1500


@pytest.mark.parametrize("unit", [near.UNIT, 20_000])
def test_copies_of_an_original_in_the_middle(docs_of, monkeypatch, unit):
    """Each copy is like the original only, whose id lies in the middle; in one task and in many."""
    monkeypatch.setattr(near, "UNIT", unit)
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(20_000)]
    base = rnd.choices(words, k=400)
    rows = []
    for i in range(251):
        out = base[:]
        if i != 125:
            for at in rnd.sample(range(2, 398, 5), 6):
                out[at] = f"edit{rnd.random()}"
        rows.append((i, " ".join(out)))
    sets = [set(shingle_hashes(t, 5).tolist()) for _, t in rows]
    assert all(len(s & sets[125]) >= 0.8 * len(s | sets[125]) for s in sets)
    assert sum(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets) < 20
    rows.append((300, " ".join(rnd.choices(words, k=300))))
    assert {r.doc_id for r in one_per_group(docs_of(rows)).collect()} == {0, 300}


@pytest.mark.parametrize("seed", range(4))
def test_joined_against_all_pairs(seed):
    rnd = np.random.default_rng(seed)
    sets = []
    for _ in range(6):
        base = rnd.choice(100_000, 60, replace=False)
        for _ in range(rnd.integers(1, 12)):
            sets.append(np.unique(np.concatenate([base[rnd.random(60) > 0.09], rnd.integers(0, 100_000, rnd.integers(0, 5))])))
    groups = np.arange(len(sets))
    groups[1] = groups[0]
    g, got = Groups(), Groups()
    g.join(0, 1)
    got.join(0, 1)
    for a in range(len(sets)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                g.join(a, b)
    for a, b in joined(sets, groups, 0.8):
        got.join(a, b)
    assert [got.find(i) for i in range(len(sets))] == [g.find(i) for i in range(len(sets))]


def test_sketch_estimates_overlap():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * 2 * share / (1 + share))
        a, b = x[:2000], np.concatenate([x[:n], x[2000 : 4000 - n]])
        assert abs(np.mean(sketch(a) == sketch(b)) - share) < 0.09
    assert simhash(shingle_hashes(None)) == 0


def plain_align(a, b):
    best = 0
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


@pytest.mark.parametrize("seed", range(8))
def test_alignment_against_plain_table(seed):
    rnd = random.Random(seed)
    a = [rnd.randrange(4) for _ in range(rnd.randint(1, 14))]
    b = [rnd.randrange(4) for _ in range(rnd.randint(1, 20))]
    score, start, end = align(np.array(a), np.array(b))
    assert score == plain_align(a, b)
    if score:
        assert plain_align(a, b[start:end]) == score


def test_decontamination(spark, docs_of):
    rnd = random.Random(6)
    words = [f"term{k}" for k in range(4000)] + ["the", "of", "and"] * 400
    items = [rnd.choices(words, k=n) for n in (30, 45, 20, 60)]
    items.append(["only", "four", "rare", "words"])
    bench = spark.createDataFrame([(100 + i, " ".join(x), "extra") for i, x in enumerate(items)] + [(None, "no id here at all", "e"), (300, None, "e"), (301, "", "e")], "item_id long, text string, doc_id string")

    def around(middle):
        return " ".join(rnd.choices(words, k=80) + middle + rnd.choices(words, k=80))

    edited = items[1][:]
    for i in range(4, 45, 9):
        edited[i] = "edited"
    del edited[20]
    rows = [(0, around(items[0])), (1, around(edited)), (2, around([])), (3, around(items[2]).upper().replace(" ", ", ")), (4, around(items[3][:20])), (5, around(items[4])), (6, around(["only", "four", "rare", "thing"])),
            (7, around(items[0]) + " " + around(items[2])), (8, None), (9, ""), (None, around(items[0]))]
    df = docs_of(rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate(df, bench).collect()}
    assert got == {(0, 100), (1, 101), (3, 102), (5, 104), (7, 100), (7, 102), (None, 100)}
    hit = decontaminate(df, bench).where("doc_id = 0").first()
    assert (hit.score, hit.start, hit.words) == (1.0, 80, 30)
    blocks = {(r.doc_id, r.item_id) for r in decontaminate(df, bench, block_bytes=200).collect()}
    assert blocks == got
    in_blocks = drop_leaking(df, bench, block_bytes=200)
    assert in_blocks.columns == df.columns and {r.doc_id for r in in_blocks.collect()} == {2, 4, 6, 8, 9}
    assert in_blocks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    kept = drop_leaking(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 4, 6, 8, 9}
    assert decontaminate(docs_of([]), bench).count() == 0 and decontaminate(df, bench.where("item_id < 0")).count() == 0


def test_a_leak_in_very_many_documents(spark, docs_of):
    item = [f"q{k}" for k in range(25)]
    rows = [(i, " ".join([f"x{i}{k}" for k in range(30)] + item)) for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate(docs_of(rows), bench).count() == 60
    seeds = all_seeds([(1, [b"a"]), (2, [b"a", b"b", b"a", b"b"])], 3)
    items, begins = seeds.found(seeds.numbered([b"x", b"a", b"b", b"a", b"b"]))
    assert sorted(zip(items.tolist(), begins.tolist())) == [(0, 1), (0, 3), (1, 1), (1, 1)]


def test_edited_copies_of_an_item_that_many_hold(spark, docs_of):
    """Each copy is edited at other places; every trigram of the item is in dozens of documents."""
    item = [f"q{k}" for k in range(14)]
    rows = []
    for i in range(300):
        rnd = random.Random(i)
        copy = item[:]
        for at in rnd.sample(range(14), 3):
            copy[at] = f"edit{i}"
        rows.append((i, " ".join([f"x{i}{k}" for k in range(30)] + copy + [f"y{i}{k}" for k in range(30)])))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    code = {w: k for k, w in enumerate(item)}
    want = {i for i, t in rows if plain_align(list(range(14)), [code.get(w, -1) for w in t.split()]) >= 7}
    assert len(want) == 300
    assert {r.doc_id for r in decontaminate(docs_of(rows), bench).collect()} == want


def test_decontamination_against_all_pairs(spark, sf):
    """All documents against all items by plain alignment, copies edited to 50-90 % planted among them."""
    rnd = random.Random(9)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: plain_words(r.text) for r in bench.collect()}
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for d, i in zip(list(rows)[:160], rnd.choices([i for i, w in items.items() if len(w) >= 8], k=160)):
        copy = [w.decode() for w in items[i]]
        for at in rnd.sample(range(len(copy)), round(len(copy) * rnd.uniform(0.05, 0.25))):
            copy[at] = rnd.choice(["", "edited", copy[at] + " more"])
        rows[d] += "\n" + " ".join(copy) + "\n" + rows[d][:200]
    want = set()
    for d, t in rows.items():
        words = plain_words(t)
        for i, item in items.items():
            code = {w: k for k, w in enumerate(dict.fromkeys(item))}
            if item and align(np.array([code[w] for w in item]), np.array([code.get(w, -1) for w in words], np.int64))[0] >= (len(item) if len(item) < 8 else 0.5 * len(item)):
                want.add((d, i))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate(df, bench).collect()}
    assert len(want) > 120 and got <= want
    recall = len(got & want) / len(want)
    print(f"recall {recall:.3f} of {len(want)}")
    assert recall >= 0.95


def test_very_long_texts(docs_of):
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(50_000)}" for _ in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "short")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs_of(rows)).collect()}
    assert got[1][0] == f"{plain_fingerprint(long):016x}" and got[2][1] == 1 and got[3][1] == 3
    assert {r.doc_id for r in one_per_group(docs_of(rows)).collect()} == {1, 3}


def test_many_items_that_share_a_seed():
    """Thousands of items with one opening: only those of whose words the text holds enough are looked at."""
    import time

    rnd = random.Random(2)
    items = [(f"item{i}", [b"which", b"of", b"the", b"following", *[f"w{rnd.randrange(30_000)}".encode() for _ in range(8)]]) for i in range(16_000)]
    seeds = all_seeds(items, 3)
    text = [f"w{rnd.randrange(30_000)}".encode() for _ in range(300)]
    text[50:54] = [b"which", b"of", b"the", b"following"]
    text[100:112] = items[77][1]
    passages(text, seeds)
    began = time.process_time()
    assert [(i, s) for i, s, _, _ in passages(text, seeds)] == [("item77", 1.0)]
    assert time.process_time() - began < 0.5


def test_ids_of_any_type_and_long_texts(spark, docs_of):
    bench = spark.createDataFrame([("a-1", "one two three four five six seven eight nine"), ("b", "never said")], "item_id string, text string")
    rows = [(1, "filler " * 100_000 + "one two three four five six seven eight nine " + "more " * 100_000), (2, "nothing")]
    out = decontaminate(docs_of(rows), bench)
    assert [(r.doc_id, r.item_id, r.start) for r in out.collect()] == [(1, "a-1", 100_000)]
    assert {r.doc_id for r in drop_leaking(docs_of(rows), bench).collect()} == {2}
