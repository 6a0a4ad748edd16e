import hashlib
import random
from collections import Counter, defaultdict

from cohortloom.llm.line_dedup import dedup_lines, line_dedup
from cohortloom.llm.quality_rules import quality_rules

WHITE = " \t\n\x0b\x0c\r"
LONG = "a line that many documents share"


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def plain_line_dedup(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[lower(line.strip(WHITE))].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            k = lower(line.strip(WHITE))
            gone = i is not None and len(k) >= min_chars and len(holders[k]) >= min_docs and max(holders[k]) != i
            if not gone:
                keep.append(line)
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def got(df):
    return sorted(((r.doc_id, r["text"], r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_lines_against_plain_loop(docs_of):
    rnd = random.Random(5)
    pool = [LONG, LONG.upper(), f"  {LONG}\t", "Ünï" + LONG, "ÜNÏ" + LONG, "short", "", *[f"line number {k} of the whole pool" for k in range(12)], "x" * 19, "x" * 20, LONG + "\r"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(1, 9)))) for i in range(60)]
    rows += [(None, LONG), (7, LONG + "\nanother version of document seven"), (7, LONG + "\nanother version of document seven"), (100, None), (101, ""), (102, "\n\n")]
    assert got(line_dedup(docs_of(rows))) == sorted(plain_line_dedup(rows), key=str)


def test_stage_keeps_columns(docs_of):
    rows = [(1, LONG + "\nfirst"), (2, LONG + "\nsecond"), (3, LONG + "\nthird"), (4, None), (5, "own")]
    df = docs_of(rows)
    out = dedup_lines(df)
    assert out.dtypes == df.dtypes
    assert {(r[0], r[1], r[4]) for r in out.collect()} == {(1, "first", 5), (2, "second", 6), (3, LONG + "\nthird", len(LONG) + 6), (4, None, -1), (5, "own", 3)}


def test_no_rows(docs_of):
    assert line_dedup(docs_of([])).count() == 0 and quality_rules(docs_of([])).count() == 0


def plain_counts(t):
    t = t or ""
    words = [w for w in "".join(c if c not in WHITE else " " for c in t).split(" ") if w]
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_against_plain_loop(docs_of):
    rnd = random.Random(9)
    vocabulary = ["the", "of", "ünd", "a#b", "<tag>", "|", "word", "über all"]
    texts = [" ".join(rnd.choices(vocabulary[: rnd.randint(1, 8)], k=rnd.randint(0, 70))) for _ in range(40)]
    texts += [None, "", " \n\t", "one two three four five six seven eight " * 2, "same\nsame\n same\n\n\n", "w " * 3000]
    rows = list(enumerate(texts)) + [(3, "twice")] * 2 + [(None, "no id")]
    by_id = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs_of(rows)).collect())
    want = []
    for i, t in rows:
        c = plain_counts(t)
        want.append((str(i), *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert by_id == sorted(want)


def test_bad_host_goes_and_good_host_stays(spark):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(i, "too short" if i % 2 and i % 50 != 1 else f"{good} {i}", f"host{i % 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = quality_rules(df).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {i for i in range(400) if i % 2 == 0}
    fine = [r for r in out if not r.base_failed and not r.kept]
    assert fine and all(r.doc_id % 2 for r in fine)
    lonely = quality_rules(df.where("doc_id = 0").drop("source").selectExpr("*", "cast(null as string) source")).collect()
    assert [r.kept for r in lonely] == [True]


def test_hash_of_kept_text(docs_of):
    from pyspark.sql import functions as F

    out = line_dedup(docs_of(["é\nx"])).select(F.sha2("text", 256).alias("h")).first()
    assert out.h == hashlib.sha256("é\nx".encode()).hexdigest()


def test_hot_and_very_long_texts(docs_of):
    """A line that fills most of the table, and a text of very many lines."""
    rows = [(i, "\n".join([LONG] * 40 + [f"a line of its own, number {i}"])) for i in range(120)]
    rows += [(500, "\n".join(f"line {k} of a very long text" for k in range(20_000))), (501, "\n".join([LONG] * 20_000)), (502, "x" * 3_000_000)]
    assert got(line_dedup(docs_of(rows))) == sorted(plain_line_dedup(rows), key=str)
