"""Quality by weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Each labeller votes bad, good or nothing on a text. Expectation-maximisation over
the counts of vote patterns, of all documents, estimates how often each labeller
votes what on good and on bad texts. The posterior labels train the scorer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, at, cut, flat, pick, remove, stored, within
from .sparse import Rows, fista, sigmoid

BAD, GOOD, NONE = 0, 1, 2
BUCKETS = 1 << 14
#: Documents that the scorer is fitted on at most, taken in the order of their ids' hashes.
MAX_FITTED = 10_000
#: Bytes of features that the driver gathers for it at most; documents beyond, in the same order, are left out of the fit.
MAX_GATHERED = 96 << 20
EM_ROUNDS = 200
L1 = 0.02
ROUNDS = 400
#: Words that a Python worker remembers, besides as many that it met before.
REMEMBERED = 40_000
SYMBOLS = frozenset("#*$%&|<>")
#: Letters, hyphens and apostrophes within, with one mark behind at most.
CLEAN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*[.,;:!?]?")
ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "”", "…")
#: (name, votes good up to, votes bad from) for shares between 0 and 1; between the two it doesn't vote.
LABELLERS = (
    ("symbols", 0.03, 0.2),  # words with a symbol in them
    ("capitals", 0.2, 0.5),  # letters
    ("shouts", 0.03, 0.2),  # words with !!
    ("bars", 0.01, 0.15),  # words that are a bar
    ("marks", 0.08, 0.11),  # characters that are neither letters nor digits
    ("unclean", 0.05, 0.25),  # words that aren't letters with one mark behind at most
    ("echoes", 0.05, 0.25),  # words equal to the one before
    ("runs", 0.01, 0.1),  # words equal to both the two before
    ("stuck", 0.1, 0.3),  # words equal to the second or third before
    ("top_word", 0.2, 0.35),  # the commonest word's places
    ("open_lines", 0.3, 0.95),  # lines without an end mark
    ("odd_lengths", 0.02, 0.2),  # words of over 40 characters
)
#: Texts with fewer words give no shares to go by.
MIN_WORDS = 12


def shape(word: str) -> str:
    """Letters to a or A, digits to 0, others as they are; runs become one."""
    out: list[str] = []
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def bucket(shape_of: str) -> int:
    """The bucket of a whole shape; short ones are remembered, long ones would fill the memory."""
    return _short_bucket(shape_of) if len(shape_of) <= 32 else _short_bucket.__wrapped__(shape_of)


@lru_cache(1 << 14)
def _short_bucket(shape_of: str) -> int:
    return zlib.crc32(shape_of.encode()) % (BUCKETS - 1)


def describe(word: str) -> tuple[int, ...]:
    """What the labellers and the scorer need to know of a word: whether it has a symbol or a shout, is a bar,
    unclean or odd, its characters, marks, letters and capitals, and the bucket of its shape."""
    core = word[:-1] if word[-1] in ".,;:?!" else word
    tail = word[len(core) :]
    if core.isalpha():  # most words, and told quickly
        n, rest = len(core), core[1:]
        if core.islower():
            return 0, 0, 0, 0, len(word) > 40, len(word), len(tail), n, 0, bucket("a" + tail)
        if rest.islower() and core[0].isupper():
            return 0, 0, 0, 0, len(word) > 40, len(word), len(tail), n, 1, bucket("Aa" + tail)
    return (
        not SYMBOLS.isdisjoint(word) and word != "|", "!!" in word, word == "|", not CLEAN.fullmatch(word), len(word) > 40, len(word),
        sum(not c.isalnum() for c in word), sum(c.isalpha() for c in word), sum(c.isupper() for c in word), bucket(shape(word)),
    )


class Reader:
    """Shares and hashed features of texts; what it knows of words it keeps, in two generations of about ``REMEMBERED``."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 10), np.int32)
        self.before: dict[str, int] = {}
        self.table_before = self.table

    def _rows(self, words: list[str]) -> np.ndarray:
        """The place in ``table`` of each word of one text."""
        if len(self.known) >= REMEMBERED:
            self.before, self.table_before = self.known, self.table
            self.known, self.table = {}, np.zeros_like(self.table)
        places = list(map(self.known.get, words))
        if None in places:
            fresh = sorted({w for w in words if w not in self.known})
            n = len(self.known)
            while n + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            old = list(map(self.before.get, fresh))
            self.table[n : n + len(fresh)] = [describe(w) if i is None else self.table_before[i] for w, i in zip(fresh, old)]
            self.known.update((w, n + i) for i, w in enumerate(fresh))
            places = list(map(self.known.__getitem__, words))
        return np.array(places, np.int64)

    def read(self, text: str | None) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """Shares by labeller (empty if there is too little text), words, and the features' buckets and counts."""
        words = text.split() if text else []
        n = len(words)
        if not n:
            return np.empty(0), 0, np.empty(0, np.int64), np.empty(0, np.int64)
        seen = self._rows(words)
        echoes = seen[1:] == seen[:-1]
        distinct, times = np.unique(seen, return_counts=True)
        t = self.table[distinct]
        found, which = np.unique(t[:, -1], return_inverse=True)
        buckets = np.append(found, BUCKETS - 1)
        counts = np.append(np.bincount(which, times), echoes.sum())
        if not counts[-1]:
            buckets, counts = buckets[:-1], counts[:-1]
        if n < MIN_WORDS:
            return np.empty(0), n, buckets, counts
        symbol, shout, bar, unclean, odd, chars, marks, letters, capitals = times @ t[:, :-1].astype(np.int64)
        top = times.max()
        lines = [x for line in text.split("\n") if (x := line.rstrip())]
        open_lines = sum(not x.endswith(ENDS) for x in lines) / max(len(lines), 1)
        shares = [symbol / n, capitals / max(letters, 1), shout / n, bar / n, marks / chars, unclean / n, echoes.mean(), (echoes[1:] & echoes[:-1]).mean(), ((seen[3:] == seen[1:-2]) | (seen[3:] == seen[:-3])).mean(), top / n, open_lines, odd / n]
        return np.array(shares, float), n, buckets, counts


def pattern(shares: np.ndarray) -> int:
    votes = [NONE] * len(LABELLERS) if not len(shares) else [GOOD if s <= g else BAD if s >= b else NONE for s, (_, g, b) in zip(shares, LABELLERS)]
    return sum(v * 3**j for j, v in enumerate(votes))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS))[None, :] % 3


@dataclass
class LabelModel:
    """``chance[y, j, v]``: how likely labeller j votes v on a text of class y (0 bad, 1 good); ``good``: share of good texts."""

    chance: np.ndarray
    good: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) given the votes."""
        v = votes_of(np.asarray(patterns, np.int64))
        j = np.arange(v.shape[1])[None, :]
        logs = np.log(self.chance)[:, j, v].sum(2)
        return sigmoid(np.log(self.good) + logs[1] - np.log1p(-self.good) - logs[0])

    def accuracy(self) -> np.ndarray:
        """Per labeller: how often it is right when it votes."""
        y = np.array([1 - self.good, self.good])
        right = sum(y[c] * self.chance[c, :, c] for c in (0, 1))
        return right / sum(y[c] * (self.chance[c, :, 0] + self.chance[c, :, 1]) for c in (0, 1))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """EM from the guess that a text with a bad vote is bad; one vote is added to every count."""
    v, n = votes_of(np.asarray(patterns, np.int64)), np.asarray(counts, float)
    q = np.where((v == BAD).any(1), 0.1, 0.95) if len(n) else np.empty(0)
    model = None
    for _ in range(rounds):
        good, bad = n * q, n * (1 - q)
        chance = np.array([[[(side * (v[:, j] == c)).sum() + 1 for c in (0, 1, 2)] for j in range(len(LABELLERS))] for side in (bad, good)])
        chance /= chance.sum(2, keepdims=True)
        model = LabelModel(chance, float((good.sum() + 1) / (n.sum() + 2)))
        last, q = q, model.posterior(patterns) if len(n) else q
        if np.abs(q - last).max(initial=0) < 1e-9:
            break
    return model


@dataclass
class Scorer:
    """P(good) = sigmoid(bias + weights . features), the features being shares of hashed word shapes."""

    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        return float(sigmoid(np.array([self.bias + (self.weights[buckets] * values).sum()]))[0])


def fit_scorer(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray) -> Scorer:
    """Logistic regression on soft labels. No rows: everything is good."""
    if not rows:
        return Scorer(np.zeros(BUCKETS), 35.0)
    data, n = Rows(rows, values), len(rows)

    def gradient(x: np.ndarray) -> np.ndarray:
        g = sigmoid(data.dot(x[:BUCKETS]) + x[BUCKETS]) - target
        return np.append(data.transposed_dot(g, BUCKETS), g.sum())

    free = np.arange(BUCKETS + 1) == BUCKETS
    share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
    start = np.append(np.zeros(BUCKETS), np.log(share / (1 - share)))
    x = fista(gradient, start, 1 / (0.25 * (data.norm(BUCKETS) + n)), L1, free, ROUNDS)
    return Scorer(x[:BUCKETS], float(x[BUCKETS]))


_readers: list[Reader] = []


def reader() -> Reader:
    """One reader a Python worker."""
    if not _readers:
        _readers.append(Reader())
    return _readers[0]


SEEN = "votes int, words int, buckets binary, counts binary"


def _seen():
    """A UDF of texts: their votes, and their features in some hundred bytes."""

    @F.pandas_udf(SEEN)
    def seen(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = reader()
        for texts in batches:
            got = [r.read(t) for t in texts]
            yield pd.DataFrame({
                "votes": np.array([pattern(s) for s, _, _, _ in got], np.int32), "words": np.array([n for _, n, _, _ in got], np.int32),
                "buckets": [b.astype("<u2").tobytes() for _, _, b, _ in got], "counts": [c.astype("<u4").tobytes() for _, _, _, c in got],
            })

    return seen


def _features(words: int, buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(buckets, "<u2").astype(np.int64), np.frombuffer(counts, "<u4") / max(words, 1)


def least_hashed(ids: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` distinct ids of least hash among ``n`` rows of ``id``; only ids below a bound on the hash are shuffled, which rises where rows repeat too often."""
    share = 4 * most / max(n, 1)
    while True:
        below = ids if share >= 1 else ids.where(F.xxhash64("id") <= int(share * 2**64) - 2**63)
        found = below.distinct().orderBy(F.xxhash64("id"), "id").limit(most)
        if share >= 1 or found.count() >= most:
            return found
        share *= 8


def train(seen: DataFrame, max_fitted: int = MAX_FITTED, max_gathered: int = MAX_GATHERED) -> tuple[LabelModel, Scorer]:
    """EM on the vote patterns of all documents (3^12 at most), then the scorer on a bounded sample of them, one row an id.

    ``seen`` has ``id`` and ``seen``, as ``_seen`` makes it, and is read several times.
    """
    votes = seen.groupBy(F.col("seen.votes").alias("v")).agg(F.count("*").alias("n")).orderBy("v").toPandas()
    model = fit_labellers(votes["v"].to_numpy(), votes["n"].to_numpy())
    chosen = least_hashed(seen.select("id"), int(votes["n"].sum()), max_fitted).withColumnRenamed("id", "key")
    drawn, path = stored(seen.join(F.broadcast(chosen), F.col("id") == F.col("key")).groupBy("id").agg(F.min("seen").alias("seen")).select("id", "seen.*"))
    # buckets and counts are gathered as bytes, and unpacked to sixteen of them each
    sample = within(drawn.withColumn("size", 8 * F.octet_length("buckets")), "size", max_gathered).select("votes", "words", "buckets", "counts").toPandas()
    remove(drawn.sparkSession, path)
    arrays = [(v, *_features(n, b, c)) for v, n, b, c in zip(sample["votes"], sample["words"], sample["buckets"], sample["counts"])]
    rows = sorted(arrays, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    target = model.posterior(np.array([r[0] for r in rows], np.int64)) if rows else np.empty(0)
    return model, fit_scorer([r[1] for r in rows], [r[2] for r in rows], target)


def read_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``seen``, written to the shared folder: texts are read once, by the labellers and for the scorer."""
    arrow_batches(docs.sparkSession)
    return cut(pick(docs, id=id_col, text=text_col).select("id", _seen()("text").alias("seen")))


def quality_score(scorer: Scorer, seen: Column) -> Column:
    """P(good) of what ``_seen`` has told of a text; a text without words has the bias alone."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([round(scorer.score(*_features(*x)), 9) for x in zip(b["words"], b["buckets"], b["counts"])], dtype="float64")

    return apply(seen)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fitted: int = MAX_FITTED) -> DataFrame:
    """Per row: id, ``quality`` (the scorer's P(good)) and ``kept`` (a half or more).

    * null, empty and very short texts get no votes; the scorer judges them by what words they have;
    * rows that share an id are scored each; null ids are scored, and are not in the fitted sample;
    * an empty table gives an empty result; extra columns are not read.

    One pass over the texts, whose features are written to the shared folder in some
    hundred bytes each; no shuffle but of pattern counts and the sample. The model that
    goes to the tasks has 2^14 weights, whatever the input.
    """
    seen = read_texts(docs, id_col, text_col)
    _, scorer = train(seen, max_fitted)
    out = seen.select("id", quality_score(scorer, F.col("seen")).alias("quality"))
    return out.select(F.col("id").alias(id_col), "quality", (F.col("quality") >= 0.5).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fitted: int = MAX_FITTED) -> DataFrame:
    """``docs`` without the rows that the scorer rejects; all columns stay.

    Null, empty and very short texts are judged by what words they have, as in ``quality``; rows that repeat, or share an id, are judged each;
    null ids are judged and not fitted; an empty table gives an empty result.
    Whole rows are written to the shared folder with their features, as ids need not tell them apart.
    """
    arrow_batches(docs.sparkSession)
    rows, names = flat(docs)
    rows = cut(rows.withColumn("seen", _seen()(at(docs, text_col))))
    _, scorer = train(rows.select(F.col(at(docs, id_col)).alias("id"), "seen"), max_fitted)
    return rows.where(quality_score(scorer, F.col("seen")) >= 0.5).drop("seen").toDF(*names)
