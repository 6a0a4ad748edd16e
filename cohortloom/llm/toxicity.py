"""Toxicity by cumulative-link ordinal regression on hashed words.

P(grade > k) = sigmoid(w.x - t_k): one set of weights for all thresholds
t_0 < t_1 < ... The score of a text is its expected grade.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, pick, remove, stored, within
from .sparse import Rows, fista, sigmoid
from .tokens import plain_words

BUCKETS = 1 << 18
#: Lengths of the beginnings of longer words that are features besides the words.
BEGINNINGS = (5, 6, 7, 8)
#: Labelled documents that the model is fitted on at most, taken in the order of their ids' hashes.
MAX_LABELLED = 10_000
#: Bytes of features that the driver gathers for it at most; documents beyond, in the same order, are left out of the fit.
MAX_GATHERED = 96 << 20
#: Words in fewer of them say nothing.
MIN_DOCS = 5
#: Nor do words in more than this share of them, or than are toxic.
MAX_SHARE = 0.1
L1 = 1.0
RELAXED = 0.02
ROUNDS = 200
#: Standard errors by which a word must stand in toxic rows mostly, and how many such words make a row severe.
TELLING_Z = 3.0
SEVERE_WORDS = 3
REMEMBERED = 500_000


def word_buckets(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings: inflected and compound words share these."""
    out = [zlib.crc32(word) % BUCKETS]
    letters = word.decode()
    for n in BEGINNINGS:
        if len(letters) > n:
            out.append(zlib.crc32(b"^" + letters[:n].encode()) % BUCKETS)
    return out


def features(text: str | None) -> dict[int, int]:
    """Buckets of a text and how often each occurs."""
    out: Counter = Counter()
    for w, n in Counter(plain_words(text)).items():
        for b in set(word_buckets(w)):
            out[b] += n
    return out


def weigh(counts: np.ndarray) -> np.ndarray:
    """A word's second place tells less than its first."""
    return 1 + np.log(counts)


@dataclass
class OrdinalModel:
    """Weights of the buckets that have one, and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def over(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each margin and threshold."""
        return sigmoid(margins[:, None] - self.thresholds[None, :])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, l1: float = L1, rounds: int = ROUNDS) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty on the weights; ``rows`` are buckets and counts.

    The penalty chooses the words; the weights of the chosen are then fitted almost
    without it. The thresholds are t_0 and positive steps (their logarithms are
    fitted). With no rows, or one grade only, no word has weight and the lowest
    grade is certain.
    """
    k = n_grades - 1
    grades = np.asarray(grades, np.int64)
    if not len(grades) or grades.max() == grades.min():
        return OrdinalModel({}, np.full(k, 35.0) + np.arange(k))
    df = np.bincount(np.concatenate([b for b, _ in rows]), minlength=BUCKETS)
    most = max(MAX_SHARE, float((grades > 0).mean())) * len(rows)
    columns = np.nonzero((df >= MIN_DOCS) & (df <= most))[0]
    shares = np.clip([np.mean(grades > j) for j in range(k)], 1e-6, 1 - 1e-6)
    first = -np.log(shares / (1 - shares))
    start = np.concatenate([np.zeros(len(columns)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    x = _solve(rows, df, columns, grades, k, start, l1, rounds)
    chosen = x[: len(columns)] != 0
    x = x[np.concatenate([chosen, np.ones(k, bool)])]
    columns = columns[chosen]
    x = _solve(rows, df, columns, grades, k, x, l1 * RELAXED, rounds)
    weights = x[: len(columns)] / np.sqrt(df[columns])
    return OrdinalModel({int(b): float(v) for b, v in zip(columns, weights) if v}, _thresholds(x[len(columns) :]))


def _thresholds(p: np.ndarray) -> np.ndarray:
    return p[0] + np.concatenate([[0], np.cumsum(np.exp(p[1:]))])


def _solve(rows: list[tuple[np.ndarray, np.ndarray]], df: np.ndarray, columns: np.ndarray, grades: np.ndarray, k: int, start: np.ndarray, l1: float, rounds: int) -> np.ndarray:
    """Weights of ``columns``, each times the root of its size, and the thresholds' parameters.

    Columns are scaled by the root of their size, as is the noise in their
    gradients, so that one penalty suits all.
    """
    place = np.full(BUCKETS, -1, np.int32)
    place[columns] = np.arange(len(columns))
    scale = 1 / np.sqrt(np.maximum(df[columns], 1))
    inner, values = [], []
    for b, counts in rows:
        at = place[b]
        inner.append(at[at >= 0])
        values.append(weigh(counts[at >= 0]) * scale[at[at >= 0]])
    data, d, n = Rows(inner, values), len(columns), len(grades)

    def gradient(x: np.ndarray) -> np.ndarray:
        t, m = _thresholds(x[d:]), data.dot(x[:d])
        upper = np.where(grades < k, sigmoid(t[np.minimum(grades, k - 1)] - m), 1.0)  # P(y <= grade)
        lower = np.where(grades > 0, sigmoid(t[np.maximum(grades - 1, 0)] - m), 0.0)  # P(y < grade)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_t = np.bincount(np.minimum(grades, k - 1), np.where(grades < k, -du, 0), k) + np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, dl, 0), k)
        by_p = np.concatenate([[by_t.sum()], np.cumsum(by_t[::-1])[::-1][1:] * np.exp(x[d + 1 :])])
        return np.concatenate([data.transposed_dot(du - dl, d), by_p * STEEP])

    return fista(gradient, start, 1 / (0.5 * data.norm(d) + n * STEEP), l1, np.arange(d + k) >= d, rounds)


#: Thresholds move by smaller steps than weights, for the same step size.
STEEP = 0.05


def unlike(rows: list[np.ndarray]) -> list[int]:
    """Places of rows that are no near copy of one before: copies share the noise of one label.

    Two rows are taken for copies if the two least of their rarer buckets agree under any of three orders.
    """
    df = np.bincount(np.concatenate(rows), minlength=BUCKETS) if rows else np.zeros(BUCKETS)
    rare = df <= max(MIN_DOCS, 0.02 * len(rows))
    seen: set[tuple] = set()
    kept = []
    for i, whole in enumerate(rows):
        r = whole[rare[whole]]
        marks = [(k, *np.partition(r.astype(np.int64) * m % (1 << 31), 1)[:2].tolist()) for k, m in enumerate((1103515245, 69069, 1664525))] if len(r) > 1 else []
        if seen.isdisjoint(marks):
            kept.append(i)
        seen.update(marks)
    return kept


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for harmless rows, 1 for toxic ones, 2 for those with several of the words that tell toxic rows apart.

    Such words stand in toxic rows in the most part, by the lower bound of that share's interval.
    """
    all_n = np.bincount(np.concatenate(rows), minlength=BUCKETS) if rows else np.zeros(BUCKETS)
    n = np.maximum(all_n, 1)
    p = (np.bincount(np.concatenate([r for r, t in zip(rows, toxic) if t]), minlength=BUCKETS) if any(toxic) else np.zeros(BUCKETS)) / n
    z = TELLING_Z
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    telling = (low > 0.5) & (all_n >= MIN_DOCS)
    return np.array([int(t) * (1 + int(telling[r].sum() >= SEVERE_WORDS)) for r, t in zip(rows, toxic)], np.int64)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """``id``, ``text`` and ``label`` of at most ``most`` labelled documents, one row an id: of texts that share it, the first in order."""
    some = pick(labels, key=id_col, label=label_col).where(F.col("key").isNotNull() & F.col("label").isNotNull())
    some = some.groupBy("key").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(most)
    found = pick(docs, id=id_col, text=text_col).join(F.broadcast(some), F.col("id") == F.col("key"))
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          n_grades: int | None = None, max_labelled: int = MAX_LABELLED, max_gathered: int = MAX_GATHERED, fit_copies: bool = False) -> OrdinalModel:
    """Fit on the driver: the features of at most ``max_labelled`` documents, and ``max_gathered`` bytes of them, are gathered there.

    Of these rows near copies of one before (``unlike``) are left out of the fit, unless ``fit_copies``.

    ``label_col`` holds grades 0 to ``n_grades`` - 1; without that number it holds 0 or
    1, and ``severity_grades`` makes three grades of it.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("buckets binary, counts binary")
    def read(texts: pd.Series) -> pd.DataFrame:
        got = [sorted(features(t).items()) for t in texts]
        return pd.DataFrame({name: [np.array([pair[k] for pair in x], "<i4").tobytes() for x in got] for k, name in enumerate(("buckets", "counts"))})

    sample, path = stored(labelled(docs, labels, id_col, text_col, label_col, max_labelled).select("id", read("text").alias("x"), "label").select("id", "x.*", "label"))
    # as bytes, which take a tenth of the driver's memory that lists of numbers would
    got = within(sample.withColumn("size", 2 * F.octet_length("buckets")), "size", max_gathered).select("buckets", "counts", "label").collect()
    remove(sample.sparkSession, path)
    # a fixed order, for the same sums in every run
    got.sort(key=lambda r: (r["label"], len(r["buckets"]), r["buckets"], r["counts"]))
    rows = [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in got]
    kept = range(len(rows)) if fit_copies else unlike([b for b, _ in rows])
    x, grades = [rows[i] for i in kept], np.array([got[i]["label"] for i in kept], np.int64)
    if n_grades is None:
        return fit(x, severity_grades([b for b, _ in x], grades > 0), 3)
    return fit(x, np.clip(grades, 0, n_grades - 1), n_grades)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``severity`` (expected grade), ``p_toxic`` (grade over 0), ``grade`` and ``toxic`` (p_toxic >= 0.5).

    ``grade`` counts the thresholds that are passed with a probability of a half.
    Null and empty texts have no words, and so the score of none. Each row is scored
    by itself and in place; repeated rows and null ids need no care.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[int, ...]] = {}
        weights = model.weights
        for texts in batches:
            margins = np.zeros(len(texts))
            for i, t in enumerate(texts):
                found: Counter = Counter()
                for w, n in Counter(plain_words(t)).items():
                    told = known.get(w)
                    if told is None:
                        told = tuple({b for b in word_buckets(w) if b in weights})
                        if len(known) < REMEMBERED:
                            known[w] = told
                    for b in told:
                        found[b] += n
                margins[i] = sum(weights[b] * float(weigh(n)) for b, n in sorted(found.items()))
            p = model.over(margins)
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0], "grade": (p >= 0.5).sum(1).astype(np.int32)})

    out = pick(docs, id=id_col, text=text_col).select("id", apply("text").alias("s"))
    return out.select(F.col("id").alias(id_col), F.round("s.severity", 9).alias("severity"), F.round("s.p_toxic", 9).alias("p_toxic"), "s.grade", (F.col("s.p_toxic") >= 0.5).alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, fit_copies: bool = False) -> DataFrame:
    """Train on ``labels`` (id, ``toxic`` 0 or 1; rows without a label are left out) and score all of ``docs``.

    Without labels of both kinds nothing is toxic. See ``train`` and ``score``.
    """
    return score(docs, train(docs, labels, id_col, text_col, "toxic", None, max_labelled, fit_copies=fit_copies), id_col, text_col)
