"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word is cut into two even segments. One edit leaves one of them whole: at its
place, or shifted by the letter that the other word has more. Words are indexed
by both segments and probed by the matching substrings of words of equal length and
of one letter more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, pick, remove, stored

MIN_LETTERS = 5
MIN_COUNT = 3
#: A form must be so many times as frequent as its variant.
RATIO = 2
#: Words lose a letter where this divides the checksum of ``<id>:<word>``; 0 for never.
TYPO = 97
#: Distinct words that a task counts before it hands them on, and their letters.
HELD_WORDS, HELD_LETTERS = 200_000, 8 << 20
RUN = re.compile("[a-zÀ-ÿ]+")
#: Each form at least doubles the count, so no chain is longer than a count has bits; pointers jump twice as far each round.
MAX_ROUNDS = 8


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, typo: int = TYPO) -> DataFrame:
    """``word`` and ``n``, how often it comes in ``docs`` (``id`` as text, ``text`` as binary): runs of Latin letters, A-Z lower-cased, after the letters that ``typo`` takes are gone."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: Counter) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for i in range(0, len(words), 10_000):
            part = words[i:i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], schema=schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = Counter(), 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not (t := t.as_py()):
                    continue
                start = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(RUN.findall(t.lower().decode("utf-8", "replace"))).items():
                    if len(w) < min_letters:
                        continue
                    if typo and (h := zlib.crc32(w.encode(), start)) % typo == 0:
                        gone = h % len(w)
                        w = w[:gone] + w[gone + 1:]
                        if len(w) < min_letters:
                            continue
                    if w not in held:
                        letters += len(w)
                    held[w] += n
                if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                    yield from rows(held)
                    held, letters = Counter(), 0
        yield from rows(held)

    return docs.select("id", "text").mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys(word: Column, more: int) -> Column:
    """What a word offers to words of ``more`` letters less (0 or 1): both segments, each with both halves of the rest.

    A segment alone would put all words with one beginning into a bucket. One edit in the rest
    spares half of that, by the same argument, so the bucket is cut by it and no pair is lost.
    """
    of = F.length(word) - more
    left = F.floor(of / 2).cast("int")
    right = of - left
    keys = []
    for side, segment, rest, size in (
        ("l", F.left(word, left), F.right(word, right + more), right),
        ("r", F.right(word, right), F.left(word, left + more), left),
    ):
        half = F.floor(size / 2).cast("int")
        keys += [F.concat_ws(":", of, F.lit(f"{side}l"), segment, F.left(rest, half)), F.concat_ws(":", of, F.lit(f"{side}r"), segment, F.right(rest, size - half))]
    return F.array(*keys)


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of words (distinct, column ``word``, with ``n``) that one inserted, deleted or replaced letter tells apart, once each, with ``n_a`` and ``n_b``.

    A pair that shares several keys is a candidate at the first of them only; each
    candidate is verified. Words of one letter have the empty word as a neighbour, if it is there.
    """
    index = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.posexplode(_keys(F.col("word"), 0)).alias("place", "key"))
    probe = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(_keys(F.col("word"), 0)).alias("key")).unionAll(
        words.where(F.length("word") > 0).select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(_keys(F.col("word"), 1)).alias("key"))
    )
    candidates = index.join(probe, "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    ours = _keys(F.col("a"), 0)
    theirs = F.when(F.length("a") < F.length("b"), _keys(F.col("b"), 1)).otherwise(_keys(F.col("b"), 0))
    first = F.array_position(F.zip_with(ours, theirs, lambda x, y: x == y), F.lit(True)) == F.col("place") + 1
    return candidates.where((F.levenshtein("a", "b", 1) == 1) & first).select("a", "n_a", "b", "n_b")


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of its forms, from ``word`` and ``form``: pointers jump to where their target points, until none moves."""
    now, path = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_ROUNDS):
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then, new = stored(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        remove(now.sparkSession, path)
        now, path = then.drop("moved"), new
        if then.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, typo: int = TYPO) -> DataFrame:
    """Per word: ``word``, its ``form`` (null if none), ``root``, its count ``n``, the number of near words ``n_near`` and the form's count ``form_n``.

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, with at least ``min_letters`` letters and ``min_count``
    occurrences. A word's form is its near word (one edit) of the largest count, ties to the smallest in code-point order,
    if that count is at least ``ratio`` times its own; its root is the last form on the way.

    * null and empty texts have no words; a null id counts as an empty string in the checksum;
    * rows that repeat count each; an empty table gives an empty result; other columns are not read;
    * very long texts and words are counted whole.

    Words are counted in the tasks before they are shuffled, so a frequent word moves one row a task. What
    is joined are distinct words: eight to twelve short keys each, which fix three quarters of the word's letters.
    """
    arrow_batches(docs.sparkSession)
    src = pick(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    words = cut(word_counts(src, min_letters, typo).where(F.col("n") >= min_count))
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("other")).alias("near")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("other")).alias("near")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = cut(best.select("word", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = _roots(found.where(F.col("form").isNotNull()))
    out = words.join(found, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
