"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Documents meet test items at any word n-gram of the items; around each meeting
that holds enough of the item's words, a local alignment scores how much of the
item the passage holds, edited or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, at, cut, flat, pick, remove, stored
from .tokens import plain_words

SEED_WORDS = 3
MIN_SCORE = 0.5
#: Items of fewer words count only when they stand in the text whole.
SHORT = 8
#: Bytes of benchmark text in one block; each block is one pass with its own broadcast, which takes some hundred MB at most in a worker.
BLOCK_BYTES = 8 << 20
HIT = "array<struct<item_id:{},score:double,start:long,words:long>>"


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of ``n`` word numbers; what two runs share by chance, the alignment tells apart."""
    count = len(ids) - n + 1
    key = np.full(count, n, np.uint64)
    for k in range(n):
        key = (key ^ ids[k : k + count].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Seeds:
    """Items as numbers of their words, and all their word n-grams (whole items, if shorter) as sorted keys with item and place.

    Some 30 bytes a word of the benchmark, and its distinct words.
    """

    numbers: dict[bytes, int]
    item_ids: list
    items: list[np.ndarray]
    words: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    lengths: tuple[int, ...]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """Word numbers of a text; -1 for words of no item."""
        get = self.numbers.get
        return np.array([get(w, -1) for w in words], np.int32)

    def found(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items, and where in the text each would begin if it were whole, one for every seed that stands there."""
        items, begins = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        known = text >= 0
        for n in self.lengths:
            if len(text) < n:
                continue
            at = known[: len(text) - n + 1].copy()
            for k in range(1, n):
                at &= known[k : k + len(at)]
            places = np.nonzero(at)[0]
            if not len(places):
                continue
            keys = _keys(text, n)[places]
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            times = hi - lo
            which = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            items.append(self.item[which])
            begins.append(np.repeat(places, times) - self.place[which])
        return np.concatenate(items), np.concatenate(begins)

    def met(self, text: np.ndarray, min_score: float) -> Iterator[tuple[int, np.ndarray]]:
        """Items that the text has seeds of, and where they would begin; only such of whose words the text holds enough, wherever they stand."""
        items, begins = self.found(text)
        if not len(items):
            return
        order = np.lexsort((begins, items))
        items, begins = items[order], begins[order]
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        asked = items[first]
        here = np.zeros(len(self.numbers) + 1, bool)
        here[text] = True
        here[-1] = False  # words of no item are -1
        sizes = self.sizes[asked]
        ends = np.cumsum(sizes)
        places = np.repeat((np.cumsum(self.sizes) - self.sizes)[asked] - ends + sizes, sizes) + np.arange(ends[-1])
        held = np.add.reduceat(here[self.words[places]].astype(np.int64), ends - sizes)
        enough = held >= np.where(sizes < SHORT, sizes, min_score * sizes)
        last = np.append(first[1:], len(items))
        for k, a, z in zip(asked[enough].tolist(), first[enough].tolist(), last[enough].tolist()):
            yield k, np.unique(begins[a:z])


def all_seeds(items: list[tuple[object, list[bytes]]], n: int) -> Seeds:
    """``items`` are ids and words, each of one word or more."""
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32) for _, words in items]
    lengths = [min(n, len(x)) for x in coded]
    keys = [_keys(x, m) for x, m in zip(coded, lengths)]
    key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    sizes = [len(k) for k in keys]
    order = np.argsort(key, kind="stable")
    item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]) if sizes else item
    words = np.concatenate(coded) if coded else np.empty(0, np.int32)
    return Seeds(numbers, [i for i, _ in items], coded, words, np.array([len(x) for x in coded], np.int64), key[order], item[order], place[order], tuple(sorted(set(lengths))))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: match 1, mismatch and gap -1. (score, first and last place in ``text`` + 1)."""
    n = len(text)
    steps = np.arange(n + 1)
    row, came = np.zeros(n + 1, np.int64), steps.copy()
    best, span = 0, (0, 0)
    for w in item:
        diagonal = row[:-1] + np.where(text == w, 1, -1)
        up = row[1:] - 1
        new = np.zeros(n + 1, np.int64)
        start = steps.copy()
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start[1:] = np.where(new[1:] == 0, steps[1:], np.where(diagonal >= up, came[:-1], came[1:]))
        # gaps in the item: the running maximum of score + place, less the place
        run = np.maximum.accumulate(new + steps)
        source = np.maximum.accumulate(np.where(new + steps == run, steps, 0))
        better = run - steps > new
        start = np.where(better, start[source], start)
        row, came = np.where(better, run - steps, new), start
        if (top := int(row.max())) > best:
            end = int(row.argmax())
            best, span = top, (int(came[end]), end)
    return best, *span


def most_matches(item: np.ndarray, text: np.ndarray) -> int:
    """No alignment matches more words, or scores more: words that both hold, each as often as in the one with fewer."""
    n = int(item.max()) + 1
    return int(np.minimum(np.bincount(item, minlength=n), np.bincount(text[text >= 0], minlength=n)).sum())


def passages(words: list[bytes], seeds: Seeds, min_score: float = MIN_SCORE) -> list[tuple[object, float, int, int]]:
    """(item_id, score, first word, words) of the best passage for every item that the text holds enough of."""
    numbered = seeds.numbered(words)
    out = []
    for k, begins in seeds.met(numbered, min_score):
        numbers, item = np.unique(seeds.items[k], return_inverse=True)
        m = len(item)
        pad = m // 2 + 4
        need = m if m < SHORT else min_score * m
        best = (0, 0, 0)
        windows: list[list[int]] = []
        for b in begins.tolist():
            lo, hi = max(0, b - pad), min(len(words), b + m + pad)
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = max(hi, windows[-1][1])
            else:
                windows.append([lo, hi])
        for lo, hi in windows:
            part = numbered[lo:hi]
            place = np.minimum(np.searchsorted(numbers, part), len(numbers) - 1)
            text = np.where(numbers[place] == part, place, -1)
            if most_matches(item, text) < need:
                continue
            score, a, z = align(item, text)
            if score > best[0]:
                best = (score, lo + a, z - a)
        if best[0] >= need:
            out.append((seeds.item_ids[k], round(best[0] / m, 6), best[1], best[2]))
    return sorted(out)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The benchmark in blocks of about ``block_bytes`` of text, so that what is broadcast has a bound."""
    items = pick(benchmark, id=id_col, text=text_col).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        got = [(r["id"], plain_words(r["text"])) for r in part.sort("id", "text").collect()]
        if got := [x for x in got if x[1]]:
            yield got


def _finder(sent, min_score: float, kind: str):
    @F.pandas_udf(HIT.format(kind))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([
                [{"item_id": i, "score": s, "start": a, "words": n} for i, s, a, n in passages(plain_words(t), sent.value, min_score)]
                for t in texts
            ], dtype=object)

    return found


def _hits(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text",
          seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id`` and ``hit`` of ``docs`` (``id``, ``text``) for all blocks of the benchmark.

    One block is one pass, and its broadcast is freed before the next begins: the
    hits of each are written to the shared folder. The last block, which mostly is
    the only one, is part of the caller's own plan.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    kind = pick(benchmark, id=item_id).dtypes[0][1]
    done, last, sent = [], docs.select("id", F.explode(F.array().cast(HIT.format(kind))).alias("hit")), None
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        if sent is not None:
            done.append(cut(last))
            sent.unpersist(blocking=True)
        sent = spark.sparkContext.broadcast(all_seeds(items, seed_words))
        last = docs.select("id", F.explode(_finder(sent, min_score, kind)(F.col("text"))).alias("hit"))
    return reduce(DataFrame.unionAll, [*done, last])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and benchmark item that it holds: id, ``item_id``, ``score``, ``start``, ``words``.

    ``score`` is the alignment's share of the item's words, ``min_score`` or more;
    items under eight words must stand in the text word for word. ``start`` and
    ``words`` give the passage in the document's plain words.

    * null and empty texts hold nothing; items without words, or null ids, are not sought;
    * a row that repeats returns its rows again; an item that repeats counts as one more item;
    * ids of documents and items may be of any type; very long texts are searched whole, a window about each seed at a time;
    * an empty table on either side gives no rows; extra columns are not read.

    One pass over the documents for each block of the benchmark, one after another,
    without a shuffle: all seeds are looked up, however many documents hold them, and
    passages whose words could score enough are aligned. A copy without
    ``seed_words`` words in a row as in the item isn't found. What is broadcast is one
    block at a time, of bounded size.
    """
    src = pick(docs, id=id_col, text=text_col)
    return _hits(src, benchmark, **options).select(F.col("id").alias(id_col), "hit.item_id", "hit.score", "hit.start", "hit.words")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                 seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay.

    Null and empty texts hold nothing and stay, as do null ids; rows that repeat are judged each; an empty table on either side drops nothing.

    Each block of the benchmark but the last leaves a table of what it keeps in the shared folder, which the next one reads.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows, names = flat(docs)
    kind = pick(benchmark, id=item_id).dtypes[0][1]
    sent, path = None, None
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        if sent is not None:
            before = path
            rows, path = stored(rows)
            sent.unpersist(blocking=True)
            if before is not None:
                remove(spark, before)
        sent = spark.sparkContext.broadcast(all_seeds(items, seed_words))
        rows = rows.where(F.size(_finder(sent, min_score, kind)(rows[at(docs, text_col)])) == 0)
    return rows.toDF(*names)
