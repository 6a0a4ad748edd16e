"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap gives the adjacent pair of lowest
rank, again and again. The count is the initial symbols less the merges; no
token ids are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, pick

LIMIT = 512
#: Counts remembered per Python worker; a full store is emptied, which costs time and changes nothing.
REMEMBERED = 400_000
#: The byte-level vocabulary's own split of a text into words (fixed value of the format). White space is
#: Unicode's: Python's own has four control characters more.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
GAP = regex.compile(r"\p{White_Space}{2}")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairCounter:
    """Counts tokens of texts with one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: pair of symbols -> (rank, merged symbol)
        self.ranks = {pair: (rank, pair[0] + pair[1]) for rank, pair in enumerate(merges)}
        self.symbols = byte_symbols()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Symbols of one word after all merges, the lowest rank first and the leftmost of equals."""
        sym = [self.symbols[b] for b in word.encode()]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if found := ranks.get((sym[i], sym[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, merged = heapq.heappop(heap)
            left = sym[i]
            if left is None or (j := after[i]) >= n or left + sym[j] != merged or (left, sym[j]) not in ranks or ranks[left, sym[j]][1] is not merged:
                continue  # one of the two has gone into another merge meanwhile
            sym[i], sym[j] = merged, None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if found := ranks.get((merged, sym[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((sym[h], merged))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return n - merges

    def _words(self, chunk: str) -> int:
        total = 0
        for w in PATTERN.findall(chunk):
            n = self.words.get(w)
            if n is None:
                n = self.word(w)
                if len(w) < 64:
                    self.words[w] = n
            total += n
        return total

    def _chunk(self, chunk: str) -> int:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        n = self._words(chunk)
        if len(chunk) < 64:
            self.chunks[chunk] = n
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        A space between two other characters always begins a word, and a line feed
        between two others is a word, so such texts fall apart into short chunks,
        most of which are remembered. Texts with runs of white space are split whole.
        """
        if GAP.search(text):
            return self._words(text)
        get, total = self.chunks.get, -1
        for line in text.split("\n"):
            total += 1
            first = True
            for piece in line.split(" "):
                if not first:
                    piece = " " + piece
                first = False
                if piece:
                    n = get(piece)
                    total += self._chunk(piece) if n is None else n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


_counters: dict[str, PairCounter] = {}


def counter(path: str) -> PairCounter:
    """One counter a Python worker and vocabulary."""
    if path not in _counters:
        _counters[path] = PairCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` names a byte-level vocabulary on every machine. Special strings count
    as one token, as by the library's default. Null and empty texts have none of
    either. Rows that repeat, null ids and extra columns need no care: each row is
    counted by itself, in place, without a shuffle.
    """
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t) if t else 0 for t in texts], dtype="int64")

    src = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    out = src.select("id", F.octet_length("text").cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
