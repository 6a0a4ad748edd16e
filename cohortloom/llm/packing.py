"""Packing documents into fixed windows by the online sum-of-squares rule.

``levels[h]`` counts the open windows filled to ``h`` tokens. Each piece goes to
the level that makes the sum of squared counts smallest, so that no fill level
piles up and pieces keep finding windows that they fill to the brim.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import arrow_batches, pick
from .token_counts import byte_symbols

WINDOW = 2048
END_ID = 1
#: Words and parts of words whose ids a Python worker remembers, in two generations of so many.
WORDS = 80_000
#: Windows that are open at a time in one task: at most 16 MB of ids.
MOST_OPEN = 2048
#: Sequence ids of one task: its partition's number in the upper bits.
SEQUENCES_BITS = 33
#: Pieces in one batch that a task returns.
BATCH = 20_000


#: How the vocabulary splits a word (fixed value of its file), on letters up to ``PLAIN``; other words it splits itself.
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = "\u024f"
MARKS = frozenset(".,;:!?")
SYMBOLS = byte_symbols()
SPACES = str.maketrans("\n\t\r\x0b\x0c", "     ")


class WordIds:
    """Token ids of whole texts from the ids of their words.

    The vocabulary's splitter never joins characters across white space, and its
    normaliser works on each side alone, so the ids of a text are those of its
    white-space separated words, one after another, and those of a word are its
    parts'. Ids are kept as bytes, which are joined to the text's. What is kept are
    the last ``WORDS`` to twice as many distinct words and parts, in two generations.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _symbols(self, part: str) -> bytes:
        """Ids of one lower-case part, which the model takes with a symbol for each byte."""
        symbols = part if part.isascii() else "".join([SYMBOLS[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _known(self, word: str) -> bytes:
        found = self.new.get(word)
        return self._learn(word) if found is None else found

    def _learn(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            core = word[:-1] if word[-1:] in MARKS else word
            if core.isalpha() and core.islower() and (core.isascii() or max(core) <= PLAIN):  # most words, and told quickly
                found = self._symbols(core) if core is word else self._known(core) + self._known(word[-1])
            elif "<" in word or word != word.lower() or not word.isprintable() or (not word.isascii() and max(word) > PLAIN):
                found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            else:
                parts = PART.findall(word)
                found = self._symbols(parts[0]) if len(parts) == 1 else b"".join(map(self._known, parts))
        if len(word) < 64:
            self.new[word] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        # Python lowers the capital sigma by its place in the word and the vocabulary doesn't; special strings are lower case
        plain = "<|" not in text and "\u03a3" not in text and "\u0130" not in text
        text = text.lower() if plain else text
        odd = any(c in text for c in "\t\r\x0b\x0c")
        words = (text.translate(SPACES) if odd else text.replace("\n", " ")).split(" ")
        found = list(map(self.new.get, words))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self._known(words[i])
        if len(self.new) >= WORDS:
            self.new, self.old = {}, self.new
        return np.frombuffer(b"".join(found), "<u4")


@dataclass
class Piece:
    """Ids ``start`` and on of a document of ``total`` ids; ``moved`` if it was taken out of the window that the rule chose."""

    doc: object
    start: int
    ids: np.ndarray
    total: int
    moved: bool = False


class Windows:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.held = 0

    def choose(self, size: int) -> int:
        """The level to put ``size`` tokens on; 0 opens a new window.

        Moving a window from level h to h + size changes the sum of squares by
        2 * (N[h+size] - N[h] + 1); a filled window leaves the sum, and a new one enters it.
        """
        top = self.window - size
        n = self.levels
        change = np.where(n[1:top] > 0, 2 * (n[1 + size : self.window] - n[1:top]) + 2, np.iinfo(np.int64).max) if top > 1 else np.empty(0, np.int64)
        best, cost = 0, 2 * int(n[size]) + 1
        if len(change) and change.min() <= cost:
            best = 1 + int(change.argmin())
            cost = int(change[best - 1])
        if top and n[top] and 1 - 2 * int(n[top]) <= cost:
            best = top
        return best

    def _take(self, level: int) -> list[Piece]:
        self.levels[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, pieces: list[Piece]) -> None:
        self.levels[level] += 1
        self.open[level].append(pieces)

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Put a piece where the rule says; the windows that this fills, or that have to give way to it."""
        size = len(piece.ids)
        level = self.choose(size) if size < self.window else 0
        held = [*self._take(level), piece] if level else [piece]
        if level + size == self.window:
            self.held -= level
            yield held
            return
        self.held += size
        self._put(level + size, held)
        if int(self.levels.sum()) > self.most_open and self.held >= self.window:
            yield self._top_up()

    def _top_up(self) -> list[Piece]:
        """The fullest open window, filled with what the emptiest ones hold last: no more tokens move than it lacks."""
        level = int(np.nonzero(self.levels)[0][-1])
        held, lacks = self._take(level), self.window - level
        while lacks:
            level = int(np.nonzero(self.levels)[0][0])
            donor = self._take(level)
            last = donor.pop()
            n = min(len(last.ids), lacks)
            cut = len(last.ids) - n
            held.append(Piece(last.doc, last.start + cut, last.ids[cut:], last.total, True))
            if cut:
                donor.append(Piece(last.doc, last.start, last.ids[:cut], last.total, last.moved))
            if donor:
                self._put(level - n, donor)
            lacks -= n
        self.held -= self.window
        return held

    def finish(self) -> Iterator[list[Piece]]:
        """Fill the open windows; what remains, less than a window, goes into sequences whose lengths are powers of two."""
        while self.held >= self.window:
            yield self._top_up()
        left = self.held
        rest = [p for held in self.open for pieces in held for p in pieces]
        room = 0
        held: list[Piece] = []
        for p in rest:
            done = 0
            while done < len(p.ids):
                room = room or 1 << (left.bit_length() - 1)
                n = min(room, len(p.ids) - done)
                held.append(Piece(p.doc, p.start + done, p.ids[done : done + n], p.total, True))
                done, room, left = done + n, room - n, left - n
                if not room:
                    yield held
                    held = []


def pack_pieces(docs: Iterator[tuple], ids_of, window: int = WINDOW, end_id: int = END_ID, most_open: int = MOST_OPEN) -> Iterator[tuple]:
    """(doc, start, length, crc, doc_tokens, sequence, offset, moved) for each piece of ``docs``, pairs of doc and text.

    A document fills windows of its own as long as it can; the sum-of-squares rule
    places what is left. Ids are held only while their window is open. Beyond
    ``most_open`` windows, and at the end, the fullest is topped up from the emptiest.
    """
    w, seq = Windows(window, most_open), 0

    def full() -> Iterator[list[Piece]]:
        for doc, text in docs:
            ids = np.append(ids_of(text) if text else np.empty(0, "<u4"), end_id).astype("<u4")
            for start in range(0, len(ids), window):
                part = ids[start : start + window]
                yield from w.place(Piece(doc, start, part if len(part) == window else part.copy(), len(ids)))
        yield from w.finish()

    for held in full():
        offset = 0
        for p in held:
            yield p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, seq, offset, p.moved
            offset += len(p.ids)
        seq += 1


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One store of word ids a Python worker and vocabulary."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens; one row per piece.

    Each document is its ids by the ``tokenizers`` file at ``path`` (white space must
    only separate words there, as in word_bpe_49k.json), then ``end_id``. Each task
    packs the documents of its own partition: no shuffle, and a lost task is redone
    alone. All sequences but a task's last few are full; those few have lengths that
    are powers of two, so nothing is padded. ``moved`` tells pieces that were cut
    out of the window that the rule had chosen to fill up another one.

    * null and empty texts are the end id alone;
    * rows that share an id, null ids included, are packed as documents of their own;
    * ids may be of any type and come back as they are;
    * a long document is cut at every window; an empty table gives no rows.

    ``sequence_id`` has the partition's number in its upper bits.
    """
    arrow_batches(docs.sparkSession)
    src = pick(docs, id=id_col, text=text_col)
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = StructType([StructField("doc_id", src.schema["id"].dataType), *[StructField(n, LongType()) for n in numbers], StructField("moved", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << SEQUENCES_BITS
        kind: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kind[:] = [b.schema.field(0).type]
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

        block: list[tuple] = []
        for piece in pack_pieces(rows(), word_ids(path).ids, window, end_id):
            block.append(piece)
            if len(block) >= BATCH:
                yield batch(block, kind[0], first)
                block = []
        if block:
            yield batch(block, kind[0], first)

    def batch(block: list[tuple], kind: pa.DataType, first: int) -> pa.RecordBatch:
        doc, *counts, moved = zip(*block)
        counts[4] = [first + s for s in counts[4]]
        columns = [pa.array(doc, kind), *[pa.array(c, pa.int64()) for c in counts], pa.array(moved, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *numbers, "moved"])

    return src.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
