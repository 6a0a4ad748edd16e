"""Counting quotient filters as arrays.

A fingerprint's high bits, the quotient, name its slot; its low bits, the
remainder, are stored there in order, with a count. So a filter is its fingerprints
sorted: two of them merge as sorted lists do, and nothing is lost.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BITS = 64
#: Counts from here on stand behind the others in eight bytes each.
ESCAPE = 255


class Filter(NamedTuple):
    """One filter: a quotient has ``q`` bits; ``runs`` holds, quotient by quotient, a one for each remainder and then a zero."""

    q: int
    n: int
    runs: bytes
    remainders: bytes
    counts: bytes


def low(prints: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits."""
    return prints & np.uint64((1 << bits) - 1) if bits < BITS else prints


def high(prints: np.ndarray, bits: int) -> np.ndarray:
    """The highest ``bits`` bits."""
    return prints >> np.uint64(BITS - bits) if bits else np.zeros_like(prints)


def encode(prints: np.ndarray, counts: np.ndarray, top: int = 0) -> Filter:
    """A filter of distinct fingerprints in ascending order that share their ``top`` highest bits; these are not stored."""
    n, width = len(prints), BITS - top
    q = min(max(n - 1, 0).bit_length(), width)
    rest = low(prints, width)
    quotients = (rest >> np.uint64(width - q)).astype(np.int64) if q else np.zeros(n, np.int64)
    runs = np.zeros((1 << q) + n, np.uint8)
    runs[quotients + np.arange(n)] = 1
    size = -(-(width - q) // 8)
    remainders = low(rest, width - q).astype("<u8").view(np.uint8).reshape(n, 8)[:, :size]
    small = np.minimum(counts, ESCAPE).astype(np.uint8)
    return Filter(q, n, np.packbits(runs).tobytes(), np.ascontiguousarray(remainders).tobytes(), small.tobytes() + counts[counts >= ESCAPE].astype("<u8").tobytes())


def decode(f: Filter, top: int = 0, block: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in ascending order and their counts, from a filter of those whose ``top`` highest bits are ``block``."""
    width = BITS - top
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(f.runs, np.uint8), count=(1 << f.q) + f.n))
    quotients = (ones - np.arange(f.n)).astype(np.uint64)
    size = -(-(width - f.q) // 8)
    wide = np.zeros((f.n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(f.remainders, np.uint8).reshape(f.n, size)
    prints = wide.view("<u8").reshape(f.n).astype(np.uint64)
    if f.q:
        prints |= quotients << np.uint64(width - f.q)
    if top:
        prints |= np.uint64(block << width)
    counts = np.frombuffer(f.counts, np.uint8, f.n).astype(np.int64)
    counts[counts == ESCAPE] = np.frombuffer(f.counts, "<u8", offset=f.n).astype(np.int64)
    return prints, counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints with counts, from several such lists; counts of the same fingerprint add up."""
    prints, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(prints, kind="stable")  # finds the sorted lists and merges them
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts
