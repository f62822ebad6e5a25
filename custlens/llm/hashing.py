"""Hashes of words and runs of words over the bytes of a batch of texts, as NumPy columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits, one to one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_tables: dict[int, np.ndarray] = {}


def powers(size: int, base: np.uint64) -> np.ndarray:
    """The first powers of ``base``; the longest table so far is kept."""
    have = _tables.get(int(base))
    if have is None or len(have) < size:
        have = np.full(1 << max(16, int(size - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        _tables[int(base)] = have = np.cumprod(have, dtype=np.uint64)
    return have[:size]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end behind; texts without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """The words of a batch: where each begins and ends in the bytes, its text, its hash; and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Runs of bytes other than ASCII white space; ``lower`` takes A-Z as a-z."""
    raw, offsets = text_bytes(texts)
    data = _LOWER[raw] if lower else raw
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = inside[1:] != inside[:-1]
    if n:
        edge[0], edge[n] = inside[0], inside[-1]
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts - 1]]  # a word up to a text's end and one from the next text's beginning
    places = np.flatnonzero(edge)
    if len(both):
        places = np.sort(np.concatenate([places, both, both]), kind="stable")
    start, end = places[0::2], places[1::2]
    power, total = powers(n + 1, BASE), np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    value = (total[end] - total[start]) * powers(n + 1, INVERSE)[start]
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(raw, start, end, doc, mix(value + (end - start).astype(np.uint64) * BASE), first)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n successive word hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out *= BASE
        out += hashes[k:k + count]
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` successive values, the place of the smallest, the leftmost of equals."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    best, place, have = values.copy(), np.arange(len(values)), 1
    while have < width:  # doubling: minima of windows of `have`, then of twice that or what is left
        step = min(have, width - have)
        other, at = best[step:], place[step:]
        better = other < best[:len(other)]
        best, place = np.where(better, other, best[:len(other)]), np.where(better, at, place[:len(other)])
        have += step
    return place[:count]


def byte_run_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n successive bytes."""
    count = len(data) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = byte_sums(data)
    return mix((total[n:] - total[:count]) * powers(len(data) + 1, INVERSE)[:count])


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any run of bytes follows."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1, BASE)[:-1], out=total[1:])
    return total
