"""A run-length index of a text: its Burrows-Wheeler transform as runs, with text places sampled at the ends of runs.

The index answers matching statistics: for every place of a pattern, the longest match into the text. Many patterns are
streamed side by side, from their ends to their beginnings. A step inside a run moves by the run's counts alone; where
the next character differs from the run's, the match goes on from the end of the run before or the start of the run
after that has it, whichever agrees longer; their text places are the samples.
"""

from __future__ import annotations

import numpy as np

#: Stands between pieces of text; no UTF-8 text has it.
BREAK = 0xFF


def eights(data: np.ndarray) -> np.ndarray:
    """For each place the next eight bytes as a number that orders like them; nothing counts as zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(data)]
    return out


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    begins = np.ones(len(own), dtype=np.int64)
    begins[1:] = own[1:] != own[:-1]
    rank = np.empty(len(own), dtype=np.int64)
    rank[order] = np.cumsum(begins)
    return order, rank, int(begins.sum())


def doubled_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for places whose next ``depth`` bytes (a power of two from 8) are equal, in their order."""
    _, rank, _ = _ranks(eights(data))
    have = 8
    while have < depth:
        _, rank, _ = _ranks(_pair(rank, have))
        have *= 2
    return rank


def _pair(rank: np.ndarray, have: int) -> np.ndarray:
    behind = np.zeros(len(rank), dtype=np.int64)
    behind[:-have] = rank[have:] if have < len(rank) else 0
    return (rank << 32) | behind


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling."""
    order, rank, distinct = _ranks(eights(data))
    have = 8
    while distinct < len(data):
        order, rank, distinct = _ranks(_pair(rank, have))
        have *= 2
    return order


class RunLengthIndex:
    def __init__(self, data: np.ndarray, window: int):
        """``data`` in pieces, each with BREAK behind it; matches are followed up to ``window`` bytes."""
        self.window = window
        self.words = eights(data)
        order = suffix_order(data)
        last = data[order - 1]  # the transform; before the first byte stands the last one
        begins = np.ones(len(last), dtype=bool)
        begins[1:] = last[1:] != last[:-1]
        self.start = np.flatnonzero(begins)
        ends = np.append(self.start[1:], len(last)) - 1
        self.char = last[self.start].astype(np.int64)
        self.first_place, self.last_place = order[self.start], order[ends]
        self.end = ends
        length = ends - self.start + 1
        # runs by character: how many rows with it stand before the run, and where its rows begin in the first column
        by_char = np.argsort(self.char, kind="stable")
        total = np.cumsum(length[by_char]) - length[by_char]
        self.target = np.empty(len(length), dtype=np.int64)  # where the run's first row moves to
        self.target[by_char] = total
        self.keys = self.char[by_char] * (len(length) + 1) + by_char
        self.by_char = by_char

    @property
    def runs(self) -> int:
        return len(self.start)

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes agree from the places a and b on, up to ``most``."""
        out = np.zeros(len(a), dtype=np.int64)
        alive = np.flatnonzero(most > 0)
        n = len(self.words)
        while len(alive):
            x, y = a[alive] + out[alive], b[alive] + out[alive]
            inside = (x < n) & (y < n)
            alive, x, y = alive[inside], x[inside], y[inside]
            differ = self.words[x] ^ self.words[y]
            same = differ == 0
            more = np.full(len(alive), 8, dtype=np.int64)
            if not same.all():
                # the exponent of the highest differing bit tells the first differing byte; 48 bits convert exactly
                low = differ[~same]
                bits = np.frexp((low >> np.uint64(16)).astype(np.float64))[1]
                more[~same] = np.where(bits > 0, (48 - bits) // 8, np.where(low >> np.uint64(8) > 0, 6, 7))
            out[alive] += more
            alive = alive[same & (out[alive] < most[alive])]
        return np.minimum(out, most)

    def match_lengths(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """For patterns data[start:start + length], the matching statistics of each step from the end: one array per step
        over the patterns that are so long, ordered by falling length."""
        lanes = len(start)
        row = np.zeros(lanes, dtype=np.int64)
        place = np.full(lanes, self.first_place[0], dtype=np.int64)
        have = np.zeros(lanes, dtype=np.int64)
        out = []
        for step in range(1, int(length.max(initial=0)) + 1):
            n = int(np.searchsorted(-length, -step, side="right"))
            char = data[start[:n] + length[:n] - step].astype(np.int64)
            r, p, h = row[:n], place[:n], have[:n]
            run = np.searchsorted(self.start, r, side="right") - 1
            stay = self.char[run] == char
            off = np.flatnonzero(~stay)
            if len(off):
                at = np.searchsorted(self.keys, char[off] * (self.runs + 1) + run[off])
                before, after = at - 1, np.minimum(at, len(self.keys) - 1)
                has_before = (before >= 0) & (self.char[self.by_char[before]] == char[off])
                has_after = (at < len(self.keys)) & (self.char[self.by_char[after]] == char[off])
                run_b, run_a = self.by_char[before], self.by_char[after]
                agree_b = np.where(has_before, self._agree(p[off], self.last_place[run_b], h[off] * has_before), -1)
                agree_a = np.where(has_after, self._agree(p[off], self.first_place[run_a], h[off] * has_after), -1)
                up = agree_b >= agree_a
                known = has_before | has_after
                run[off] = np.where(known, np.where(up, run_b, run_a), run[off])
                r[off] = np.where(known, np.where(up, self.end[run_b], self.start[run_a]), r[off])
                p[off] = np.where(known, np.where(up, self.last_place[run_b], self.first_place[run_a]), p[off])
                h[off] = np.where(known, np.maximum(agree_b, agree_a), -1)
                stay[off[known]] = True
            # characters that the text doesn't have leave the match empty where it is
            moved = np.flatnonzero(stay)
            r[moved] = self.target[run[moved]] + r[moved] - self.start[run[moved]]
            p[moved] = np.where(p[moved] > 0, p[moved] - 1, len(self.words) - 1)
            np.minimum(h + 1, self.window, out=h)
            out.append(h.copy())
        return out
