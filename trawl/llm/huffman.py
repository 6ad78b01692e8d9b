"""Canonical length-limited Huffman codes: lengths by package-merge, codes in canonical order, table-driven decoding.

Bits go from the high end of each byte. A code stream holds a checkpoint, its bit offset, every STEP symbols, so that
decoding runs in lockstep over all checkpoints: one table look-up a symbol for as many symbols as there are checkpoints.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STEP = 128
#: No code is longer, unless there are too many symbols for it.
LIMIT = 20
#: Bits of the first table; longer codes go on in a second one.
ROOT = 12


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code for symbols of these counts (over 0) with no length over the limit.

    Package-merge: the list of each level holds the symbols and the pairs of the level before, by weight; of the last
    one the first 2n - 2 entries count, and a pair among them counts its two entries one level back. How often a symbol
    counts is its length. Ties go to the symbol, then to the smaller number.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, np.uint8)
    limit = max(limit, (n - 1).bit_length() + 1)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    current, single = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        current = both[at]
        single.append(at < n)
    lengths = np.zeros(n, np.uint8)
    taken = 2 * n - 2
    for flags in reversed(single):
        symbols = int(flags[:taken].sum())
        lengths[:symbols] += 1
        taken = 2 * (taken - symbols)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


@dataclass
class Code:
    """symbols, ascending, and the length of each one's code; all else follows from these."""

    symbols: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.longest = int(self.lengths.max(initial=1))
        self.ranked = np.lexsort((self.symbols, self.lengths))
        sizes = self.lengths[self.ranked].astype(np.int64)
        steps = np.left_shift(np.int64(1), self.longest - sizes)
        aligned = np.cumsum(steps) - steps
        top = int(self.symbols.max(initial=0)) + 1
        self.code, self.size = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.symbols[self.ranked]] = (aligned >> (self.longest - sizes)).astype(np.uint64)
        self.size[self.symbols[self.ranked]] = sizes
        self._tables(aligned, sizes)

    def _tables(self, aligned: np.ndarray, sizes: np.ndarray) -> None:
        """One entry for each start of ROOT bits: symbol and length, or the place of its second table."""
        root = min(ROOT, self.longest)
        self.rest = self.longest - root
        short = sizes <= root
        entries = (self.symbols[self.ranked].astype(np.int64) << 6) | sizes
        first = np.zeros(1 << root, np.int64)
        spread = np.repeat(entries[short], 1 << (root - sizes[short]))
        first[: len(spread)] = spread
        inner = np.repeat(entries[~short], 1 << (self.longest - sizes[~short]))
        starts = np.arange(len(spread), 1 << root)
        first[starts] = -1 - (starts - len(spread)) * (1 << self.rest)
        inner = np.concatenate([inner, np.zeros(max(0, len(starts) * (1 << self.rest) - len(inner)), np.int64)])
        self.first, self.second, self.root = first, inner, root

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's stream from a whole byte on: all bytes, where each text's begin (and the end), bit offsets in the
        text of its checkpoints, and where each text's checkpoints begin. A text's ids are ids[bounds[i]:bounds[i + 1]]."""
        sizes = self.size[ids]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        bits = ends[bounds[1:]] - ends[bounds[:-1]]
        byte_bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum((bits + 7) >> 3)])
        counts = np.diff(bounds)
        at = ends[:-1] + np.repeat(8 * byte_bounds[:-1] - ends[bounds[:-1]], counts)
        words = np.zeros((int(byte_bounds[-1]) >> 2) + 3, np.uint64)
        if len(ids):
            word = at >> 5
            value = self.code[ids] << (64 - sizes - (at & 31)).astype(np.uint64)
            begins = np.flatnonzero(np.concatenate([np.ones(1, bool), word[1:] != word[:-1]]))
            words[word[begins]] += np.add.reduceat(value >> np.uint64(32), begins)
            words[word[begins] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), begins)
        data = words.astype(">u4").view(np.uint8)[: int(byte_bounds[-1])]
        points = -(-counts // STEP)
        point_bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(points)])
        inside = STEP * (np.arange(int(point_bounds[-1])) - np.repeat(point_bounds[:-1], points))
        marks = at[np.repeat(bounds[:-1], points) + inside] - 8 * np.repeat(byte_bounds[:-1], points)
        return data, byte_bounds, marks, point_bounds

    def decode(self, data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The symbols of runs of codes: run i starts at bit starts[i] of data and holds counts[i] <= STEP symbols."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        n = len(padded) - 4
        window = np.zeros(n, np.uint64)
        for k in range(5):
            window |= padded[k : k + n] << np.uint64(32 - 8 * k)
        order = np.argsort(-counts, kind="stable")
        at, left = starts[order].astype(np.int64), counts[order]
        places = (np.cumsum(counts) - counts)[order]
        out = np.zeros(int(counts.sum()), np.uint32)
        mask, second = (1 << self.longest) - 1, bool(self.rest)
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k, side="left"))
            now = at[:live]
            bits = (window[now >> 3] >> (40 - self.longest - (now & 7)).astype(np.uint64)).astype(np.int64) & mask
            entry = self.first[bits >> self.rest]
            if second:
                far = np.flatnonzero(entry < 0)
                entry[far] = self.second[-1 - entry[far] + (bits[far] & ((1 << self.rest) - 1))]
            out[places[:live] + k] = entry >> 6
            now += entry & 63
        return out
