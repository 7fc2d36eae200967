"""A word-level FM-index: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled positions.

Built and searched with numpy only. Symbols are small integers; documents end with SEP. Every separator counts as a symbol of
its own when suffixes are compared, so no comparison runs past a document and repeated documents cost log2(words) rounds at most.
"""

from __future__ import annotations

import numpy as np

SEP, OTHER, FIRST = 0, 1, 2  # end of a document, word outside the vocabulary, first word of the vocabulary


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Suffix array of sym, which ends with SEP."""
    n = len(sym)
    seps = sym == SEP
    key = sym.astype(np.int64) + int(seps.sum())
    key[seps] = np.arange(seps.sum())
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, at, 0))
    open_ = at[~(new & np.append(new[1:], True))]
    h = 1
    while len(open_):
        pos = sa[open_]
        both = rank[pos] * n + rank[pos + h]
        order = np.argsort(both, kind="stable")
        pos, both = pos[order], both[order]
        sa[open_] = pos
        new = np.empty(len(pos), bool)
        new[0] = True
        np.not_equal(both[1:], both[:-1], out=new[1:])
        rank[pos] = open_[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class Bits:
    """A bit vector with rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, bits.dtype)), bitorder="little").view(np.uint64)
        self.words = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Backward search and location of word sequences.

    sym: words of all documents, each document followed by SEP. sigma: number of symbols. step: one position in `step` is kept.
    """

    def __init__(self, sym: np.ndarray, sigma: int, step: int = 4) -> None:
        self.n, self.step = len(sym), step
        sa = suffix_array(sym)
        bwt = sym[sa - 1]
        self.first = np.append(0, np.cumsum(np.bincount(sym, minlength=sigma)))[:sigma].astype(np.int64)
        # positions that begin a document are kept too: no walk crosses a separator, whose rows are ordered by document
        kept = (sa % step == 0) | (bwt == SEP)
        self.kept, self.positions = Bits(kept), sa[kept].astype(np.int32)
        self.levels: list[tuple[int, Bits, int]] = []
        cur = bwt.astype(np.int32)
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (cur >> shift) & 1 == 1
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            one = bits.rank(i)
            i = np.where((c >> shift) & 1 == 1, zeros + one, i - one)
        return i

    def search(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the range [lo, hi) of suffixes that begin with it."""
        lo, hi = np.zeros(len(grams), np.int64), np.full(len(grams), self.n, np.int64)
        for k in range(grams.shape[1] - 1, -1, -1):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            c = grams[live, k].astype(np.int64)
            base = self.first[c] - self.begin[c]
            lo[live] = base + self._down(c, lo[live])
            hi[live] = base + self._down(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the text of each suffix, walking back to a kept one."""
        out = np.empty(len(rows), np.int64)
        left, at, walked = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            hit = self.kept.get(at)
            out[left[hit]] = self.positions[self.kept.rank(at[hit])].astype(np.int64) + walked
            left, at = left[~hit], at[~hit]
            i, c = at, np.zeros(len(at), np.int64)
            for shift, bits, zeros in self.levels:
                one, bit = bits.rank(i), bits.get(i)
                c |= bit.astype(np.int64) << shift
                i = np.where(bit, zeros + one, i - one)
            at = self.first[c] + i - self.begin[c]
            walked += 1
        return out
