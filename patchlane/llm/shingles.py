"""Shingle sets of texts as 64-bit hashes.

The words of a text, A-Z in lower case, give its distinct n-word shingles; a text of fewer words gives its whole word
sequence as one shingle; a text without words gives none. Different shingles share a hash with a chance of 2^-64 a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textvec

FIRST, SECOND = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of all shingles, repeats included, by row."""
    raw, offsets = textvec.utf8(texts)
    raw = textvec.LOWER[raw]
    spans = textvec.words(raw, offsets)
    word = textvec.hashes(raw, spans.start, spans.end)
    h, at = textvec.windows(word, spans, n)
    row = np.searchsorted(spans.first, at, "right") - 1
    counts = spans.counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            own[has] += word[spans.first[short[has]] + k] * textvec.PLACE[k]
        h, row = np.r_[h, textvec.mix(own ^ (counts[short].astype(np.uint64) * FIRST))], np.r_[row, short]
    return h, row


class Sets:
    """Distinct shingles of each row, ordered by (rank, hash); rank 0 for unknown, higher for more frequent ones."""

    def __init__(self, texts: pa.Array, n: int, rank=None):
        h, row = shingle_hashes(texts, n)
        ranks = rank(h) if rank and len(h) else np.zeros(len(h), np.uint64)
        rows = len(texts)
        order = None
        if rows < 1 << 20:
            key = row.astype(np.uint64) << np.uint64(44) | ranks.astype(np.uint64) << np.uint64(36) | h >> np.uint64(28)
            order = np.argsort(key)
            sorted_key, sorted_h = key[order], h[order]
            if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
                order = None  # different shingles of one row that the key doesn't tell apart
        if order is None:
            order = np.lexsort((h, ranks, row))
        h, row = h[order], row[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
        self.hash, row = h[new], row[new]
        self.first = np.searchsorted(row, np.arange(rows + 1))
        self.size = np.diff(self.first)
        self.row = row

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each row's set, of any order; 0 for empty sets."""
        out = []
        for seed, fold in ((FIRST, np.add), (SECOND, np.bitwise_xor)):
            value = np.zeros(len(self.size), np.uint64)
            full = self.size > 0
            if full.any():
                value[full] = fold.reduceat(textvec.mix(self.hash ^ seed), self.first[:-1][full])
            out.append(value.view(np.int64))
        return out[0], out[1]

    def marks(self, count: int) -> np.ndarray:
        """count 16-bit numbers of each row's set; two sets share one with a chance of their Jaccard similarity (and a little
        more): the least of the shingles' hashes under one order after another."""
        out = np.zeros((len(self.size), count), np.int32)
        full = self.size > 0
        for k in range(count if full.any() else 0):
            least = np.minimum.reduceat(textvec.mix(self.hash ^ textvec.PLACE[20 + k]), self.first[:-1][full])
            out[full, k] = (textvec.mix(least) & np.uint64(0xFFFF)).astype(np.int32)
        return out

    def parity(self, bits: int) -> np.ndarray:
        """For each row, whether each of `bits` ranges of hash values holds an odd number of shingles, as 64-bit words.

        A shingle that only one of two sets holds changes one bit, so the bits in which two rows differ are at most the
        shingles that are not shared."""
        part = (textvec.mix(self.hash ^ FIRST) % np.uint64(bits)).astype(np.int64)
        odd = np.zeros(len(self.size) * bits, np.uint8)
        rows = 2048
        for a in range(0, len(self.size), rows):  # some rows at once, whatever the slice holds
            b = min(a + rows, len(self.size))
            i, j = self.first[a], self.first[b]
            odd[a * bits : b * bits] = np.bincount((self.row[i:j] - a) * bits + part[i:j], minlength=(b - a) * bits) & 1
        return np.packbits(odd).view(np.int64).reshape(-1, bits // 64)
