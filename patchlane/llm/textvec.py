"""Vectorised word, line and shingle hashing of UTF-8 text batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit: a polynomial of the bytes modulo
2^64, taken from one running sum of the whole batch, then mixed. Equal strings always get equal hashes; different
strings collide with a chance of about 2^-64 a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C55)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Odd factors of the places of a shingle; further places continue the same rule.
_PLACES = 64
WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that one step of the running sum covers; memory doesn't grow with the text.
BLOCK = 1 << 18
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


PLACE = mix(np.arange(1, _PLACES + 1, dtype=np.uint64) * BASE) | np.uint64(1)


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to BLOCK."""
    if not _powers:
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK, b, np.uint64)]) for b in (BASE, BASE_INVERSE)]
    return _powers[0], _powers[1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the int64 offsets of its rows; nulls count as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Spans:
    """Spans (words or lines) of a batch: start and end bytes, and the range of spans of each document."""

    def __init__(self, start: np.ndarray, end: np.ndarray, offsets: np.ndarray):
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets).astype(np.int64)  # spans of document d: first[d] .. first[d + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(raw: np.ndarray, offsets: np.ndarray) -> Spans:
    solid = ~WS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a document's first byte starts a word, the byte before it ends one
    before, after = np.r_[False, solid[:-1]] if len(raw) else solid, np.r_[solid[1:], False] if len(raw) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Spans(start, end, offsets)


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every line (text between line feeds; a text of n feeds has n + 1 lines)."""
    feeds = np.flatnonzero(raw == 10)
    start = np.sort(np.r_[offsets[:-1], feeds + 1])
    doc = np.repeat(np.arange(len(offsets) - 1), 1 + np.diff(np.searchsorted(feeds, offsets)))
    end = np.sort(np.r_[feeds, offsets[1:]])
    return start, end, doc


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of raw; starts and ends ascend."""
    p, inverse = powers()
    at_start, at_end, unshift = (np.zeros(len(start), np.uint64) for _ in range(3))
    carry, shift, back, whole = 0, 1, 1, 1 << 64
    total = np.zeros(BLOCK + 1, np.uint64)
    for low in range(0, len(raw) + 1, BLOCK):
        part = raw[low : low + BLOCK]
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=total[1 : len(part) + 1])
        total[1 : len(part) + 1] *= np.uint64(shift)
        total[: len(part) + 1] += np.uint64(carry)
        a, b = np.searchsorted(start, (low, low + BLOCK))
        at_start[a:b] = total[start[a:b] - low]
        unshift[a:b] = inverse[start[a:b] - low] * np.uint64(back)
        a, b = np.searchsorted(end, (low, low + BLOCK))
        at_end[a:b] = total[end[a:b] - low]
        carry = int(total[len(part)])
        shift, back = shift * int(p[BLOCK]) % whole, back * int(inverse[BLOCK]) % whole
        total[0] = 0
    return mix((at_end - at_start) * unshift + (end - start).astype(np.uint64) * PLACE[0])


def windows(word_hash: np.ndarray, spans: Spans, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first-word index of every n-word window inside one document."""
    counts = spans.counts()
    if len(word_hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(word_hash) - n + 1, np.uint64)
    for k in range(n):
        h += word_hash[k : len(word_hash) - n + 1 + k] * PLACE[k]
    left = np.repeat(spans.first[1:], counts)[: len(h)] - np.arange(len(h))  # words from here to the document's end
    at = np.flatnonzero(left >= n)
    return mix(h[at]), at
