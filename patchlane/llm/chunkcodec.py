"""Token ids of whole texts through a worker's table of distinct chunks.

A BPE tokenizer whose pre-tokens never cross a certain kind of boundary gives, for a text, the ids of the text's chunks
one after the other. Each distinct chunk is then encoded once by the tokenizers library and looked up after that.
Styles:

* ``word``: chunks are runs between ASCII white space (for tokenizers that drop white space);
* ``byte``: a chunk starts at every space (for byte-level pre-tokenizers, where a space can only be a token's first
  character or stand in a run of white space). Texts that hold a space after another white-space character have no such
  boundaries there and are encoded whole.

The table is keyed by 64-bit chunk hashes, so a batch is looked up without a Python string for each chunk. It holds at
most max_chunks entries, whatever the input; when it is full, entries that were used once make room."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textvec

#: White space as any of the regex engines sees it, followed by a space.
SPACE_AFTER_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}] "
JOINED = 512
#: Chunks whose pre-tokens are evident: Latin letters, digits and marks without an apostrophe or an angle bracket.
LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
SIGN = r"!-&(-/:;=?@\[-`{-~"
PLAIN, PIECES = re.compile(f" [{LETTER}0-9{SIGN}]+(?:\n[{LETTER}0-9{SIGN}]+)*"), re.compile(f" ?[{LETTER}]+| ?[0-9]+| ?[{SIGN}]+|\n")
#: The same by byte, for style word: 1 letters (those of two bytes start with LEAD), 2 digits, 3 signs, 0 all others.
LEAD, NO_LETTER = 0xC3, (0x97, 0xB7)
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[[*range(65, 91), *range(97, 123), LEAD, *range(0x80, 0xC0)]], KIND[48:58], KIND[[ord(c) for c in "'<>"]] = 1, 2, 0
#: Signs of byte-level tokenizers for the bytes that plain words can have; zero stays, as it parts words.
BYTE_SIGNS = np.arange(256, dtype="<u4")
BYTE_SIGNS[0x7F:0xA1], BYTE_SIGNS[0xAD] = np.arange(289, 323), 323


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 for all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    out = np.repeat(starts - before, lengths)
    out += np.arange(total)
    return out


class HashTable:
    """uint64 keys to the numbers 0, 1, 2, ... in the order of entry; open addressing in numpy arrays."""

    def __init__(self, capacity: int):
        self.bits = int(2 * capacity - 1).bit_length()
        self.keys, self.values, self.size = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 where there is none."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (keys & mask).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        left = np.flatnonzero((out < 0) & (self.values[slot] >= 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & int(mask)
            out[left] = np.where(self.keys[at] == keys[left], self.values[at], -1)
            left = left[(out[left] < 0) & (self.values[at] >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Enter distinct keys that are not in the table."""
        mask = (1 << self.bits) - 1
        slot, number, left = (keys & np.uint64(mask)).astype(np.int64), np.arange(self.size, self.size + len(keys), dtype=np.int32), np.arange(len(keys))
        self.size += len(keys)
        while len(left):
            at = slot[left]
            free = self.values[at] < 0
            self.values[at[free]] = number[left[free]]  # of several, one wins
            self.keys[at[free]] = keys[left[free]]
            won = self.values[at] == number[left]
            self.keys[at[won]] = keys[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask


class Chunks:
    """Chunks as UTF-8 bytes, one after the other; chunk i is raw[cuts[i] : cuts[i + 1]]."""

    def __init__(self, raw: np.ndarray, size: np.ndarray):
        self.raw, self.size, self.cuts = raw, size, np.r_[0, np.cumsum(size, dtype=np.int64)]

    @classmethod
    def cut(cls, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Chunks:
        return cls(raw[ragged(start, end - start)], end - start)

    @classmethod
    def of(cls, strings: list[str]) -> Chunks:
        held = [c.encode() for c in strings]
        return cls(np.frombuffer(b"".join(held), np.uint8), np.array([len(c) for c in held], np.int64))

    def take(self, at: np.ndarray) -> Chunks:
        return Chunks.cut(self.raw, self.cuts[at], self.cuts[at + 1])

    def strings(self) -> list[str]:
        text = self.raw.tobytes()
        return [text[a:b].decode() for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True)]


class ChunkEncoder:
    def __init__(self, path: str, style: str, max_chunks: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.style, self.max_chunks = style, max_chunks
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The same model for chunks whose pre-tokens are parted already: a line break or a zero stands between them.
        bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "added_tokens": []}
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"String": "\0"}, "behavior": "Removed", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]}
        if style == "word":  # bytes are turned into signs before
            bare["pre_tokenizer"] = {"type": "CharDelimiterSplit", "delimiter": "\0"}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.marked = np.array([p.endswith("</w>") if style == "word" else p.startswith("\u0120") for p in pieces])
        self.kind = np.uint16 if len(pieces) <= 1 << 16 else np.uint32
        self.reset()

    def reset(self) -> None:
        self.table, self.used = HashTable(self.max_chunks), np.zeros(0, np.int32)
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def is_plain(self, chunks: Chunks) -> np.ndarray:
        if self.style == "byte":
            return np.fromiter((PLAIN.fullmatch(c) is not None for c in chunks.strings()), bool, len(chunks.size))
        bad = KIND[chunks.raw] == 0
        bad[1:] |= (chunks.raw[:-1] == LEAD) & np.isin(chunks.raw[1:], NO_LETTER)
        return np.r_[0, np.cumsum(bad)][chunks.cuts[1:]] == np.r_[0, np.cumsum(bad)][chunks.cuts[:-1]]

    def pre_tokens(self, chunks: Chunks) -> tuple[Chunks, np.ndarray]:
        """The pre-tokens of plain words in lower case, and how many of them each word has."""
        raw, cuts = chunks.raw, chunks.cuts
        kind = KIND[raw]
        after = np.r_[False, raw[:-1] == LEAD] if len(raw) else np.zeros(0, bool)
        starts = kind == 2
        starts[1:] |= kind[1:] != kind[:-1]
        starts[cuts[:-1]] = True
        lower = np.where(after & (raw < 0x9F), raw + np.uint8(32), textvec.LOWER[raw])
        before = np.r_[0, np.cumsum(starts)]
        return Chunks(lower, np.diff(np.r_[np.flatnonzero(starts), len(raw)])), before[cuts[1:]] - before[cuts[:-1]]

    def encode_tokens(self, tokens: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after the other, and how many each has; JOINED of them are encoded as one text.

        The last id of a pre-token, and no other, has a piece that ends in the end-of-word suffix."""
        count = len(tokens.size)
        out = np.zeros(len(tokens.raw) + count, np.uint8)
        out[np.arange(len(tokens.raw)) + np.repeat(np.arange(count), tokens.size)] = tokens.raw  # a zero stands after each
        ends = tokens.cuts + np.arange(count + 1)
        edges = [*range(0, count, JOINED), count]
        texts = [BYTE_SIGNS[out[ends[i] : ends[j]]].tobytes().decode("utf-32-le") for i, j in zip(edges, edges[1:], strict=False)]
        made = self.bare.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, self.kind), *[np.array(e.ids, self.kind) for e in made]])
        return flat, np.diff(np.r_[-1, np.flatnonzero(self.marked[flat])]).astype(np.int32)

    def encode_plain(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks, one after the other, and how many each has; many chunks are encoded as one text.

        word: each distinct pre-token is encoded once.
        byte: the first id of a chunk, and no other, has a piece that starts with the sign for a space."""
        if self.style == "word":
            tokens, counts = self.pre_tokens(chunks)
            keys = textvec.hashes(tokens.raw, tokens.cuts[:-1], tokens.cuts[1:])
            _, first, which = np.unique(keys, return_index=True, return_inverse=True)
            ids, size = self.encode_tokens(tokens.take(first))
            start, sizes = np.cumsum(size, dtype=np.int64) - size, size[which]
            before = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
            last = np.r_[0, np.cumsum(counts)]
            return ids[ragged(start[which], sizes)], np.diff(before[last]).astype(np.int32)
        strings = chunks.strings()
        texts = ["\0".join(PIECES.findall("".join(strings[k : k + JOINED]))) for k in range(0, len(strings), JOINED)]
        flat, lengths = [np.zeros(0, self.kind)], [np.zeros(0, np.int32)]
        for e in self.bare.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, self.kind)
            flat.append(ids)
            lengths.append(np.diff(np.r_[np.flatnonzero(self.marked[ids]), len(ids)]).astype(np.int32))
        return np.concatenate(flat), np.concatenate(lengths)

    def encode_other(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        made = [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, self.kind) for c in chunks.strings()]
        return np.concatenate([np.zeros(0, self.kind), *made]), np.array([len(x) for x in made], np.int32)

    def encode_list(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and how many each has, without the table."""
        own = Chunks.of(chunks)
        plain = self.is_plain(own)
        made = [encode(own.take(np.flatnonzero(m))) for m, encode in ((plain, self.encode_plain), (~plain, self.encode_other))]
        at = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        lengths, starts = np.zeros(len(chunks), np.int32), np.zeros(len(chunks), np.int64)
        lengths[at] = np.r_[made[0][1], made[1][1]]
        starts[at] = np.cumsum(lengths[at], dtype=np.int64) - lengths[at]
        return np.r_[made[0][0], made[1][0]][ragged(starts, lengths)], lengths

    def enter(self, keys: np.ndarray, chunks: Chunks) -> None:
        if self.table.size + len(keys) > self.max_chunks:  # keep what was used more than once
            kept = np.flatnonzero(self.used > 1)
            kept = kept if len(kept) + len(keys) <= self.max_chunks else kept[:0]
            old = np.zeros(self.table.size, np.uint64)
            full = self.table.values >= 0
            old[self.table.values[full]] = self.table.keys[full]
            starts, lengths, flat = self.starts[kept], self.lengths[kept], self.flat
            self.max_chunks = max(self.max_chunks, len(keys))
            self.reset()
            self.table.add(old[kept])
            self.used, self.lengths, self.flat = np.ones(len(kept), np.int32), lengths, flat[ragged(starts, lengths)]
            self.starts = np.cumsum(lengths, dtype=np.int64) - lengths
        plain = self.is_plain(chunks)
        for mask, encode in ((plain, self.encode_plain), (~plain, self.encode_other)):
            ids, sizes = encode(chunks.take(np.flatnonzero(mask)))
            self.table.add(keys[mask])
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes]
            self.lengths, self.flat, self.used = np.r_[self.lengths, sizes], np.r_[self.flat, ids], np.r_[self.used, np.zeros(len(sizes), np.int32)]

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> textvec.Spans:
        if self.style == "word":
            return textvec.words(raw, offsets)
        edge = np.zeros(len(raw) + 1, bool)
        edge[:-1] = raw == 32
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        return textvec.Spans(cuts[:-1], cuts[1:], offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and the offsets of the texts in them."""
        return self.encode_terms(texts)[:2]

    def encode_terms(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Also the number of each chunk in the table, and the offsets of the texts in these (style word: all texts)."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        if self.style == "byte" and len(texts):
            whole = pc.match_substring_regex(texts, SPACE_AFTER_SPACE).to_numpy(zero_copy_only=False)
        raw, offsets = textvec.utf8(texts.filter(pa.array(~whole)) if whole.any() else texts)
        spans = self.spans(raw, offsets)
        keys = textvec.hashes(raw, spans.start, spans.end)
        numbers = self.table.find(keys)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            self.enter(new, Chunks.cut(raw, spans.start[at], spans.end[at]))
            numbers = self.table.find(keys)  # entering may have renewed the table
            if (numbers < 0).any():
                lost = np.flatnonzero(numbers < 0)
                new, first = np.unique(keys[lost], return_index=True)
                at = lost[first]
                self.max_chunks = max(self.max_chunks, 2 * (self.table.size + len(new)))
                self.enter(new, Chunks.cut(raw, spans.start[at], spans.end[at]))
                numbers = self.table.find(keys)
        self.used += np.minimum(np.bincount(numbers, minlength=len(self.used)), 1 << 20).astype(np.int32)
        np.minimum(self.used, 1 << 20, out=self.used)
        lengths = self.lengths[numbers]
        ids = self.flat[ragged(self.starts[numbers], lengths)]
        ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)][spans.first]
        if not whole.any():
            return ids, ends, numbers, spans.first
        slow = iter([np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind) for t in texts.filter(pa.array(whole)).to_pylist()])
        parts = iter(np.split(ids, ends[1:-1]) if len(ends) > 1 else [])
        ordered = [next(slow) if w else next(parts) for w in whole]
        return np.concatenate([np.zeros(0, self.kind), *ordered]), np.r_[0, np.cumsum([len(x) for x in ordered])].astype(np.int64), numbers, spans.first


_encoders: dict[tuple, ChunkEncoder] = {}


def worker_encoder(path: str, style: str) -> ChunkEncoder:
    """This worker process's encoder; its table serves all tasks that the worker runs."""
    if (path, style) not in _encoders:
        _encoders[path, style] = ChunkEncoder(path, style)
    return _encoders[path, style]
