"""Token ids of whole texts by a public BPE vocabulary with word ends, each distinct piece encoded once for many texts.

The file's pipeline composes characters (NFC), lower-cases, and cuts at white space and between letters, digits and other
characters; BPE never crosses such a cut. So a text is cut at ASCII white space here, and words of ASCII and plain Latin
letters also where the pipeline would cut them, on the bytes of many texts at a time. Only pieces that a worker has not
met yet go to the `tokenizers` library; words with any other character or with a special token go to it as they are.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from cosmolith.llm.common import buffers, runs, word_hashes, words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
KNOWN = 1 << 18  # pieces that a worker remembers
LONG = 1 << 20  # bytes of text that are cut at a time
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 3, np.uint8)  # 0 gap, 1 letter, 2 digit, 3 other
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


def _odd(b: np.ndarray) -> np.ndarray:
    """Bytes that make a word odd: of characters beyond ASCII and the letters U+00C0 to U+023F, of times and division signs,
    of the dotted capital I, which lower-cases to two characters, and the start of a special token."""
    before, after = np.concatenate(([0], b[:-1])).astype(np.uint8), np.concatenate((b[1:], [0])).astype(np.uint8)
    lead = (b >= 0xC3) & (b <= 0xC8)
    tail = (before >= 0xC3) & (before <= 0xC8) & (b >= 0x80) & (b < 0xC0)
    sign = (before == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (before == 0xC4) & (b == 0xB0)
    return (b >= 0x80) & ~lead & ~tail | tail & sign | (b == 0x3C) & (after == 0x7C)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    size = last - first
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes to encode, first byte of each piece, its end, whether it is an odd word, pieces of each row)."""
    starts, ends, _ = words(buf, offsets)
    lo, hi = int(offsets[0]), int(offsets[-1])
    b = buf[lo:hi]
    low, starts, ends = _LOWER[b], starts - lo, ends - lo
    if not len(starts):
        none = np.zeros(0, np.int64)
        return low, none, none, none.astype(bool), np.zeros(len(offsets) - 1, np.int64)
    odd_word = np.zeros(len(starts), bool)
    odd_word[np.searchsorted(starts, np.flatnonzero(_odd(b)), "right") - 1] = True
    kind = _KIND[low]
    cut = (kind != np.concatenate(([0], kind[:-1]))) | (kind == 2)
    cut[starts] = True
    cut &= kind > 0
    word_end = np.zeros(len(b) + 1, bool)
    word_end[ends] = True
    mark = np.flatnonzero((low == 0x27) & cut)  # an apostrophe that begins a piece: 's 't 'm 'd, and 're 've 'll, are pieces
    at = np.concatenate((low, [0, 0, 0]))
    open_ = lambda n: ~np.any([word_end[np.minimum(mark + i, len(b))] for i in range(1, n + 1)], axis=0)
    one = open_(1) & np.isin(at[mark + 1], np.frombuffer(b"stmd", np.uint8))
    pair = at[mark + 1].astype(np.int64) << 8 | at[mark + 2]
    two = open_(2) & np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
    for here, n in ((mark[one], 1), (mark[two], 2)):
        cut[here + 1] = False
        after = here + n + 1
        after = after[after < len(b)]
        cut[after[kind[after] > 0]] = True
    inside = _spread(starts[odd_word], ends[odd_word])  # odd words are pieces as they are
    cut[inside] = False
    low[inside] = b[inside]
    cut[starts] = True
    first = np.flatnonzero(cut)
    word = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(b)), ends[word])
    return low, first, last, odd_word[word], np.diff(np.searchsorted(first, offsets - lo))


class WordEncoder:
    """Texts to ids by a vocabulary file; remembers up to KNOWN pieces."""

    def __init__(self, path: str | None = None) -> None:
        path = path or public_tokenizers.path(VOCABULARY)
        self.exact, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])  # for pieces that are cut and in lower case already
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.exact.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.slot: dict[int, int] = {}
        self.pool, self.at, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, low: np.ndarray, first: np.ndarray, last: np.ndarray, odd: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes pieces, one of each hash, and remembers them."""
        if len(self.slot) + len(first) > KNOWN:
            self.slot, self.pool, self.at, self.size = {}, self.pool[:0], self.at[:0], self.size[:0]
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, sizes = [], np.zeros(len(first), np.int64)
        if len(plain):
            size = last[plain] - first[plain] + 1  # each with a space behind it
            joined = np.full(int(size.sum()), 0x20, np.uint8)
            keep = np.ones(len(joined), bool)
            keep[np.cumsum(size) - 1] = False
            joined[keep] = low[_spread(first[plain], last[plain])]
            own = np.array(self.plain.encode_batch_fast([joined.tobytes().decode().lower()], add_special_tokens=False)[0].ids, self.kind)
            end = np.flatnonzero(self.ends[own])
            if len(end) != len(plain):
                raise ValueError("the vocabulary doesn't close each word by a token of its own")
            sizes[plain] = np.diff(end, prepend=-1)
            ids.append(own)
        texts = [low[first[i] : last[i]].tobytes().decode() for i in rest.tolist()]
        for found, i in zip(self.exact.encode_batch_fast(texts, add_special_tokens=False), rest.tolist(), strict=True):
            ids.append(np.array(found.ids, self.kind))
            sizes[i] = len(found.ids)
        order = np.concatenate((plain, rest))
        at = np.empty(len(first), np.int64)
        at[order] = len(self.pool) + np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
        n = len(self.at)
        self.pool, self.at, self.size = np.concatenate((self.pool, *ids)), np.concatenate((self.at, at)), np.concatenate((self.size, sizes))
        self.slot.update(zip(hashes.tolist(), range(n, n + len(at)), strict=True))

    def _encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids of each row), without end ids."""
        low, first, last, odd, counts = pieces(buf, offsets)
        if not len(first):
            return self.pool[:0], np.zeros(len(counts), np.int64)
        own, one, back = np.unique(word_hashes(low, first, last), return_index=True, return_inverse=True)
        new = np.flatnonzero([h not in self.slot for h in own.tolist()])
        if len(new):
            if len(self.slot) + len(new) > KNOWN:  # all is forgotten, so all pieces of these rows are new
                new = np.arange(len(own))
            self._learn(low, first[one[new]], last[one[new]], odd[one[new]], own[new])
        slot = np.array([self.slot[h] for h in own.tolist()], np.int64)[back]
        size = self.size[slot]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[_spread(self.at[slot], self.at[slot] + size)]
        return ids, np.diff(before[np.concatenate(([0], np.cumsum(counts)))])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a column, one after the other, each closed by the end id; ids of each text). Null is empty."""
        buf, offsets = buffers(column)
        cuts, row = [], []
        for i in np.flatnonzero(np.diff(offsets) > LONG):  # very long texts are cut at white space
            at = offsets[i] + LONG
            while at < offsets[i + 1]:
                gap = np.flatnonzero(_KIND[buf[at : min(at + LONG, offsets[i + 1])]] == 0)
                if len(gap):
                    cuts.append(at + gap[0])
                    row.append(i)
                    at += gap[0]
                at += LONG
        bounds = np.sort(np.concatenate((offsets, np.array(cuts, np.int64))), kind="stable")
        of = np.sort(np.concatenate((np.arange(len(offsets) - 1), np.array(row, np.int64))), kind="stable")
        ids, sizes = [], []
        for lo, hi in runs(bounds, LONG):
            own, n = self._encode(buf, bounds[lo : hi + 1])
            ids.append(own)
            sizes.append(n)
        n = np.bincount(of, np.concatenate(sizes) if sizes else np.zeros(0), minlength=len(offsets) - 1).astype(np.int64)
        out = np.full(int(n.sum()) + len(n), END_ID, self.kind)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(n + 1) - 1] = False
        out[keep] = np.concatenate(ids) if ids else out[:0]
        return out, n + 1


_ENCODERS: dict[str | None, WordEncoder] = {}


def word_encoder(path: str | None = None) -> WordEncoder:
    """One encoder for a worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
