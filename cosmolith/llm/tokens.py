"""Token ids of whole texts by a public byte-level BPE vocabulary.

The ids are those of the `tokenizers` file. For texts of Latin script they are made with the same merges' rank file,
which is four to six times as fast and was compared character by character (tests/llm); other texts go through
`tokenizers` itself, as the two libraries' tables of letters and digits are of different Unicode versions.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
END_ID = 1
_OTHER = re.compile("[^\x00-ɏ‐-†…€]")


class Encoder:
    """Texts to ids. folder has the vocabulary's .json and .tiktoken files."""

    def __init__(self, folder: str | None = None) -> None:
        at = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        self.exact = Tokenizer.from_file(at(f"{VOCABULARY}.json"))
        with open(at(f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _OTHER.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL_ID] * (k > 0) + self.fast.encode_ordinary(part)
        return out


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(folder: str | None = None) -> Encoder:
    """One encoder for a worker and vocabulary folder."""
    if folder not in _ENCODERS:
        _ENCODERS[folder] = Encoder(folder)
    return _ENCODERS[folder]


def document_ids(text: str | None, folder: str | None = None) -> np.ndarray:
    """A document's ids, closed by the end id."""
    return np.array([*encoder(folder).encode(text), END_ID], "<u4")
