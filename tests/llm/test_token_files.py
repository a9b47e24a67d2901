"""Operator 12: the encoder against the tokenizers library, the block format by round trips, whole files read back."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cosmolith.llm import word_tokens
from cosmolith.llm.token_files import BLOCK, digests, pack_blocks, places, read_token_files, unpack_blocks, write_token_files


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def agree(exact, texts, encoder=None):
    ids, counts = (encoder or word_tokens.word_encoder()).encode(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == exact(text), repr(text)
        at += n
    assert at == len(ids)


def test_encoder_by_character(exact):
    agree(exact, [s for c in map(chr, range(1, 0x260)) for s in (c, f"a{c}b", f"1{c}'s {c}")] + [None, ""])


def test_encoder_on_mixed_texts(exact):
    rng, letters = random.Random(1), "aAsStTrReEvVlLmMdD''''  \n\t0129!?.<|>éÉßÿŸİ×ŉſΣσς中́\xa0\x85 \x1c²½"
    agree(exact, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(8000)])
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "'ll", "re", " ", "x", "'", "!", "7", "\n"]
    agree(exact, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)])


def test_encoder_cuts_long_texts_and_forgets(exact, monkeypatch):
    monkeypatch.setattr(word_tokens, "LONG", 64)
    monkeypatch.setattr(word_tokens, "KNOWN", 50)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé 7'!\n") for _ in range(rng.randint(0, 900))) for _ in range(80)] + ["x" * 500]
    agree(exact, texts, word_tokens.WordEncoder())


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, 5 * BLOCK + 3])
def test_blocks(n):
    rng = np.random.default_rng(n)
    top = (1 << 32) - 1
    for ids in (rng.integers(0, 50_000, n), np.full(n, 9), rng.integers(0, top, n, endpoint=True), np.where(rng.random(n) < 0.04, top, rng.integers(3, 9, n))):
        raw, size = pack_blocks(ids.astype(np.uint32))
        assert unpack_blocks(raw, np.cumsum(size) - size)[:n].tolist() == ids.tolist()
    if n > BLOCK:  # rare large ids go to exception lists and don't widen the block
        assert len(raw) < n


def test_places():
    rng = random.Random(4)
    keys = [(rng.random() < 0.3, rng.choice([-5, 0, 3, 9]), rng.randint(-4, 4)) for _ in range(300)]
    keys = [(a, 0 if a else b, c) for a, b, c in keys]
    for n in (0, 1, 7, 40):
        bounds = sorted(set(rng.sample(keys, n)))
        want = [max(0, sum(b <= k for b in bounds) - 1) for k in keys]
        assert places(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([k[2] for k in keys]), bounds).tolist() == want


def rows_of(spark, docs, path, files):
    write_token_files(docs, path, files=files)
    return digests(read_token_files(spark, path)).collect()


@pytest.mark.parametrize("files", [1, 5])
def test_files(spark, exact, cluttered, prose, tmp_path, files):
    got = rows_of(spark, cluttered, f"file://{tmp_path}/ids", files)
    assert sorted(r.start for r in got) == [r.start for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start))]  # ascending, null last
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = lambda text: np.array(exact(text), "<u4").tobytes()
    want = sorted(((-1 if i is None else i), len(ids(t)) // 4, zlib.crc32(ids(t))) for i, t, _, _ in prose)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    with pytest.raises(Exception, match="token files"):
        write_token_files(cluttered, f"file://{tmp_path}/ids", files=1)
    assert digests(read_token_files(spark, f"file://{tmp_path}/ids")).count() == len(got)


def test_no_documents(spark, nothing, tmp_path):
    assert rows_of(spark, nothing, f"file://{tmp_path}/ids", None) == []


def test_ids_are_whole(spark, exact, docs, tmp_path):
    write_token_files(docs, f"file://{tmp_path}/ids")
    got = read_token_files(spark, f"file://{tmp_path}/ids").where("doc_id = 500").collect()
    assert got[0].ids == exact(docs.where("doc_id = 500").first().text)
