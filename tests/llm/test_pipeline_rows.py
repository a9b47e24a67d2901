"""The pipeline's final rows against plain Python, stage by stage: each stage is worked out anew from what the one before gives."""

import collections
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_near_duplicates import similarity
from test_pii_brute import GIVEN, plain
from tokenizers import Tokenizer

from cosmolith.llm import mixing, pii, quality


def one_of_each(texts):
    """Ids that stay of {id: text}: the least of every class of texts alike, or with a similarity of 0.8, over all pairs."""
    words = {i: t.split() for i, t in texts.items()}
    head = {i: i for i in texts}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if find(i) != find(j) and (texts[i] == texts[j] or len(words[i]) > 4 and len(words[j]) > 4 and similarity(words[i], words[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return {i for i in ids if find(i) == i}


def test_final_rows(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    spark.conf.set(pii.KEY_SETTING, GIVEN)
    try:
        got = corpus_pipeline.run(spark, sf_dir).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    good = {r.doc_id for r in quality.op8_quality(spark, sf_dir).where("kept").collect()}  # verdicts: test_texts.py
    assert 0 < len(good) < len(docs)
    texts = {r.doc_id: r.text for r in docs if r.doc_id in good}
    stay = one_of_each(texts)
    assert len(stay) < len(texts)
    texts = {i: plain(texts[i])[0] for i in stay}
    assert any(texts[r.doc_id] != r.text for r in docs if r.doc_id in stay)
    source = {r.doc_id: r.source for r in docs}
    table = spark.createDataFrame([(i, t, source[i]) for i, t in texts.items()], "doc_id long, text string, source string")
    order = {r.doc_id: r.h for r in table.select("doc_id", F.expr(f"pmod(xxhash64(doc_id, text, {mixing.SEED}), {1 << 52})").alias("h")).collect()}
    size = {i: len(t.split()) for i, t in texts.items()}
    totals = collections.Counter()
    for i in texts:
        totals[source[i]] += size[i]
    goal, encode = mixing.targets(dict(totals)), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) <= set(texts)
    copies = {}
    for i, t in texts.items():
        ids = np.array([*encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids) for r in pieces[i])
        copies[i], rest = divmod(sum(r.length for r in pieces[i]), len(ids))
        assert rest == 0
        held = collections.Counter(p for r in pieces[i] for p in range(r.start, r.start + r.length))
        assert set(held.values()) <= {copies[i]} and len(held) == (len(ids) if copies[i] else 0)
    for s, total in totals.items():
        own = [i for i in texts if source[i] == s]
        want = int(goal[s] + 0.5)
        whole = min(want // total, 3)
        best = {0}
        for i in own:
            best |= {v + size[i] for v in best if v + size[i] <= want - whole * total}
        assert sum(copies[i] * size[i] for i in own) == whole * total + (max(best) if whole < 3 else 0)
        for n in {size[i] for i in own}:
            alike = sorted((i for i in own if size[i] == n), key=order.get)
            assert [copies[i] for i in alike] == sorted((copies[i] for i in alike), reverse=True)
    used = collections.defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():  # gapless, and full but for powers of two
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
