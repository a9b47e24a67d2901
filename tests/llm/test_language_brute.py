"""The mixture of each document against plain EM over all sets of the likeliest languages, a document at a time."""

import numpy as np

from cosmolith.llm import language


def likelihoods(text, model):
    out = []
    for w in (text or "").encode().split():
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        padded = b" " + w + b" "
        grams = [((padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]) * 2654435761 % (1 << 32)) >> 16 for i in range(len(w))]
        out.append(model[:, grams].sum(axis=1, dtype=np.float64))
    return np.array(out)


def em(like, share):
    for _ in range(1000):
        r = like * share
        new = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        if np.abs(new - share).max() <= language.TOLERANCE:
            return new
        share = new
    return share


def plain(text, model):
    logs = likelihoods(text, model)
    top = logs.max(axis=1, keepdims=True)
    like, n, k = np.exp(logs - top), len(logs), len(model)
    first = em(like, np.full(k, 1 / k))
    order = np.argsort(-first, kind="stable")
    best, score = np.eye(k)[logs.sum(axis=0).argmax()], logs.sum(axis=0).max()
    for size in range(2, k + 1):
        start = np.zeros(k)
        start[order[:size]] = first[order[:size]] + 1e-3
        share = em(like, start / start.sum())
        ll = np.log((like * share).sum(axis=1) + 1e-30).sum() + top.sum() - (size - 1) * np.log(n + 1)
        if ll <= score:
            break
        best, score = share, ll
    return best


def test_shares_against_plain_em(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, model = language.train(d)
    texts = [r.text for r in d.orderBy("doc_id").limit(60).collect() if r.text]
    by = {}
    for r in d.where("lang is not null and length(text) > 600").collect():
        by.setdefault(r.lang, r.text[50:550])
    texts += [" ".join(by.values()), " ".join(list(by.values())[:3])]
    assert len(by) == len(names) == 4
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: {x.lang: x.share for x in r.languages} for r in language.predict(rows, ["doc_id"], names, model).collect()}
    for i, t in enumerate(texts):
        want = plain(t, model)
        assert np.allclose([got[i].get(x, 0) for x in names], want, atol=0.01), i
    assert set(got[len(texts) - 2]) == set(names) and len(got[len(texts) - 1]) == 3  # sets of four and of three are found
