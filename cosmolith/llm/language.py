"""Operator 2: the languages a document mixes, by expectation-maximisation over n-gram likelihoods.

Training counts hashed byte trigrams of all training texts for each language. A document's words are the items of a
mixture: a word's likelihood in a language is the product over its trigrams, and EM estimates the document's language
proportions, to a tolerance. The set of languages grows from the likeliest one by the next likeliest while a penalised
likelihood (BIC) rises. Texts are worked on as byte buffers, thousands of documents at a time. Trigrams are counted sparsely
in each task and summed by Spark; the model is languages x 65536 numbers, and more languages than MOST are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.llm.common import buffers, delete, runs, table, words, written

BUCKETS = 1 << 16
ROUNDS, TOLERANCE = 100, 1e-3  # of EM: at most so many rounds, until no share moves by more
MOST = 2000  # languages; a model of 1 GB on the driver and 0.5 GB in a worker
CELLS = 16 << 20  # bytes of text times languages that are worked on at a time (a longer text is a turn of its own)
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first trigram of each word, words of each row): a word's bytes between two spaces, three at a time."""
    starts, ends, counts = words(buf, offsets)
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    total = int(size.sum())
    at = np.repeat(starts - first, size) + np.arange(total)  # where each middle byte stands
    low = _LOWER[buf[at]].astype(np.uint32) if total else np.zeros(0, np.uint32)
    before, after = np.concatenate(([32], low[:-1])).astype(np.uint32)[:total], np.concatenate((low[1:], [32])).astype(np.uint32)[:total]
    before[first], after[first + size - 1] = 32, 32
    code = (before << np.uint32(16)) | (low << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), first, counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        buf, offsets = buffers(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lo, hi in runs(offsets):
            grams, first, counts = trigrams(buf, offsets[lo : hi + 1])
            names = sorted(set(langs[lo:hi]))
            code = np.array([names.index(x) for x in langs[lo:hi]])
            word_lang = np.repeat(code, counts)
            gram_lang = np.repeat(word_lang, np.diff(np.append(first, len(grams))))
            both = np.bincount(gram_lang * BUCKETS + grams, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, row in zip(names, both, strict=True):
                sums[name] = sums.get(name, 0) + row
    for name, v in sums.items():
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket in each) from labelled(text, lang), over all its rows.

    Rows with a null text or language teach nothing. Without any such row there are no languages, and every prediction
    is `und`.
    """
    taught = labelled.where("lang is not null and text is not null").select("lang", "text")
    counted = taught.mapInArrow(_count, "lang string, bucket int, n long")
    packed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))
    model, at = written(packed.select("lang", F.col("cells.bucket").alias("bucket"), F.col("cells.n").alias("n")), "model")
    if (k := model.count()) > MOST:
        raise ValueError(f"{k} languages are more than a model holds; map rare ones to a common name first")
    names, n = [], np.zeros((k, BUCKETS))
    for i, r in enumerate(model.orderBy("lang").toLocalIterator()):  # languages x 65536 cells at most
        names.append(r.lang)
        n[i, r.bucket] = r.n
    delete(labelled.sparkSession, at)
    smooth = n + 0.5
    return names, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, share: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihoods) of documents whose words have the likelihoods `like`, from the shares given. Documents
    that have settled are left alone."""
    share, on = share.copy(), np.arange(len(share))
    words, starts, n, own = np.arange(len(like)), first, counts, like
    for _ in range(ROUNDS):
        mixed = own * np.repeat(share[on], n, axis=0)
        mixed /= mixed.sum(axis=1, keepdims=True) + 1e-30
        new = np.add.reduceat(mixed, starts, axis=0) / n[:, None].astype(np.float32)
        moves = np.abs(new - share[on]).max(axis=1) > TOLERANCE
        share[on] = new
        if not moves.any():
            break
        if not moves.all():
            words = words[np.repeat(moves, n)]
            on, n = on[moves], n[moves]
            own, starts = like[words], np.concatenate(([0], np.cumsum(n)))[:-1]
    each = np.log((like * np.repeat(share, counts, axis=0)).sum(axis=1) + 1e-30)
    return share, np.add.reduceat(each, first)


def infer(buf: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Language shares of each row; zeros for a row without words."""
    grams, first_gram, counts = trigrams(buf, offsets)
    out = np.zeros((len(counts), len(model)), np.float32)
    use = np.flatnonzero(counts)
    if not len(use) or not len(model):
        return out
    logs = np.stack([np.add.reduceat(row[grams], first_gram) for row in model], axis=1)
    n = counts[use]
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    sums = np.add.reduceat(logs, first, axis=0)  # log-likelihood of each language alone
    top = logs.max(axis=1, keepdims=True)
    like, floor = np.exp(logs - top), np.add.reduceat(top[:, 0], first)
    k = len(model)
    share, _ = _em(like, np.full((len(n), k), 1 / k, np.float32), first, n)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    best[np.arange(len(n)), sums.argmax(axis=1)] = 1
    score, on = sums.max(axis=1), np.arange(len(n))
    for size in range(2, k + 1):  # documents whose score rose try the next larger set
        words = np.flatnonzero(np.repeat(np.isin(np.arange(len(n)), on), n))
        own, starts = n[on], np.concatenate(([0], np.cumsum(n[on])))[:-1]
        start, rows = np.zeros((len(on), k), np.float32), np.arange(len(on))[:, None]
        start[rows, order[on, :size]] = share[on[:, None], order[on, :size]] + 1e-3
        start /= start.sum(axis=1, keepdims=True)
        found, ll = _em(like[words], start, starts, own)
        ll = ll + floor[on] - (size - 1) * np.log(own + 1)
        better = ll > score[on]
        on, found = on[better], found[better]
        if not len(on):
            break
        best[on], score[on] = found, ll[better]
    out[use] = best
    return out


def predict(docs: DataFrame, keep: list[str], names: list[str], model: np.ndarray) -> DataFrame:
    """`keep` with lang_pred, score and languages (the chosen set with its proportions) from the texts alone.

    A null text, or one without a letter, is `und` with score 0 and no languages. Columns in `keep` that clash with
    these are replaced.
    """
    keep = [c for c in keep if c not in {"lang_pred", "score", "languages", "text", "_letter"}]
    given = docs.select(*keep, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = ", ".join(f"`{n}` {t}" for n, t in given.dtypes if n not in ("text", "_letter"))
    shared = docs.sparkSession.sparkContext.broadcast((names, model))  # languages x 256 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in batches:
            buf, offsets = buffers(batch.column("text"))
            parts = [infer(buf, offsets[lo : hi + 1], model) for lo, hi in runs(offsets, CELLS // max(1, len(model)))]
            share = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.float32)
            letter = batch.column("_letter").to_numpy(zero_copy_only=False) & (share.sum(axis=1) > 0)
            at = share.argmax(axis=1) if len(names) else np.zeros(len(share), int)
            pred = [names[i] if ok else UNKNOWN for i, ok in zip(at, letter, strict=True)]
            score = [min(1.0, float(s[i])) if ok else 0.0 for s, i, ok in zip(share, at, letter, strict=True)]
            sets = [[(names[j], float(s[j])) for j in np.flatnonzero(s > 0)] if ok else [] for s, ok in zip(share, letter, strict=True)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            sets = pa.array([[{"lang": a, "share": b} for a, b in x] for x in sets], kind)
            rest = [i for i, n in enumerate(batch.schema.names) if n not in ("text", "_letter")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(pred, pa.string()), pa.array(score, pa.float64()), sets], [*(batch.schema.names[i] for i in rest), "lang_pred", "score", "languages"]
            )

    lead = schema + ", " if schema else ""
    return given.mapInArrow(run, lead + "lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose crc32(doc_id) is divisible by 5, and those without an id, teach nothing: they are held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), ["doc_id", "held_out"], names, model).select("doc_id", "held_out", "lang_pred", "score", "languages")
