"""Operator 5: words that repeat an earlier document, by fixed-block anchors.

Every document is cut into non-overlapping blocks of 7 words, its anchors; a window of 13 words always holds a whole
one. The index of anchors is probed with every rolling run of 7 words of every document. Where a probe meets an anchor,
the hit is extended to the windows of 13 words around it; those windows alone are compared over all documents, and a
maximal run of windows that an earlier document has too is a maximal exact repeat.

Texts are shuffled once (by document); all else that moves are packed hashes, 4 bytes for a probe, 11 for a candidate
window. No pairs of documents are formed, and what is alike within a chunk of about a million words is settled there and
sent once, so a passage that a third of all documents hold has one row a chunk in its bucket, not one a copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.llm.common import NO_ID, buckets_for, buffers, pack_gaps, runs, table, unpack_gaps, window_hashes, word_hashes, words

WINDOW = 13
CHUNK = 1 << 20  # words that are packed together
_PACKED = "bucket int, chunk long, kind int, a binary, b binary, c binary"


def block_words(window: int) -> int:
    """The longest block of which every window holds an aligned whole one."""
    return (window + 1) // 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("bucket", "chunk", "kind", "a", "b", "c")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


class _Chunk:
    """Documents whose word hashes are packed together; kind 0 rows carry the documents, kind 1 rows a bucket's hashes, kind
    2 rows places that the chunk knows to be hits."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.spans: list[bytes] = []
        self.size = 0

    def add(self, keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.size += len(hashes)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(self.keys), np.concatenate(self.hashes), np.concatenate(self.counts)


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[_Chunk]:
    now = _Chunk()
    for batch in batches:
        buf, offsets = buffers(batch.column("text"))
        keys = np.stack([batch.column("doc_key").to_numpy(zero_copy_only=False), batch.column("text_key").to_numpy(zero_copy_only=False)], 1)
        spans = batch.column("spans") if "spans" in batch.schema.names else None
        for lo, hi in runs(offsets):
            starts, ends, counts = words(buf, offsets[lo : hi + 1])
            use = counts >= window
            own = np.repeat(use, counts)
            now.add(keys[lo:hi][use], word_hashes(buf, starts, ends)[own], counts[use])
            if spans is not None:
                now.spans += [spans[lo + int(i)].as_py() for i in np.flatnonzero(use)]
            if now.size >= CHUNK:
                yield now
                now = _Chunk()
    if now.size:
        yield now


def _deal(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def _gap_kind(n: int) -> type:
    return np.uint8 if n <= 160 else np.uint16


def _alike(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, of): rows sorted by the keys (the last first), where each group of alike rows starts in that order,
    and the group of each sorted row. All keys but the last given ones only order rows within a group."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys[-2:] if len(keys) > 1 else keys:
        same &= k[order][1:] == k[order][:-1]
    new[1:] = ~same
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _probes(window: int, n: int):
    """Each run of block words: 32 bits of its hash, and of an anchor its place.

    A window of a document holds a whole anchor of that document, so an anchor's place is asked for, and other runs only
    tell that they are there. What a chunk holds more than once is settled in the chunk: its anchors are hits, and one
    of the runs is sent. So a passage of any number of copies has one row a chunk.
    """
    block = block_words(window)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, chunk in enumerate(_chunks(batches, window)):
            keys, hashes, counts = chunk.arrays()
            first = np.concatenate(([0], np.cumsum(counts)))
            at = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
            left = np.repeat(counts, counts) - at
            h = window_hashes(hashes, block, 0x2545F4914F6CDD1D)
            pos = np.flatnonzero(left[: len(h)] >= block)
            h, anchor = h[pos], at[pos] % block == 0
            order, start, of = _alike(h)
            often = np.zeros(len(h), bool)
            often[order] = np.diff(np.append(start, len(h)))[of] > 1
            one = np.zeros(len(h), bool)
            one[order[start]] = True
            code, bucket = h.astype(np.uint32), ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
            name = (part << 24) | k
            rows = [(name % n, name, 0, keys[:, 0].tobytes(), keys[:, 1].tobytes(), counts.astype(np.int32).tobytes())]
            if (sure := pos[anchor & often]).size:
                rows.append((name % n, name, 2, pack_gaps(sure), None, None))
            asked = anchor & ~often
            for b, i in _deal(np.where(one, bucket, n), n + 1):
                if b < n:
                    ask, told = i[asked[i]], i[~asked[i]]
                    rows.append((b, name, 1, code[ask].tobytes(), pack_gaps(pos[ask], _gap_kind(n)), code[told].tobytes()))
            yield _rows(rows)

    return pack


def _settled(rows: pd.DataFrame) -> list[tuple]:
    """The rows of a bucket that only pass through: chunks' documents, and the places that are known in their chunk."""
    return [(0, r.chunk, min(r.kind, 1), r.a, r.b, r.c) for r in rows[rows.kind != 1].itertuples(index=False)]


def _hits(n: int):
    """Of a bucket, the asked places whose hash is there more than once."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        out, own = _settled(rows), rows[rows.kind == 1]
        if len(own):
            every = np.concatenate([np.frombuffer(x, np.uint32) for c in ("a", "c") for x in own[c]])
            every.sort()
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            del every
            for name, raw, places in zip(own.chunk, own.a, own.b, strict=True):
                asked = np.frombuffer(raw, np.uint32)
                if len(asked) and len(twice):
                    at = unpack_gaps(places, _gap_kind(n))[twice[np.minimum(np.searchsorted(twice, asked), len(twice) - 1)] == asked]
                    if len(at):
                        out.append((0, name, 1, pack_gaps(at, np.uint8), None, None))
        return pd.DataFrame(out, columns=["bucket", "chunk", "kind", "a", "b", "c"])

    return match


def _spread(at: np.ndarray, before: int, after: int, most: int) -> np.ndarray:
    """Ranges [from, to) that hold every p - before .. p + after - 1 of the places at, within [0, most)."""
    edge = np.zeros(most + 1, np.int32)
    np.add.at(edge, np.maximum(at - before, 0), 1)
    np.add.at(edge, np.minimum(at + after, most), -1)
    on = np.concatenate(([0], (np.cumsum(edge)[:most] > 0).view(np.int8), [0]))
    change = np.flatnonzero(np.diff(on))
    return change.reshape(-1, 2).astype(np.int32)


def _by_document(window: int, extend: bool):
    """A chunk's places, dealt back to its documents as ranges: of candidate windows, or of words to remove."""
    block = block_words(window)

    def collect(rows: pd.DataFrame) -> pd.DataFrame:
        docs, out = rows[rows.kind == 0], []
        places = [unpack_gaps(x) for x in rows[rows.kind == 1].a]
        if len(docs) and places:
            head = docs.iloc[0]
            at = np.sort(np.concatenate(places))
            doc, text, counts = np.frombuffer(head.a, np.int64), np.frombuffer(head.b, np.int64), np.frombuffer(head.c, np.int32).astype(np.int64)
            first = np.concatenate(([0], np.cumsum(counts)))
            of = np.searchsorted(first, at, "right") - 1
            edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                d, own = of[lo], at[lo:hi] - first[of[lo]]
                # a window from i holds the block at p if p - (window - block) <= i <= p
                span = _spread(own, window - block, 1, int(counts[d]) - window + 1) if extend else _spread(own, 0, window, int(counts[d]))
                if len(span):
                    out.append((doc[d], text[d], span.tobytes()))
        return pd.DataFrame(out, columns=["doc_key", "text_key", "spans"])

    return collect


def _windows(window: int, n: int):
    """The candidate windows: 80 bits of hash, their place, and their document's key.

    Of the windows alike in a chunk those of its smallest document are sent; the others are known to repeat it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, chunk in enumerate(_chunks(batches, window)):
            keys, hashes, counts = chunk.arrays()
            first = np.concatenate(([0], np.cumsum(counts)))
            on = np.zeros(len(hashes) + 1, np.int8)
            for f, raw in zip(first, chunk.spans, strict=False):
                span = np.frombuffer(raw, np.int32).reshape(-1, 2) + f
                on[span[:, 0]] += 1
                on[span[:, 1]] -= 1
            pos = np.flatnonzero(np.cumsum(on, dtype=np.int8)[:-1])
            h = window_hashes(hashes, window, 0xD6E8FEB86659FD93)[pos]
            more = window_hashes(hashes, window, 0xA0761D6478BD642F)[pos]
            doc = np.repeat(np.arange(len(counts)), counts)[pos]
            bucket, more = ((more >> np.uint64(16)) % np.uint64(n)).astype(np.int32), (more & np.uint64(0xFFFF)).astype(np.uint16)
            key = keys[doc, 0]
            order, start, of = _alike(key, more, h)
            sure = np.zeros(len(h), bool)
            sure[order] = key[order] > key[order[start]][of] if len(h) else False
            name = (part << 24) | k
            rows = [(name % n, name, 0, keys[:, 0].tobytes(), keys[:, 1].tobytes(), counts.astype(np.int32).tobytes())]
            if sure.any():
                rows.append((name % n, name, 2, pack_gaps(pos[sure]), None, None))
            for b, i in _deal(np.where(sure, n, bucket), n + 1):
                if b == n:
                    continue
                head = np.flatnonzero(np.concatenate(([True], doc[i][1:] != doc[i][:-1])))
                ids = keys[doc[i][head], 0].astype(np.int64)
                rows.append((b, name, 1, h[i].tobytes() + more[i].tobytes(), pack_gaps(pos[i], np.uint8), ids.tobytes() + np.diff(np.append(head, len(i))).astype(np.uint32).tobytes()))
            yield _rows(rows)

    return pack


def _repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket, the windows that also start in a document with a smaller key."""
    out, own = _settled(rows), rows[rows.kind == 1]
    if len(own):
        sizes = [len(x) // 10 for x in own.a]
        h = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(own.a, sizes, strict=True)])
        more = np.concatenate([np.frombuffer(x, np.uint16, n, 8 * n) for x, n in zip(own.a, sizes, strict=True)])
        docs = np.concatenate([np.repeat(np.frombuffer(x, np.int64, len(x) // 12), np.frombuffer(x, np.uint32, len(x) // 12, 8 * (len(x) // 12))) for x in own.c])
        order = np.lexsort((docs, more, h))
        h, more, docs = h[order], more[order], docs[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])))
        least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = np.zeros(len(h), bool)
        hit[order[docs > least]] = True
        to = 0
        for name, raw, n in zip(own.chunk, own.b, sizes, strict=True):
            at = unpack_gaps(raw)[hit[to : to + n]]
            to += n
            if len(at):
                out.append((0, name, 1, pack_gaps(at), None, None))
    return pd.DataFrame(out, columns=["bucket", "chunk", "kind", "a", "b", "c"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans")
    for batch in batches:
        out = []
        for doc, text, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            tokens = (text or "").encode().split()
            n, spans = len(tokens), []
            if raw:
                spans = np.frombuffer(raw, np.int32).reshape(-1, 2).tolist()
                kept, at = [], 0
                for lo, hi in spans:
                    kept += tokens[at:lo]
                    at = hi
                tokens = kept + tokens[at:]
            out.append((doc, n, n - len(tokens), hashlib.sha256(b" ".join(tokens)).hexdigest(), spans))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has doc_key, text_key, doc_id, text of every row; spans the word ranges to remove, by key."""
    n = buckets_for(docs)
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_key"), F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    by_key, span = ["doc_key", "text_key"], "doc_key long, text_key long, spans binary"
    packed = texts.select("doc_key", "text_key", "text").mapInArrow(_probes(window, n), _PACKED)
    hits = packed.groupBy("bucket").applyInPandas(_hits(n), _PACKED)
    near = hits.groupBy("chunk").applyInPandas(_by_document(window, True), span).dropDuplicates(by_key)
    # doc_id is not needed here, but with it this exchange of the texts is the same as the last one, and is reused.
    found = texts.join(near, by_key).select("doc_key", "text_key", "doc_id", "text", "spans").mapInArrow(_windows(window, n), _PACKED)
    again = found.groupBy("bucket").applyInPandas(_repeats, _PACKED)
    return texts, again.groupBy("chunk").applyInPandas(_by_document(window, False), span).dropDuplicates(by_key)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_words, n_removed, kept_sha256, removed_spans.

    removed_spans lists the removed maximal repeats as [first word, past the last word). Null texts have no words, so
    digest the empty string. A null doc_id counts as larger than every other and never as smaller than another null.
    Rows that share a doc_id are one document's parts: none removes words from another. Repeated rows give repeated
    results, an empty table an empty one; other columns are ignored. Texts under 13 words keep everything.
    """
    texts, spans = repeated_spans(docs, window)
    return texts.join(spans, ["doc_key", "text_key"], "left").select("doc_id", "text", "spans").mapInArrow(
        _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<array<int>>"
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
