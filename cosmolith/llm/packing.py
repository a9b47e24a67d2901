"""Operator 6: hierarchical multi-length packing of token sequences.

A document's ids are cut into whole windows of 2048 and a rest. The rest is routed to the shortest tier (256, 512, 1024
or 2048 ids) that holds it. Long windows are packed first: each takes a rest of its own tier and fills its gap with the
longest rests of shorter tiers that fit, and last with the head of a longer one, so it is exactly full; then the next
tier. What is left at a task's end is cut at powers of two, so no sequence needs padding. Sequences of a tier form step
groups of equal numbers of ids.

Each task packs what it reads: there is no shuffle, and a task holds one group of about a million ids at a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cosmolith.llm.common import table
from cosmolith.llm.tokens import document_ids

TIERS = (256, 512, 1024, 2048)
GROUP = 1 << 20
STEP = 16  # windows of the longest tier in a step group
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


def plan_group(rests: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """(windows, left): windows are (tier, pieces), pieces (document, start in its rest, length); left what filled none.

    rests[d] is the length of document d's rest. Every window is exactly full.
    """
    shelf: list[tuple[int, int, int]] = sorted((n, d, 0) for d, n in enumerate(rests) if n)  # (length, document, start)
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    total = sum(n for n, _, _ in shelf)
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while total >= tier and shelf and (shelf[-1][0] > below or k == 0):
            pieces, gap = [], tier
            while gap:
                at = bisect_right(shelf, (gap, 1 << 60, 0)) - 1
                if at >= 0 and (shelf[at][0] == gap or pieces or shelf[at][0] > below or k == 0) and (shelf[at][0] * 2 > gap or at == len(shelf) - 1):
                    n, d, s = shelf.pop(at)
                else:  # nothing fills half the gap: the head of the shortest longer rest closes it
                    n, d, s = shelf.pop(at + 1)
                    insort(shelf, (n - gap, d, s + gap))
                    n = gap
                pieces.append((d, s, n))
                gap -= n
            windows.append((tier, pieces))
            total -= tier
    return windows, [(d, s, n) for n, d, s in shelf]


def close_left(left: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences of falling powers of two that hold exactly what is left."""
    total, out, at, used = sum(n for _, _, n in left), [], 0, 0
    for k in range(total.bit_length() - 1, -1, -1):
        if total >> k & 1:
            pieces, gap = [], 1 << k
            while gap:
                d, s, n = left[at]
                take = min(gap, n - used)
                pieces.append((d, s + used, take))
                gap, used = gap - take, used + take
                if used == n:
                    at, used = at + 1, 0
            out.append((1 << k, pieces))
    return out


class _Packer:
    def __init__(self, folder: str | None, tiers: tuple[int, ...]) -> None:
        self.folder, self.tiers, self.longest = folder, tiers, tiers[-1]
        self.next, self.filled = TaskContext.get().partitionId() << 36, dict.fromkeys(tiers, 0)
        self.part = TaskContext.get().partitionId()
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, rest, where the rest starts
        self.tokens: list[int] = []
        self.size, self.rows = 0, []

    def _emit(self, tier: int, pieces: list[tuple[int | None, np.ndarray, int, int]]) -> None:
        own = min((t for t in self.tiers if t >= tier), default=self.longest)
        step = (self.part << 36) + (self.tiers.index(own) << 32) + self.filled[own] // (STEP * self.longest)
        self.filled[own] += tier
        offset = 0
        for doc, ids, start, n in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next, offset, own, step))
            offset += len(ids)
        self.next += 1

    def add(self, doc: int | None, text: str | None) -> None:
        ids = document_ids(text, self.folder)
        whole = len(ids) // self.longest * self.longest
        for s in range(0, whole, self.longest):
            self._emit(self.longest, [(doc, ids[s : s + self.longest], s, len(ids))])
        if whole < len(ids):
            self.docs.append((doc, ids[whole:].copy(), whole))
            self.tokens.append(len(ids))
            self.size += len(ids) - whole

    def pack(self, last: bool) -> None:
        cut = lambda d, s, n: (self.docs[d][0], self.docs[d][1][s : s + n], self.docs[d][2] + s, self.tokens[d])
        windows, left = plan_group([len(x[1]) for x in self.docs], self.tiers)
        for tier, pieces in windows + (close_left(left) if last else []):
            self._emit(tier, [cut(*p) for p in pieces])
        left = [] if last else left
        self.docs, self.tokens = [(self.docs[d][0], self.docs[d][1][s : s + n], self.docs[d][2] + s) for d, s, n in left], [self.tokens[d] for d, _, _ in left]
        self.size = sum(n for _, _, n in left)

    def batches(self) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 7 + (pa.int32(), pa.int64())
        for lo in range(0, len(self.rows), 50_000):
            rows = self.rows[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])
        self.rows = []


def pack(docs: DataFrame, folder: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece of docs(doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id.

    tiers are powers of two. folder holds the vocabulary (default: the installed public one). A null or empty text is
    its end id alone. Null doc_ids stay null; repeated rows are packed each; other columns are ignored; an empty table
    gives no pieces. sequence_id and step_id are unique over all tasks; within a sequence offsets run from 0 gaplessly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(folder, tiers)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                packer.add(doc.as_py(), text.as_py())
                if packer.size >= GROUP:
                    packer.pack(False)
                    yield from packer.batches()
        packer.pack(True)
        yield from packer.batches()

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of pack(): null and empty texts are their end id alone, long ones are cut, repeated rows are packed each, an
    empty table gives no pieces, and no column but doc_id and text is read."""
    return pack(docs)
