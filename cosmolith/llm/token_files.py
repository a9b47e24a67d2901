"""Operator 12: token ids in files of patched frame-of-reference blocks, written and read as a Spark data source.

A block holds BLOCK ids: their minimum, and each id less that minimum in as many bits as PERCENT of the block's ids need;
ids that need more leave their low bits there, and their place and high bits go to the block's exception list. A file is

    magic | blocks | first byte of each block | doc_ids, whether null, ids of each document | blocks, documents, ids, magic

so any document is read through the index without what stands before it. A block is: minimum (4 bytes), width (1),
exceptions (2), packed ids (BLOCK * width bits), places (1 byte each), high bits (4 bytes each); the last block is filled
up with its minimum. Numbers are little-endian.

Each task writes a file under a name of its own; the commit names the files of successful tasks, in order, in one manifest
and removes what lost tasks have left. A reader takes one file a task, and decodes about a million ids at a time.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cosmolith.llm.common import buckets_for, delete, new_path, table, written
from cosmolith.llm.word_tokens import word_encoder

BLOCK, PERCENT = 256, 90
MAGIC = b"PFORIDS1"
HEAD = 7  # bytes of a block before its packed ids
FLUSH = 1 << 20  # ids that are packed or unpacked at a time
MANIFEST = "_manifest.json"
FORMAT = "patched_token_ids"
_TAIL = struct.Struct("<qqq8s")
_SCHEMA = "doc_id long, start long, ids array<int>"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each block) of ids; the last block is filled up with its minimum."""
    n = -(-len(ids) // BLOCK)
    v = np.empty(n * BLOCK, np.uint32)
    v[: len(ids)] = ids
    if len(ids) % BLOCK:
        v[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    v = v.reshape(n, BLOCK)
    least = v.min(1)
    v = v - least[:, None]
    need = _bits(v)
    at = -(-BLOCK * percent // 100) - 1
    width = np.partition(need, at, axis=1)[:, at] if n else np.zeros(0, np.uint8)
    block, place = np.nonzero(need > width[:, None])
    extra = np.bincount(block, minlength=n)
    size = HEAD + BLOCK // 8 * width.astype(np.int64) + 5 * extra
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.empty((n, HEAD), np.uint8)
    head[:, :4], head[:, 4], head[:, 5:] = least.astype("<u4")[:, None].view(np.uint8), width, extra.astype("<u2")[:, None].view(np.uint8)
    out[start[:, None] + np.arange(HEAD)] = head
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = (v[own][:, :, None] >> np.arange(w, dtype=np.uint32) & 1).astype(np.uint8).reshape(len(own), BLOCK * w)
        out[start[own][:, None] + HEAD + np.arange(BLOCK // 8 * w)] = np.packbits(bits, axis=1, bitorder="little")
    nth = np.arange(len(block)) - (np.cumsum(extra) - extra)[block]
    lists = (start + HEAD + BLOCK // 8 * width.astype(np.int64))[block]
    out[lists + nth] = place
    high = (v[block, place] >> width[block].astype(np.uint32)).astype("<u4")
    out[(lists + extra[block] + 4 * nth)[:, None] + np.arange(4)] = high[:, None].view(np.uint8)
    return out, size


def unpack_blocks(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at the given bytes of raw, BLOCK for each."""
    head = raw[start[:, None] + np.arange(HEAD)]
    least, width, extra = head[:, :4].copy().view("<u4")[:, 0], head[:, 4].astype(np.int64), head[:, 5:].copy().view("<u2")[:, 0].astype(np.int64)
    v = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(raw[start[own][:, None] + HEAD + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        x = np.zeros((len(own), BLOCK), np.uint32)
        for k in range(w):
            x |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        v[own] = x
    block = np.repeat(np.arange(len(start)), extra)
    nth = np.arange(len(block)) - (np.cumsum(extra) - extra)[block]
    lists = (start + HEAD + BLOCK // 8 * width)[block]
    high = raw[(lists + extra[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(block) else np.zeros(0, np.uint32)
    v[block, raw[lists + nth]] |= high << width[block].astype(np.uint32)
    return (v + least[:, None]).ravel()


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Wrote(WriterCommitMessage):
    part: int
    file: str
    docs: int
    ids: int


class _File:
    """A file that is being written: whole blocks leave as they fill, the index stays until the end."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.left, self.held = out, [], 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out.write(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), np.asarray(doc_ids.is_null()).astype(np.uint8), counts.astype("<i8")))
        self.left.append(ids)
        self.held += len(ids)
        if self.held >= FLUSH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, FLUSH):
            raw, size = pack_blocks(ids[at : min(at + FLUSH, whole)])
            self.out.write(raw.tobytes())
            self.sizes.append(size)
        self.left, self.held = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self._flush(True)
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        starts = len(MAGIC) + np.cumsum(sizes) - sizes
        keys, none, counts = (np.concatenate(x) for x in zip(*self.docs, strict=True)) if self.docs else (np.zeros(0, "<i8"), np.zeros(0, np.uint8), np.zeros(0, "<i8"))
        for x in (starts.astype("<i8"), keys, none, counts):
            self.out.write(x.tobytes())
        self.out.write(_TAIL.pack(len(starts), len(counts), int(counts.sum()), MAGIC))
        self.out.close()
        return len(counts), int(counts.sum())


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, at = _at(self.path)
        fs.create_dir(at, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        file = _File(fs.open_output_stream(f"{at}/{name}"))
        for batch in iterator:
            ids = batch.column("ids")
            if not len(ids):
                continue
            raw, counts = ids.cast(pa.large_binary()), batch.column("n").to_numpy().astype(np.int64)
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            file.add(batch.column("doc_id"), data.view(f"<u{len(data) // int(counts.sum())}").astype(np.uint32), counts)
        return _Wrote(part, name, *file.close())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _at(self.path)
        fs.create_dir(at, recursive=True)
        if not self.overwrite and fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds token files; mode overwrite replaces them")
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        with fs.open_output_stream(f"{at}/.{MANIFEST}") as out:
            out.write(json.dumps({"files": [[m.file, m.docs, m.ids] for m in parts]}).encode())
        fs.move(f"{at}/.{MANIFEST}", f"{at}/{MANIFEST}")
        named = {m.file for m in parts}
        for x in fs.get_file_info(pafs.FileSelector(at)):
            if x.base_name.endswith(".ids") and x.base_name not in named:
                fs.delete_file(x.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, at = _at(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(f"{at}/{m.file}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{at}/{m.file}")


@dataclass
class _Part(InputPartition):
    file: str
    before: int  # ids of the files before


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, at = _at(self.path)
        with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        out, before = [], 0
        for name, _, ids in files:
            out.append(_Part(name, before))
            before += ids
        return out or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, at = _at(self.path)
        with fs.open_input_file(f"{at}/{partition.file}") as f:
            f.seek(f.size() - _TAIL.size)
            n_blocks, n_docs, n_ids, magic = _TAIL.unpack(f.read(_TAIL.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.file} is no whole token file")
            index = f.size() - _TAIL.size - 8 * n_blocks - 17 * n_docs
            f.seek(index)
            take = lambda kind, n: np.frombuffer(f.read(np.dtype(kind).itemsize * n), kind)
            blocks, keys, none, counts = np.append(take("<i8", n_blocks), index), take("<i8", n_docs), take(np.uint8, n_docs), take("<i8", n_docs)
            ends = np.cumsum(counts)
            lo = 0
            while lo < n_docs:
                first = int(ends[lo] - counts[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, first + FLUSH, "right")))
                last = int(ends[hi - 1])
                a, b = first // BLOCK, -(-last // BLOCK)
                ids = np.empty(last - first, np.int32)
                for k in range(a, b, FLUSH // BLOCK):
                    to = min(b, k + FLUSH // BLOCK)
                    f.seek(int(blocks[k]))
                    got = unpack_blocks(np.frombuffer(f.read(int(blocks[to] - blocks[k])), np.uint8), blocks[k:to] - blocks[k])
                    s, e = max(first, k * BLOCK), min(last, to * BLOCK)
                    ids[s - first : e - first] = got[s - k * BLOCK : e - k * BLOCK].astype(np.int32)
                offsets = np.concatenate(([0], ends[lo:hi] - first)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[lo:hi], pa.int64(), mask=none[lo:hi].astype(bool)), pa.array(partition.before + ends[lo:hi] - counts[lo:hi]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    ["doc_id", "start", "ids"],
                )
                lo = hi


class TokenFiles(DataSource):
    """`df.write.format("patched_token_ids")` takes doc_id, n and ids (binary, 2 or 4 bytes for each of n > 0 ids); reading gives doc_id, start, ids."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def _order(docs: DataFrame) -> list:
    """The total order of documents: ids ascending, null last, then a hash of the text."""
    return [docs.doc_id.isNull().alias("none"), docs.doc_id.cast("long").alias("doc_id"), F.xxhash64(docs.text).alias("tie")]


def _bounds(docs: DataFrame, files: int) -> list[tuple[bool, int, int]]:
    """Where each file starts: the least (null, id, tie) of each range. One row a file comes to the driver."""
    keys, at = written(docs.select(*_order(docs)), "keys")
    ranges = keys.repartitionByRange(files, "none", "doc_id", "tie").groupBy(F.spark_partition_id().alias("part"))
    found = ranges.agg(F.min(F.struct("none", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")).alias("k")).collect()
    delete(docs.sparkSession, at)
    return sorted(tuple(r.k) for r in found)


def places(none: np.ndarray, ids: np.ndarray, ties: np.ndarray, bounds: list[tuple[bool, int, int]]) -> np.ndarray:
    """The last bound at or below each key (the first if there is none)."""
    out = np.zeros(len(ids), np.int64)
    for null in (False, True):
        own = np.flatnonzero(none == null)
        at = [b[1:] for b in bounds if b[0] == null]
        before = 0 if not null else len(bounds) - len(at)
        edge, tie = np.array([b[0] for b in at], np.int64), np.array([b[1] for b in at], np.int64)
        keys = np.zeros(len(own), np.int64) if null else ids[own]
        below, upto = np.searchsorted(edge, keys, "left"), np.searchsorted(edge, keys, "right")
        for k in np.unique(below[upto > below]).tolist():  # keys with the id of a bound: their ties tell
            same = np.flatnonzero((below == k) & (upto > below))
            below[same] += np.searchsorted(tie[k : upto[same[0]]], ties[own[same]], "right")
        out[own] = before + below - 1
    return np.maximum(out, 0).astype(np.int32)


def tokenised(docs: DataFrame, bounds: list[tuple[bool, int, int]], vocabulary: str | None = None) -> DataFrame:
    """part (the file that bounds give), none, doc_id, tie, n and the n ids of each text of docs, closed by the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            ids, counts = encoder.encode(batch.column("text"))
            keys = [batch.column(c) for c in ("none", "doc_id", "tie")]
            part = places(keys[0].to_numpy(zero_copy_only=False), keys[1].fill_null(0).to_numpy(zero_copy_only=False), keys[2].to_numpy(zero_copy_only=False), bounds)
            offsets = np.concatenate(([0], np.cumsum(counts) * ids.itemsize)).astype(np.int64)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{ids.itemsize}"))])
            yield pa.RecordBatch.from_arrays([pa.array(part), *keys, pa.array(counts.astype(np.int32)), raw.cast(pa.binary())], ["part", "none", "doc_id", "tie", "n", "ids"])

    return docs.select(*_order(docs), "text").mapInArrow(run, "part int, none boolean, doc_id long, tie long, n int, ids binary")


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, files: int | None = None) -> None:
    """The ids of docs(doc_id, text, ...) as token files under path, in ascending order of doc_id.

    Null ids come last; rows alike in doc_id follow a hash of their texts, so a rerun gives the same ids in the same
    order. A null or empty text is its end id alone; repeated rows are written each; other columns are ignored; an empty
    table gives a manifest of no files. A path that holds token files already is an error. vocabulary is a `tokenizers`
    file (default: the installed public one). A pass over ids and hashes finds where files begin, so texts are encoded
    once, in the task that sends their ids to a file.
    """
    docs.sparkSession.dataSource.register(TokenFiles)
    bounds = _bounds(docs, files or buckets_for(docs))
    ids = tokenised(docs, bounds, vocabulary).repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("none", "doc_id", "tie")
    ids.select("doc_id", "n", "ids").write.format(FORMAT).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of each document of the token files under path."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).load(path)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of read_token_files()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes())
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, read back from their files."""
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return digests(read_token_files(spark, path))
