"""Shared pieces of the training-data operators: tables in the cluster's shared folder, and word arithmetic on Arrow buffers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: the ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
SEGMENT = 1 << 20
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session in one process (tests, local runs) that sets none gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cosmolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def create_once(spark: SparkSession, path: str, body: str) -> bool:
    """A file with body at path, whole or not at all; False if there is one already, by whichever writer.

    The body is written aside. On a local file system it is then linked into place, which fails if the name is taken; on
    others renamed, which fails in the same way on HDFS. An object store needs a single writer.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, to = file_system(spark, path), at(path)
    aside = at(to.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(body.encode()))
    out.close()
    local = lambda p: p.toUri().getPath()
    if to.toUri().getScheme() == "file" and os.path.exists(local(aside)):
        try:
            os.link(local(aside), local(to))
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(aside, False)
    if fs.exists(to) or not fs.rename(aside, to):
        fs.delete(aside, False)
        return False
    return True


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, which cuts its lineage and outlives lost executors; and the table's path."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def by_size(df: DataFrame, most: int) -> DataFrame:
    """A written table for a join: broadcast up to `most` rows, beyond that joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= most else df


MOST = 200_000  # slim rows that are broadcast, a few MB


def in_blocks(rows: DataFrame, keys: DataFrame, by: str, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(lists, long): rows(key, ...) whose key others have too, each list sorted by `by`, for a search within each key.

    keys: the column key of rows. A list of more than `block` rows is cut into blocks under keys of their own, none with many
    more than `block` rows. Each block also gets the list's first row, so that what is like that row is joined across
    blocks; other links between blocks are left to between_labels(). long holds the keys of such lists, or is None.
    """
    shared, _ = written(keys.groupBy("key").count().where("count > 1"), "shared")
    long = shared.where(F.col("count") > block).select("key")
    own = [c for c in rows.columns if c != "key"]
    rows = rows.join(by_size(shared, MOST), "key")
    if long.isEmpty():
        return rows.select("key", *own).repartition("key").sortWithinPartitions("key", by), None
    first, _ = written(rows.where(F.col("count") > block).groupBy("key").agg(F.min(by).alias("_first")), "first")
    rows = rows.join(by_size(first, MOST), "key", "left")
    blocks = F.ceil(F.col("count") / block).cast("int")
    to = F.when(F.col("_first").isNull(), F.array(F.lit(-1))).when(F.col(by) == F.col("_first"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64(by), blocks).cast("int")))
    rows = rows.withColumn("_to", F.explode(to))
    rows = rows.select(F.when(F.col("_to") < 0, F.col("key")).otherwise(F.xxhash64("key", "_to")).alias("key"), *own)
    return rows.repartition("key").sortWithinPartitions("key", by), long


def between_labels(rows: DataFrame, keys: DataFrame, by: str, block: int) -> DataFrame:
    """rows(key, label, ...) for a search of the pairs of each key that have two labels, sorted by key and `by`.

    keys: the columns key and label of rows. A list of one label is left out. A list of more than 2 * block rows is dealt out:
    the rows of its largest label are cut into blocks, so are the others, and every block of others meets every block of
    either kind under a key of its own. So a large class is sent once for each block of other rows, not as pairs of its own.
    """
    sums = keys.groupBy("key", "label").count()
    lists = sums.groupBy("key").agg(F.sum("count").alias("_all"), F.max(F.struct("count", "label")).alias("_top"), F.count("*").alias("_labels")).where("_labels > 1")
    kept, _ = written(lists.select("key", F.col("_top.label").alias("_large"), F.col("_top.count").alias("_most"), (F.col("_all") - F.col("_top.count")).alias("_few")), "lists")
    own = [c for c in rows.columns if c != "key"]
    rows = rows.join(by_size(kept, MOST), "key")
    many, few = F.ceil(F.col("_most") / block).cast("int"), F.ceil(F.col("_few") / block).cast("int")
    hashed, large = F.xxhash64(by), F.col("label") == F.col("_large")
    at = F.when(large, few + F.pmod(hashed, many)).otherwise(F.pmod(hashed, few)).cast("int")
    rows = rows.withColumn("_at", at)
    others = F.when(large, F.sequence(F.lit(0), few - 1)).otherwise(F.filter(F.sequence(F.lit(0), few + many - 1), lambda x: x != F.col("_at")))
    rows = rows.withColumn("_other", F.explode(F.when(F.col("_few") + F.col("_most") <= 2 * block, F.array(F.lit(-1))).otherwise(others)))
    pair = F.xxhash64("key", F.least("_at", "_other"), F.greatest("_at", "_other"))
    return rows.select(F.when(F.col("_other") < 0, F.col("key")).otherwise(pair).alias("key"), *own).repartition("key").sortWithinPartitions("key", by)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df, for choosing how many buckets work is dealt to."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, per_bucket: int = 64 << 20) -> int:
    """Buckets so that each gets at most per_bucket bytes of input, and no fewer than the session's shuffle partitions."""
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(input_bytes(df), 1 << 50) // per_bucket + 1))


# ---- words of Arrow text columns, without a Python loop over documents -------------------------------------------


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw, data = column.buffers()[1:3]
    if raw is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each (a longer row is a range of its own)."""
    out, n, at = [], len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        out.append((at, min(to, n)))
        at = to
    return out


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that offsets delimit: first and past-the-end byte of each word, and the number of words of each row."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    solid = ~_GAP[buf[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)  # a row's first byte starts a word even if the row before ends in one
    edge[offsets - lo] = True
    before = np.concatenate(([False], solid))[: hi - lo]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid, [False]))[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts + lo, ends + lo, np.diff(np.searchsorted(starts + lo, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, 1 << (n - 1).bit_length()) + 1
    if size not in _POWERS:
        pair = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, from prefix sums of a polynomial modulo 2**64, a segment of the text at a time."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        up, down = _powers(int(ends[to - 1] - base))
        sums = np.zeros(int(ends[to - 1] - base) + 1, np.uint64)
        np.cumsum((buf[base : ends[to - 1]].astype(np.uint64) + np.uint64(1)) * up[: len(sums) - 1], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hashes(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes."""
    n = max(0, len(hashes) - k + 1)
    out, by = np.zeros(n, np.uint64), np.uint64(seed | 1)
    for j in range(k):
        out = out * by + hashes[j : j + n]
    return mix(out)


def pack_gaps(at: np.ndarray, kind: type = np.uint8) -> bytes:
    """Rising positions as the gaps between them; a gap over the type's range is carried by fillers."""
    top = np.iinfo(kind).max
    gaps = np.diff(at, prepend=0).astype(np.int64)
    last = np.cumsum(gaps // top + 1) - 1
    out = np.full(int(last[-1]) + 1 if len(last) else 0, top, kind)
    out[last] = gaps % top
    return out.tobytes()


def unpack_gaps(raw: bytes, kind: type = np.uint8) -> np.ndarray:
    codes = np.frombuffer(raw, kind)
    return np.cumsum(codes, dtype=np.int64)[codes != np.iinfo(kind).max]
