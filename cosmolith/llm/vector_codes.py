"""Operator 11: vectors as short codes (product quantisation) with exact integer results.

A component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts, and each part is coded by
the nearest entry of its position's codebook. What is nearest is decided in integers, but found by one float32 matrix
product for a block of vectors: part and entry are at most LIMIT in every component, so both are exact in float32 and only
the product rounds. The standard bound on a dot product of k terms in any order, k u / (1 - k u) times the sum of the
absolute terms, gives each score an interval that holds the true one. A part whose best interval overlaps no other is
settled; where intervals overlap, those entries' squared distances are worked out anew in int64, ties go to the lower index.

The codebooks start as the parts of the vectors of smallest id. A round sums each entry's parts in every task, adds the
tasks' sums up in Spark and brings the sums to the driver: parts x entries x components numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cosmolith.llm.common import MOST, by_size, delete, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 24  # of a component: exact in float32, and 32768 squared differences fit int64
BLOCK = 4096  # vectors that are scored at a time
PAIRS = 1 << 21  # components that are worked out anew at a time
_U = 2.0**-24


def units(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, valid): floor(scale * x) of all components as float64; where each vector starts; which vectors are
    neither null nor hold null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = ~np.asarray(column.is_null())
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    with np.errstate(invalid="ignore", over="ignore"):
        return np.floor(values * scale), offsets, there & (bad[offsets[1:]] == bad[offsets[:-1]])


def codable(values: np.ndarray, offsets: np.ndarray, valid: np.ndarray, size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors as int64, width divisible by parts) of valid vectors of `size` components within LIMIT."""
    rows = np.flatnonzero(valid & (np.diff(offsets) == size))
    width = -(-size // parts) * parts
    out = np.zeros((len(rows), width), np.int64)
    if size and len(rows):
        own = values[offsets[rows][:, None] + np.arange(size)]
        within = (np.abs(own) <= LIMIT).all(1)
        rows = rows[within]
        out = np.zeros((len(rows), width), np.int64)
        out[:, :size] = own[within]
    return rows, out


def _anew(x: np.ndarray, book: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances in int64 of the given pairs of rows and entries, some at a time."""
    out, step = np.empty(len(row), np.int64), max(1, PAIRS // max(1, x.shape[1]))
    for at in range(0, len(row), step):
        gap = x[row[at : at + step]] - book[entry[at : at + step]]
        out[at : at + step] = (gap * gap).sum(1)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the entry of book nearest to each row of x, ties to the lower index. int64, components up to LIMIT."""
    k, out = x.shape[1], np.zeros(len(x), np.int64)
    if not len(x) or len(book) < 2 or not k:
        return out
    half = (book * book).sum(1) / 2  # |c|^2 / 2; |x - c|^2 / 2 is this - x.c, but for |x|^2 / 2, which all entries share
    c32 = np.concatenate([-book, half[:, None]], 1).astype(np.float32).T.copy()
    norm_c = np.sqrt(2 * half)
    gamma = (k + 16) * _U * 1.01  # of k + 1 terms, and of rounding |c|^2 / 2, the radius and the interval's ends themselves
    radius_c, radius_1 = (gamma * 1.001 * norm_c).astype(np.float32), (gamma * 1.001 * half).astype(np.float32)
    for at in range(0, len(x), BLOCK):
        b = x[at : at + BLOCK]
        x32 = np.ones((len(b), k + 1), np.float32)
        x32[:, :k] = b
        score = x32 @ c32
        norm_x = (np.sqrt((b.astype(np.float64) ** 2).sum(1)) * 1.001).astype(np.float32)
        radius = norm_x[:, None] * radius_c
        radius += radius_1
        best = (score + radius).min(1)
        score -= radius
        close = score <= best[:, None]
        row, entry = np.nonzero(close)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        many = np.diff(first, append=len(row)) > 1
        out[at : at + len(b)] = entry[first]
        if many.any():
            again = np.repeat(many, np.diff(first, append=len(row)))
            row, entry = row[again], entry[again]
            gap = _anew(b, book, row, entry)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            least = np.repeat(np.minimum.reduceat(gap, first), np.diff(first, append=len(row)))
            hit = np.flatnonzero(gap == least)
            hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
            out[at + row[hit]] = entry[hit]
    return out


def moved(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The entries after a round: componentwise floor(sum / count); unused ones stay."""
    used = counts > 0
    out = book.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out


def book_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


@dataclass
class Codes:
    """rows: id, label, code (0-based indexes, two hex digits each up to 256 entries), error; books: int64 arrays by part."""

    rows: DataFrame
    books: list[np.ndarray]


def _starts(df: DataFrame, entries: int, scale: int) -> tuple[DataFrame, str]:
    """Each task's number of valid vectors by length, and of each length those of smallest id, ties by their components' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        counts: dict[int, int] = {}
        for b in batches:
            values, offsets, valid = units(b.column("vector"), scale)
            ids = b.column("id").to_pylist()
            sizes = np.diff(offsets)
            for size in np.unique(sizes[valid]).tolist():
                counts[size] = counts.get(size, 0) + int((valid & (sizes == size)).sum())
                rows, own = codable(values, offsets, valid, size, 1)
                kept = best.get(size, [])
                most = kept[-1][0] if len(kept) >= entries else None  # rows of a larger id need no copy
                keys = [(ids[r] is None, ids[r] or 0) for r in rows]
                kept += [(key, own[j].astype("<i4").tobytes()) for j, key in enumerate(keys) if most is None or key <= most]
                best[size] = sorted(kept)[:entries]
        rows = [(size, n, None, None) for size, n in counts.items()]
        rows += [(size, 0, None if none else key, own) for size, found in best.items() for (none, key), own in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["size", "n", "id", "units"])

    return written(df.select("id", "vector").mapInArrow(run, "size int, n long, id long, units binary"), "starts")


def _tables(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    return df.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))


def _assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], size: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, valid, coded rows, their vectors, their entries by part) of each batch."""
    for b in batches:
        values, offsets, valid = units(b.column("vector"), scale)
        rows, own = codable(values, offsets, valid, size, len(books))
        k = own.shape[1] // len(books)
        yield b, valid, rows, own, np.stack([nearest(own[:, p * k : p * k + k], book) for p, book in enumerate(books)], 1) if len(rows) else np.zeros((0, len(books)), np.int64)


def _summing(books: list[np.ndarray], size: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, _, _, own, to in _assigned(batches, books, size, scale):
            k = own.shape[1] // len(books)
            for p in range(len(books)):
                order = np.argsort(to[:, p], kind="stable")
                first = np.flatnonzero(np.diff(to[order, p], prepend=-1))
                if len(first):
                    entry = to[order[first], p]
                    sums[p][entry] += np.add.reduceat(own[order, p * k : p * k + k], first, axis=0) if k else 0
                    counts[p] += np.bincount(to[:, p], minlength=len(counts[p]))
        for p in range(len(books)):
            used = np.flatnonzero(counts[p])
            width = sums[p].shape[1] + 1  # the count comes last
            flat = np.concatenate([sums[p][used], counts[p][used][:, None]], 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(flat)], ["part", "entry", "at", "v"])

    return run


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors of df, and the codebooks they refer to.

    Rows whose vector is null or holds a null or non-finite component are dropped. The length of a vector is that of most
    valid ones (ties to the greater); vectors of another length, or with a component beyond LIMIT / scale, keep their row
    with a null code and error. A length that parts doesn't divide is filled up with zeros. Codebooks start as the parts of
    the `entries` codable vectors of smallest id (null ids last, equal ids by their components' bytes), all of them if there are
    fewer. Repeated rows count each; ties of distance go to the lower index. Other columns are ignored, whatever their
    names. No codable vector: empty codebooks. vector holds an array of any numbers; id must be a whole number.
    """
    spark, rows = df.sparkSession, _tables(df, id, vector, label)
    heads, at = _starts(rows, entries, scale)
    found = heads.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = found[0]["size"] if found else 0
    first = heads.where((F.col("size") == size) & F.col("units").isNotNull()).orderBy(F.col("id").asc_nulls_last(), "units").limit(entries).collect()
    delete(spark, at)
    k = -(-size // parts)
    start = np.zeros((len(first), k * parts), np.int64)
    if first:
        start[:, :size] = [np.frombuffer(r["units"], "<i4") for r in first]
    books = [start[:, p * k : p * k + k].copy() for p in range(parts)]
    for _ in range(rounds if len(start) else 0):
        got = rows.select("vector").mapInArrow(_summing(books, size, scale), "part int, entry int, at int, v long").groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).toArrow()
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        part, entry, where, v = (got.column(c).to_numpy() for c in ("part", "entry", "at", "v"))
        for p in range(parts):
            own = part == p
            whole = np.zeros((len(books[p]), k + 1), np.int64)
            whole[entry[own], where[own]] = v[own]
            sums[p], counts[p] = whole[:, :k], whole[:, k]
        books = [moved(b, s, n) for b, s, n in zip(books, sums, counts, strict=True)]
    digits = max(2, len(f"{entries - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, valid, own_rows, own, to in _assigned(batches, books, size, scale):
            code, error = np.full(len(b), None, object), np.full(len(b), None, object)
            if len(books[0]):
                gap = own - np.concatenate([book[to[:, p]] for p, book in enumerate(books)], 1) if len(own_rows) else own
                error[own_rows] = (gap * gap).sum(1)
                names = [np.array([f"{j:0{digits}x}" for j in range(len(book))], object) for book in books]
                code[own_rows] = sum((names[p][to[:, p]] for p in range(1, parts)), names[0][to[:, 0]])
            keep = pa.array(valid)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), b.column("label").filter(keep), pa.array(code[valid], pa.string()), pa.array(error[valid], pa.int64())], ["id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    return Codes(rows.mapInArrow(run, f"id long, label {kind}, code string, error long"), books)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes(code, ...) with the vector each code stands for: its entries' components over scale; null for a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column("code").to_pylist()
            digits = max((len(c) for c in code if c), default=1) // len(books)
            found = [None if c is None else np.concatenate([book[int(c[p * digits : (p + 1) * digits], 16)] for p, book in enumerate(books)]) / scale for c in code]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float64()))], [*b.schema.names, "vector"])

    return codes.mapInArrow(run, StructType([*codes.schema.fields, StructField("vector", ArrayType(DoubleType()))]))


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows(label, error, ...) with label_error: the sum of errors of rows alike in label, nulls together (null beyond a long).

    Sums are formed before the exchange; their table is broadcast only up to a checked number of labels.
    """
    kept, _ = written(rows, "codes")
    sums, _ = written(kept.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return kept.join(by_size(sums, MOST), kept.label.eqNullSafe(sums._label), "left").drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of all valid vectors of embeddings."""
    found = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(found.rows).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book_digest(found.books)).alias("codebooks_sha256"))
