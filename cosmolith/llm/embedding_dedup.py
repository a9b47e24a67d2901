"""Operator 7: near-duplicate vectors by cross-polytope hashing, with multiprobe buckets and verified pairs.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform and takes the largest coordinate
with its sign; two such hashes make a bucket of a table. A vector is put into its own bucket and into the next likeliest
one of every table. Pairs of a bucket are compared exactly, in blocks; a pair that meets in several buckets counts in
the first. Buckets yield counts and a spanning forest, never pairs. A bucket of more than BLOCK vectors is dealt out as
pairs of blocks, so no task gets it whole. Buckets are formed on ids alone; vectors are sent only to those that hold two
or more. Exact copies are one class, hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.llm.common import delete, table, written
from cosmolith.llm.components import components

BLOCK = 2048
CODES = (1 << 31) - 1  # buckets of vectors of over 16 384 components may share a code, which costs comparisons only


@dataclass(frozen=True)
class CrossPolytope:
    tables: int = 8
    hashes: int = 2
    probes: int = 2
    seed: int = 11
    least: float = 0.93


HOW = CrossPolytope()


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, whose length is a power of two; unscaled."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def codes(x: np.ndarray, how: CrossPolytope) -> np.ndarray:
    """[rows, tables, probes]: the bucket of each vector in each table, then the next likeliest buckets; below CODES."""
    n = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), n), np.float32)
    padded[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((len(x), how.tables, how.probes), np.int64)
    rows = np.arange(len(x))
    for t in range(how.tables):
        code, losses, alternatives = np.zeros(len(x), np.int64), [], []
        for h in range(how.hashes):
            rng = np.random.default_rng((how.seed, t, h))
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice(np.float32([-1, 1]), n)) / np.float32(np.sqrt(n))
            top = np.argpartition(-np.abs(y), min(2, n - 1), axis=1)[:, : min(3, n)]
            size = np.abs(y[rows[:, None], top])
            order = np.argsort(-size, axis=1, kind="stable")
            top, size = np.take_along_axis(top, order, 1), np.take_along_axis(size, order, 1)
            value = top + n * (y[rows[:, None], top] < 0)
            code = code * 2 * n + value[:, 0]
            for j in range(1, top.shape[1]):
                losses.append(size[:, 0] - size[:, j])
                alternatives.append((value[:, j] - value[:, 0]) * (2 * n) ** (how.hashes - 1 - h))
        out[:, t, 0] = code
        cheap = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, : how.probes - 1]
        out[:, t, 1:] = code[:, None] + np.take_along_axis(np.stack(alternatives, 1), cheap, 1)
    return out % CODES


def _lists(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), flat.dtype)


def _sketch(how: CrossPolytope):
    """Each vector with its codes: tables x probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                size = np.diff(part.column("embedding").offsets.to_numpy())
                for width in np.unique(size):
                    own = part.filter(pa.array(size == width))
                    c = codes(_lists(own.column("embedding")).astype(np.float64), how)
                    flat = pa.array(list(c.reshape(len(c), -1).astype(np.int32)), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*own.columns, flat], [*own.schema.names, "codes"])

    return run


def _meet(how: CrossPolytope, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows of codes: the first table in which they share a bucket, and the least such bucket."""
    a, b = a.reshape(len(a), how.tables, how.probes, 1), b.reshape(len(b), how.tables, 1, how.probes)
    same = a == b
    first = same.any(axis=(2, 3)).argmax(axis=1)
    rows = np.arange(len(a))
    at = np.where(same[rows, first], np.broadcast_to(a[rows, first], (len(a), how.probes, how.probes)), np.iinfo(np.int32).max)
    return first, at.min(axis=(1, 2))


def _group(how: CrossPolytope, x: np.ndarray, code: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, within: bool, bucket: int, count: np.ndarray) -> list[tuple[int, int]]:
    """Adds a group's links to count; returns the edges, as rows, of a spanning forest of its links."""
    norm, label, edges = np.sqrt(np.einsum("ij,ij->i", x, x)), np.arange(len(x)), []
    for lo in range(0, len(left), 512):
        i = left[lo : lo + 512]
        near = (x[i] @ x[right].T) / np.outer(norm[i], norm[right]) >= how.least
        if within:
            near &= right[None, :] > i[:, None]
        r, c = np.nonzero(near)
        for k in range(0, len(r), 1 << 18):
            a, b = i[r[k : k + (1 << 18)]], right[c[k : k + (1 << 18)]]
            table, first = _meet(how, code[a], code[b])
            new = first.astype(np.int64) * how.tables + table == bucket
            np.add.at(count, a[new], weight[b[new]])
            np.add.at(count, b[new], weight[a[new]])
        for q in np.unique(r):  # a row joins the trees of those it is linked with; trees are relabelled at once
            others = right[near[q]]
            roots, at = np.unique(label[others], return_index=True)
            for root, o in zip(roots, others[at], strict=True):
                if root != label[i[q]]:
                    edges.append((i[q], o))
                    label[label == root] = label[i[q]]
    return edges


def _verify(how: CrossPolytope):
    names = ["cid", "n", "bucket", "block", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group; a group may span batches."""
        held: pa.Table | None = None

        def work(t: pa.Table) -> pa.RecordBatch:
            col = {n: t.column(n).to_numpy() for n in [*names, "grp"]}
            code = _lists(t.column("codes").combine_chunks() if t.column("codes").num_chunks != 1 else t.column("codes").chunk(0))
            vectors = t.column("embedding").combine_chunks() if t.column("embedding").num_chunks != 1 else t.column("embedding").chunk(0)
            new = np.zeros(len(t), bool)
            for n in ("grp", "bucket", "lo", "hi"):
                new |= np.concatenate(([True], col[n][1:] != col[n][:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(t))
            flat, at = vectors.flatten().to_numpy(), np.concatenate(([0], np.cumsum(vectors.value_lengths().to_numpy())))
            count, edges = np.zeros(len(t), np.int64), []
            for lo, hi in zip(first, last, strict=True):
                if hi - lo < 2:
                    continue
                for width in np.unique(np.diff(at[lo : hi + 1])):
                    own = np.arange(lo, hi)[np.diff(at[lo : hi + 1]) == width]
                    x = flat[at[own][:, None] + np.arange(width)].astype(np.float64)
                    left, right = np.flatnonzero(col["block"][own] == col["lo"][lo]), np.flatnonzero(col["block"][own] == col["hi"][lo])
                    part = np.zeros(len(own), np.int64)
                    edges += [(own[u], own[v]) for u, v in _group(how, x, code[own], col["n"][own], left, right, col["lo"][lo] == col["hi"][lo], int(col["bucket"][lo]), part)]
                    count[own] += part
            hit = np.flatnonzero(count)
            e = np.array(edges, np.int64).reshape(-1, 2)
            u = np.concatenate((col["cid"][hit], col["cid"][e[:, 0]]))
            n = np.concatenate((count[hit], np.zeros(len(e), np.int64)))
            v = pa.array(np.concatenate((np.zeros(len(hit), np.int64), col["cid"][e[:, 1]])), mask=np.arange(len(u)) < len(hit))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n), v], ["u", "n", "v"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            grp = t.column("grp").to_numpy()
            cut = int(np.searchsorted(grp, grp[-1], "left"))
            held = t.slice(cut)
            if cut:
                yield work(t.slice(0, cut))
        if held is not None:
            yield work(held)

    return run


def embedding_dedup(vectors: DataFrame, how: CrossPolytope = HOW) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label, ...): vec_id, n_links, component_id, kept.

    Vectors are compared only within equal, non-null labels and equal lengths. A vector that is null, empty, zero, or
    holds a null or non-finite component links with nothing: n_links 0, its own component, kept. Exact copies (repeated
    rows too) link with each other and are one class for the search. A null vec_id is never a component's id unless the
    component has no other; kept is then null. An empty table gives an empty result; other columns are ignored.
    """
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as such and are compared in double precision
    v = vectors.select("vec_id", "label", F.col("embedding").cast(kind).alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("cid", F.when(fit, F.xxhash64("label", "embedding")))
    marked, _ = written(v.select("vec_id", "cid", F.when(fit, F.col("label")).alias("label"), F.when(fit, F.col("embedding")).alias("embedding")), "vectors")
    classes = marked.where("cid is not null").groupBy("cid").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    schema = ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", codes array<int>"
    classes, classes_at = written(classes.mapInArrow(_sketch(how), schema), "classes")
    put = classes.select("label", "cid", F.posexplode("codes").alias("at", "code"))
    put = put.select("label", "cid", (F.col("code").cast("long") * how.tables + F.floor(F.col("at") / how.probes)).cast("long").alias("bucket"))
    large = put.groupBy("label", "bucket").count().where(F.col("count") > 1).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    slim = put.join(large, ["label", "bucket"]).withColumn("block", F.pmod(F.hash("cid"), F.col("blocks")))
    slim = slim.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    slim = slim.select("cid", "bucket", "block", "lo", "hi", F.xxhash64("label", "bucket", "lo", "hi").alias("grp"))
    dealt = slim.join(classes.select("cid", "n", "embedding", "codes"), "cid")
    order = ["grp", "bucket", "lo", "hi"]
    found, found_at = written(dealt.repartition("grp").sortWithinPartitions(*order).mapInArrow(_verify(how), "u long, n long, v long"), "found")
    linked = components(found.where("v is not null").select("u", "v"))
    counts = found.groupBy("u").agg(F.sum("n").alias("links")).withColumnRenamed("u", "cid")
    label = classes.select("cid", "n", "least").join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    ids = label.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = label.join(ids, "component").join(counts, "cid", "left").select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    by_class, _ = written(by_class, "links")
    delete(vectors.sparkSession, found_at, classes_at)
    out = marked.select("vec_id", "cid").join(by_class, "cid", "left")
    own = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
