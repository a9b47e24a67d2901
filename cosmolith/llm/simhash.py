"""Operator 3: near-duplicate texts by SimHash, found with an inverted index of fingerprint bytes and count filtering.

Two 64-bit fingerprints that differ in at most 4 bits share at least 4 of their 8 positional bytes. A posting list for
each single (position, byte) would hold 1/256 of all fingerprints, so the index posts triples of positional bytes: of
the 56 triples, 20 suffice, as any 4 shared positions hold one of those (a Turan system). Inside a list the shared
positional bytes of a pair are tallied, pairs under the guaranteed minimum are dropped, and the rest is verified on the
bits. Lists hold distinct fingerprints only and yield a spanning forest, not pairs, so copies cost nothing. A list of more
than LIST rows is cut into blocks, so no task gets it whole; when classes are known, rows of different classes meet across
blocks.

The pipeline stage links texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, which 64 bits tell
too coarsely to decide. Candidates are the pairs that op3's fingerprints and index link, and those that agree in one of 20 bands of 4 minima (MinHash: a pair of similarity s is missed with
probability (1 - s^4)^20, 3e-5 at 0.8), in 48 of all 80 minima, and in size to 0.8; each is then verified on the shingles of
the two texts. A first round verifies a spanning forest of each list of candidates. Where links of it prove false, the
forest may have gone through them, so in a second round the texts of a family (what the forest's pairs join, true or not) meet
in one place, and every candidate pair whose texts are still in two classes is verified there; only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.llm.common import MOST, NO_ID, between_labels, by_size, delete, in_blocks, mix, table, written
from cosmolith.llm.components import components

BLOCK = 1024
LIST = 4096  # rows of a posting list that a task searches at once
FAMILY = 512  # texts of a block of a family


def guaranteed_triples() -> list[tuple[int, ...]]:
    """20 triples of byte positions, one of which lies in any 4 of the 8 positions."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    keep = []
    for t in combinations(range(8), 3):
        n = {x: [group[i] for i in t].count(x) for x in {group[i] for i in t}}
        twice = next((x for x in n if n[x] == 2), None)
        if len(n) == 1 or twice is not None and n.get((twice + 1) % 3) == 1:
            keep.append(t)
    return keep


@dataclass(frozen=True)
class SimHash:
    """shingle words, 64-bit lanes, differing bits that still link, shared positional bytes a pair must have, index keys."""

    shingle: int = 4
    lanes: int = 1
    max_bits: int = 4
    min_shared: int = 4
    keys: tuple[tuple[int, ...], ...] = tuple(guaranteed_triples())


CONTRACT = SimHash()


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k lower-cased words; of the whole sequence if there are fewer words."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    return np.fromiter((digest(join(x), 42) for x in zip(*(w[i:] for i in range(k)), strict=False)), np.uint64, len(w) - k + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """Bit b of a lane is set if it is in over half the hashes; big-endian. Long texts are counted a block at a time."""
    out = b""
    for lane in range(lanes):
        h = mix(hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if lane else hashes
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(h), BLOCK):
            ones += np.unpackbits(h[lo : lo + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint16)
        out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def _fingerprints(how: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            prints = pa.array([fingerprint(shingle_hashes(x.as_py(), how.shingle), how.lanes) for x in batch.column(at)], pa.binary())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), prints], [*(batch.schema.names[i] for i in rest), "fp"])

    return run


def _matrix(column: pa.Array, lanes: int) -> np.ndarray:
    width = 8 * lanes
    data = np.frombuffer(column.buffers()[2], np.uint8)[column.offset * width : (column.offset + len(column)) * width]
    return data.reshape(len(column), width)


def _post(how: SimHash):
    """Each fingerprint under each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.column("fp").slice(lo, 20_000)
                m = _matrix(part, how.lanes).astype(np.int64)
                keys = np.concatenate([(((k << 8 | m[:, a]) << 8 | m[:, b]) << 8) | m[:, c] for k, (a, b, c) in enumerate(how.keys)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.concat_arrays([part] * len(how.keys))], ["key", "fp"])

    return run


def _linked(one: np.ndarray, many: np.ndarray, how: SimHash) -> np.ndarray:
    """Which of the rows share enough positional bytes with one and, verified, differ in few enough bits."""
    x = one ^ many
    ok = np.flatnonzero((x == 0).sum(axis=1) >= how.min_shared)
    hit = np.zeros(len(x), bool)
    hit[ok] = np.bitwise_count(x[ok]).sum(axis=1, dtype=np.int32) <= how.max_bits
    return hit


def forest(prints: np.ndarray, how: SimHash) -> list[tuple[bytes, bytes]]:
    """Edges that join the linked fingerprints of a posting list: each is compared with those not reached yet."""
    edges, rest = [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = _linked(x, rest, how)
            if hit.any():
                near = rest[hit]
                edges += [(x.tobytes(), y.tobytes()) for y in near]
                queue += list(near)
                rest = rest[~hit]
    return edges


def _search(how: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key; a posting list may span batches."""
        held_key, held = None, []

        def out(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            key, fp, edges = batch.column("key").to_numpy(), _matrix(batch.column("fp"), how.lanes), []
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(first[1:], len(key))
            if held and key[0] == held_key:
                held.append(fp[: last[0]].copy())
                if len(first) == 1:
                    continue
                first, last = first[1:], last[1:]
            if held:
                edges += forest(np.concatenate(held), how)
            held_key, held = key[first[-1]], [fp[first[-1] :].copy()]
            first, last = first[:-1], last[:-1]
            two = first[last - first == 2]
            ok = two[_linked(fp[two], fp[two + 1], how)] if len(two) else two
            edges += [(fp[i].tobytes(), fp[i + 1].tobytes()) for i in ok]
            for lo, hi in zip(first[last - first > 2], last[last - first > 2], strict=True):
                edges += forest(fp[lo:hi], how)
            if edges:
                yield out(edges)
        if held and (edges := forest(np.concatenate(held), how)):
            yield out(edges)

    return run


def fingerprint_links(prints: DataFrame, how: SimHash) -> DataFrame:
    """Edges (u, v) that join all linked fingerprints of prints(fp), which must be distinct."""
    posted, kind = prints.select("fp").mapInArrow(_post(how), "key long, fp binary"), "u binary, v binary"
    lists, long = in_blocks(posted, posted.select("key"), "fp", LIST)
    edges = lists.mapInArrow(_search(how), kind)
    if long is None:
        return edges
    edges, _ = written(edges.distinct(), "links")
    label = components(edges).withColumnsRenamed({"node": "fp", "component": "label"})
    rows = posted.join(by_size(long, MOST), "key", "left_semi").join(label, "fp", "left").select("key", "fp", F.coalesce("label", "fp").alias("label"))
    return edges.union(between_labels(rows, rows.select("key", "label"), "fp", LIST).select("key", "fp").mapInArrow(_search(how), kind))


def simhash_classes(docs: DataFrame, keep: list[str], how: SimHash = CONTRACT) -> DataFrame:
    """docs' columns `keep` (doc_id among them), fp, and component_id: the least doc_id its fingerprint can reach.

    A null or empty text has fingerprint 0 and is linked like any other. Null doc_ids keep their fingerprint and class
    but are never the class id, unless a class has no other (then null). Repeated rows stay; an empty table gives none.
    """
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes if n != "text")
    marked, _ = written(kept.mapInArrow(_fingerprints(how), f"{schema}, fp binary"), "fingerprints")
    prints, _ = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    linked = components(fingerprint_links(prints, how))
    label = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    ids = label.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print, _ = written(label.join(ids, "label").select("fp", "component_id"), "classes")
    return marked.join(by_print, "fp")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# ---- the pipeline's stage: verified similarity of shingle sets ---------------------------------------------------


@dataclass(frozen=True)
class NearDuplicates:
    """shingle words, least similarity (a fraction), bands of the index, minima a band, minima that candidates share."""

    shingle: int = 5
    similarity: tuple[int, int] = (4, 5)
    bands: int = 20
    rows: int = 4
    min_shared: int = 48

    @property
    def minima(self) -> int:
        return self.bands * self.rows


STAGE = NearDuplicates()


def text_node() -> Column:
    """What stands for a text: its MD5; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of the hashes under each of `count` fixed permutations of 64-bit numbers."""
    rng = np.random.default_rng(11)
    by, plus = (rng.integers(0, 1 << 64, (count, 1), np.uint64, endpoint=False) for _ in range(2))
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), BLOCK):
        np.minimum(out, (hashes[lo : lo + BLOCK] * (by | np.uint64(1)) + plus).min(axis=1), out=out)
    return out


def _fixed(m: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    m = np.ascontiguousarray(m)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[column.offset * width : (column.offset + len(column)) * width]
    return data.reshape(len(column), width)


def _sketches(how: NearDuplicates):
    """Of each text: its SimHash fingerprint, how many distinct shingles, a byte of each minimum, and the key of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, low, keys = [], [], np.zeros((batch.num_rows, how.minima), np.uint8), np.zeros((batch.num_rows, how.bands), np.uint64)
            for i, text in enumerate(batch.column("text")):
                prints.append(fingerprint(shingle_hashes(text.as_py(), CONTRACT.shingle)))
                h = np.unique(shingle_hashes(text.as_py(), how.shingle))
                sizes.append(len(h))
                least = minima(h, how.minima)
                low[i] = least & np.uint64(255)
                key = np.arange(1, how.bands + 1, dtype=np.uint64)
                for part in least.reshape(how.bands, how.rows).T:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
                keys[i] = key
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), _fixed(low), _fixed(keys.view(np.uint8))], ["node", "fp", "n", "low", "keys"])

    return run


def _band_keys(how: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bytes(batch.column("keys"), 8 * how.bands).view(np.int64).ravel())], ["key"])

    return run


def _post_bands(how: NearDuplicates):
    """Each text under the key of each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 5_000):
                part = batch.slice(lo, 5_000)
                key = _bytes(part.column("keys"), 8 * how.bands).view(np.int64).T.ravel()
                names = [x for x in part.schema.names if x != "keys"]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.concat_arrays([part.column(x)] * how.bands) for x in names)], ["key", *names])

    return run


def _candidates(n: np.ndarray, low: np.ndarray, one, many, how: NearDuplicates) -> np.ndarray:
    """Which of the rows `many` may, by size and minima, be similar enough to `one` (a row, or as many rows)."""
    num, den = how.similarity
    a, b = n[one], n[many]
    return (den * np.minimum(a, b) >= num * np.maximum(a, b)) & ((low[one] == low[many]).sum(axis=1) >= how.min_shared)


def _spanning(n: np.ndarray, low: np.ndarray, how: NearDuplicates) -> list[tuple[int, int]]:
    """Pairs of rows that join all candidates of a list: each row is compared with those not reached yet."""
    pairs, rest = [], np.arange(len(n))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = _candidates(n, low, x, rest, how)
            if hit.any():
                pairs += [(x, y) for y in rest[hit]]
                queue += list(rest[hit])
                rest = rest[~hit]
    return pairs


def _search_bands(how: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key; a list may span batches."""

        def out(node: np.ndarray, pairs: list) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(pairs), 50_000):
                at = np.array(pairs[lo : lo + 50_000])
                u, v = node[at[:, 0]], node[at[:, 1]]
                low_first = np.array([a.tobytes() <= b.tobytes() for a, b in zip(u, v, strict=True)])[:, None]
                yield pa.RecordBatch.from_arrays([_fixed(np.where(low_first, u, v)), _fixed(np.where(low_first, v, u))], ["u", "v"])

        held_key, held = None, []
        for batch in batches:
            key = batch.column("key").to_numpy()
            node, n, low = _bytes(batch.column("node"), 16), batch.column("n").to_numpy(), _bytes(batch.column("low"), how.minima)
            cols = (node, n, low)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(first[1:], len(key))
            if held and key[0] == held_key:
                held.append([c[: last[0]].copy() for c in cols])
                if len(first) == 1:
                    continue
                first, last = first[1:], last[1:]
            if held:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield from out(whole[0], _spanning(*whole[1:], how))
            held_key, held = key[first[-1]], [[c[first[-1] :].copy() for c in cols]]
            first, last = first[:-1], last[:-1]
            two = first[last - first == 2]
            two = two[_candidates(n, low, two, two + 1, how)]
            pairs = [(i, i + 1) for i in two]
            for lo, hi in zip(first[last - first > 2], last[last - first > 2], strict=True):
                pairs += [(lo + x, lo + y) for x, y in _spanning(n[lo:hi], low[lo:hi], how)]
            yield from out(node, pairs)
        if held:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from out(whole[0], _spanning(*whole[1:], how))

    return run


def similar(a: np.ndarray, b: np.ndarray, how: NearDuplicates = STAGE) -> bool:
    """Whether two sets, as sorted distinct hashes, have the least similarity; two empty ones do."""
    num, den = how.similarity
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


class Shingles:
    """The shingles of texts as they are asked for, the last few hundred thousand of them kept."""

    def __init__(self, how: NearDuplicates, most: int = 1 << 20) -> None:
        self.how, self.most, self.size, self.known = how, most, 0, {}

    def __call__(self, node: bytes, text: str | None) -> np.ndarray:
        if (own := self.known.get(node)) is None:
            own = np.unique(shingle_hashes(text, self.how.shingle))
            self.known[node], self.size = own, self.size + len(own)
            while self.size > self.most and len(self.known) > 1:
                self.size -= len(self.known.pop(next(iter(self.known))))
        return own


def _verify(how: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(how)
        for batch in batches:
            u, v, a, b = (batch.column(x) for x in ("u", "v", "text_u", "text_v"))
            ok = [similar(shingles(u[i].as_py(), a[i].as_py()), shingles(v[i].as_py(), b[i].as_py()), how) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([u, v, pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    return run


def joining(n: np.ndarray, low: np.ndarray, label: np.ndarray, alike, how: NearDuplicates) -> list[tuple[int, int]]:
    """Similar pairs of rows that join the classes of a list, as many as join something: every candidate pair whose rows are
    still in two classes is put to alike(x, y). The rows of the largest class look for no pairs themselves."""
    kinds, of = np.unique(label, return_inverse=True)
    if len(kinds) < 2:
        return []
    small, every, out = of != np.argmax(np.bincount(of)), np.arange(len(n)), []
    for x in np.flatnonzero(small):
        other = every[(of != of[x]) & (~small | (every > x))]
        other = other[_candidates(n, low, x, other, how)]
        for y in other[np.argsort(-(low[other] == low[x]).sum(axis=1), kind="stable")]:
            if of[y] != of[x] and alike(x, y):
                out.append((int(x), int(y)))
                of[of == of[y]] = of[x]
    return out


def _search_families(how: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key; a family, or a pair of its blocks, may span batches."""
        held_key, held, shingles = None, [], Shingles(how)

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks().to_batches()[0]
            node, text = rows.column("node"), rows.column("text")
            own = lambda i: shingles(node[int(i)].as_py(), text[int(i)].as_py())
            alike = lambda x, y: similar(own(x), own(y), how)
            pairs = joining(rows.column("n").to_numpy(), _bytes(rows.column("low"), how.minima), _bytes(rows.column("label"), 16).copy().view("S16").ravel(), alike, how)
            if pairs:
                yield pa.RecordBatch.from_arrays([node.take(pa.array([p[i] for p in pairs])) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            key = batch.column("key").to_numpy()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for lo, hi in zip(first, np.append(first[1:], len(key)), strict=True):
                if held and key[lo] != held_key:
                    yield from out(pa.Table.from_batches(held))
                    held = []
                held_key = key[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def verified(pairs: DataFrame, texts: DataFrame, how: NearDuplicates) -> DataFrame:
    """pairs(u, v), and whether the shingles of their texts(node, text) are similar enough."""
    with_u = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    with_both = with_u.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    return with_both.select("u", "v", "text_u", "text_v").mapInArrow(_verify(how), "u binary, v binary, ok boolean")


def _posted(prints: DataFrame, how: NearDuplicates) -> DataFrame:
    return prints.select("node", "n", "low", "keys").mapInArrow(_post_bands(how), "key long, node binary, n int, low binary")


def forest_pairs(prints: DataFrame, how: NearDuplicates) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs (u, v) that join the candidates of each list of prints(node, n, low, keys), but for links between the
    blocks of long lists; and the keys of those. Lists are sorted, so the first text of a group is the same in all bands."""
    keys = prints.select("keys").mapInArrow(_band_keys(how), "key long")
    lists, long = in_blocks(_posted(prints, how), keys, "node", LIST)
    return lists.mapInArrow(_search_bands(how), "u binary, v binary").distinct(), long


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (u, v) that join the texts of prints(node, fp) which op3's index links: those of one fingerprint with its least
    text, and the least texts of fingerprints that differ in few enough bits."""
    least, _ = written(prints.groupBy("fp").agg(F.min("node").alias("u")), "fingerprints")
    same = prints.select("fp", "node").join(least, "fp").where("node <> u").select("u", F.col("node").alias("v"))
    edges = fingerprint_links(least, CONTRACT).distinct().withColumnsRenamed({"u": "_a", "v": "_b"})
    near = edges.join(least.select(F.col("fp").alias("_a"), "u"), "_a").join(least.select(F.col("fp").alias("_b"), F.col("u").alias("v")), "_b")
    return same.union(near.select(F.least("u", "v"), F.greatest("u", "v")))


def family_links(families: DataFrame, prints: DataFrame, texts: DataFrame, links: DataFrame, how: NearDuplicates) -> DataFrame:
    """Similar pairs (u, v) that join the classes links(node, component) of each family(node, component) of candidates.

    A family of one class is done. Of the others every text is sent once, and of large ones once for each block of texts
    outside the largest class; pairs are verified where they meet, and only those that join classes leave the task.
    """
    label = links.withColumnRenamed("component", "label")
    rows = families.select("node", F.xxhash64("component").alias("key")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows, _ = written(rows, "families")
    open_, _ = written(rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"), "open")
    rows = rows.join(by_size(open_, MOST), "key").join(prints.select("node", "n", "low"), "node").join(texts, "node").select("key", "label", "node", "n", "low", "text")
    rows, _ = written(rows, "members")
    return between_labels(rows, rows.select("key", "label"), "node", FAMILY).mapInArrow(_search_families(how), "u binary, v binary")


def near_classes(docs: DataFrame, how: NearDuplicates = STAGE) -> DataFrame:
    """(node, label) of every text that has near duplicates; the label is the least node of its class."""
    keyed = docs.select(text_node().alias("node"), "text")
    sketches = keyed.mapInArrow(_sketches(how), "node binary, fp binary, n int, low binary, keys binary")
    prints, prints_at = written(sketches.dropDuplicates(["node"]), "prints")
    found, long = forest_pairs(prints, how)
    pairs, pairs_at = written(found.union(fingerprint_pairs(prints)).distinct(), "pairs")
    related = pairs
    if long is not None:  # all of a long list are one family, as its blocks have not met
        listed = _posted(prints, how).select("key", "node").join(by_size(long, MOST), "key")
        first = listed.groupBy("key").agg(F.min("node").alias("u"))
        related = pairs.union(listed.join(by_size(written(first, "first")[0], MOST), "key").select("u", F.col("node").alias("v")))
    nodes, nodes_at = written(related.select(F.col("u").alias("node")).union(related.select("v")).distinct(), "nodes")
    texts, texts_at = written(keyed.join(by_size(nodes, MOST), "node", "left_semi").dropDuplicates(["node"]), "texts")
    tested, tested_at = written(verified(pairs, texts, how), "verified")
    links = components(tested.where("ok").select("u", "v"))
    if long is not None or not tested.where("not ok").isEmpty():
        more, more_at = written(family_links(components(related), prints, texts, links, how), "links")
        if not more.isEmpty():
            links = components(links.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
        delete(docs.sparkSession, more_at)
    out, _ = written(links.withColumnRenamed("component", "label"), "classes")
    for path in (prints_at, pairs_at, nodes_at, texts_at, tested_at):
        delete(docs.sparkSession, path)
    return out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with its least doc_id, of those that share it the one with the least MD5.

    A null doc_id is larger than any other. Rows alike in doc_id and text are one document, of which a row stays. Texts that
    are not similar all stay, whether their ids are null, repeated or unique.
    """
    key, node = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"), text_node().alias("_node")
    classes = near_classes(docs).withColumnRenamed("node", "_node")
    rows = docs.select(key, node).join(classes, "_node", "left").select("_key", "_node", F.coalesce("label", "_node").alias("label"))
    heads, _ = written(rows.groupBy("label").agg(F.min(F.struct("_key", "_node")).alias("head")).select("head.*"), "heads")
    # One exchange of the texts, by id and text, serves both the join and the choice among rows alike.
    kept = docs.select(key, node, F.struct(*(docs[c] for c in docs.columns)).alias("_row")).join(heads, ["_key", "_node"], "left_semi")
    order = [F.col("_row")[c] for c, t in docs.dtypes if c not in ("text", "doc_id") and not any(x in t for x in ("map<", "variant", "interval"))]
    return kept.groupBy("_key", "_node").agg(F.min_by("_row", F.struct(*order, F.lit(0))).alias("first")).select("first.*")
