"""Operator 11 against a plain integer version, on given vectors and on odd tables."""

import hashlib

import numpy as np
import pytest

from cosmolith.llm.vector_codes import LIMIT, compress, decode, nearest, op11_vector_codes, with_label_error


def plain(vectors, parts=4, entries=256, rounds=4):
    """(codes, errors, codebooks) of integer vectors in order of id, by all distances in Python's integers."""
    k = len(vectors[0]) // parts
    cut = [[tuple(v[p * k : p * k + k]) for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min(range(len(book)), key=lambda j: (far(x, book[j]), j))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for c in cut:
                got.setdefault(near(c[p], books[p]), []).append(c[p])
            for j, xs in got.items():
                books[p][j] = tuple(sum(x) // len(xs) for x in zip(*xs))
    at = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{j:02x}" for j in r) for r in at], [sum(far(c[p], books[p][j]) for p, j in enumerate(r)) for c, r in zip(cut, at)], books


@pytest.mark.parametrize(("k", "high", "n"), [(16, 600, 700), (16, 2, 500), (1, 4, 600), (40, LIMIT, 300), (3, LIMIT, 300)])
def test_nearest_is_exact(k, high, n):
    """Small components make ties, near-copies among the entries make intervals overlap, large ones strain the bound."""
    rng = np.random.default_rng(k)
    x, book = rng.integers(-high, high + 1, (n, k)), rng.integers(-high, high + 1, (256, k))
    book[128:] = np.clip(book[:128] + rng.integers(-1, 2, (128, k)), -LIMIT, LIMIT)
    x[:200] = book[:200]
    book[5] = 0  # entries of unlike size
    want = ((x[:, None, :].astype(object) - book[None]) ** 2).sum(2).argmin(1)
    assert nearest(x, book).tolist() == want.tolist()


def test_given_vectors(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    rows = [r for r in rows if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    codes, errors, books = plain([[int(np.floor(1024 * x)) for x in r.embedding] for r in rows])
    got = {r.vec_id: r for r in op11_vector_codes(spark, sf_dir).collect()}
    assert [(got[r.vec_id].code, got[r.vec_id].error) for r in rows] == list(zip(codes, errors)) and len(got) == len(rows)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()}
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r.label] = by_label.get(r.label, 0) + e
    assert all(got[r.vec_id].label_error == by_label[r.label] for r in rows)


SCHEMA = "vec_id long, embedding array<double>, label int, code int, error string, size int, n int, part int"


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.integers(-5, 6, 6) / 1024], i % 3 if i % 4 else None) for i in range(40)]
    odd = [(100, None, 1), (101, [nan] * 6, 1), (102, [inf] + [0.0] * 5, 1), (103, [None] + [0.0] * 5, 1)]  # dropped
    uncoded = [(104, [1.0, 2.0], 1), (105, [1e300] * 6, None), (106, [], 2)]  # of another length, or too large
    copies = [good[3], good[3], (None, good[5][1], 0), (None, good[6][1], None)]
    table = [(*r, 7, "x", 7, 7, 7) for r in good + odd + uncoded + copies]
    found = compress(spark.createDataFrame(table, SCHEMA).repartition(5), entries=16)
    got = with_label_error(found.rows).collect()
    ids = lambda rows: sorted((-1 if r[0] is None else r[0]) for r in rows)
    assert ids(got) == ids(good + uncoded + copies)
    kept = sorted(good + copies, key=lambda r: (r[0] is None, r[0] or 0))
    pad = lambda v: [int(np.floor(1024 * x)) for x in v] + [0, 0]
    codes, errors, books = plain([pad(r[1]) for r in kept], entries=16)
    want = sorted(((-1 if r[0] is None else r[0]), c, e) for r, c, e in zip(kept, codes, errors))
    assert sorted((-1 if r.id is None else r.id, r.code, r.error) for r in got if r.code is not None) == want
    assert [[tuple(map(int, e)) for e in b] for b in found.books] == [list(b) for b in books]
    assert all(r.error is None for r in got if r.id in (104, 105, 106))
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + (r.error or 0)
    assert all(r.label_error == sums[r.label] for r in got)
    back = decode(found.rows, found.books).collect()
    assert all((r.vector is None) == (r.code is None) for r in back)
    one = next(r for r in back if r.code is not None)
    assert one.vector[:2] == [v / 1024 for v in books[0][int(one.code[:2], 16)]]


def test_empty_and_partitioning(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert compress(none).rows.count() == 0
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    once = [sorted(map(tuple, compress(df.repartition(n), entries=32).rows.collect())) for n in (1, 7)]
    assert once[0] == once[1] and len(once[0]) == 300
