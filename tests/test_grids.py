"""Grids against plain versions: nearest voxels in dense boxes, structures across faces, wide kernels."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cosmolith.operators import grid


def plain_nearest(points, voxels, box):
    sizes = {}
    for s, *_ in voxels:
        sizes[s] = sizes.get(s, 0) + 1
    gap = lambda a, b: min(abs(a - b), box - abs(a - b))
    return {i: min((gap(x, v[1]) ** 2 + gap(y, v[2]) ** 2 + gap(z, v[3]) ** 2, -sizes[v[0]], v[0]) for v in voxels if v[0] > -1) for i, x, y, z in points}


@pytest.mark.parametrize("kind", ["even", "dense", "one place", "few"])
def test_nearest_structure(spark, kind):
    rng = random.Random(kind)
    spread = {"even": lambda: rng.uniform(0, 10), "dense": lambda: rng.choice([rng.uniform(0, 10), 9.99 + rng.uniform(0, 0.009)]), "one place": lambda: 3.0, "few": lambda: rng.uniform(0, 10)}[kind]
    voxels = [(rng.randint(-1, 4), spread(), spread(), spread()) for _ in range(3 if kind == "few" else 900)] + [(2, 5.0, 5.0, 5.0), (3, 0.0, 10.0, 9.999)]
    points = [(i, rng.uniform(0, 10), rng.uniform(0, 10), rng.choice([0.001, 9.999, rng.uniform(0, 10)])) for i in range(80)]
    p = spark.createDataFrame(points, "id int, x double, y double, z double")
    v = spark.createDataFrame(voxels, "structure int, x double, y double, z double")
    want = plain_nearest(points, voxels, 10.0)
    got = {r.id: r for r in grid.nearest_structure(p, v, 10.0).collect()}
    assert set(got) == set(want)
    for i, (d2, size, s) in want.items():
        assert got[i].dist == pytest.approx(math.sqrt(d2)) and got[i].structure == s


def test_a_point_carries_few_boxes(spark):
    """In a box of 20 times the voxels a point is held against as many boxes and voxels, but for a level of the tree."""
    rng = random.Random(3)
    for n in (2_000, 40_000):
        v = spark.createDataFrame([(1, *(rng.uniform(4, 5) for _ in "xyz")) for _ in range(n)], "structure int, vx double, vy double, vz double")
        levels, leaves = grid.box_tree(v)
        sizes = [r["count"] for r in leaves.groupBy("node").count().collect()]
        assert max(sizes) <= grid.LEAF and sum(sizes) == n
        assert sum(x.count() for x in levels) < n / 4


def test_structures_across_faces(spark):
    rng, dim = random.Random(7), 16
    rows = []
    for s in range(12):
        at = [rng.choice([0, 5, 12, 15]) for _ in range(3)]
        wide = [rng.choice([1, 3, 9, 16]) for _ in range(3)]
        rows += [(s, *((a + rng.randrange(w)) % dim for a, w in zip(at, wide))) for _ in range(rng.choice([1, 4, 60]))]
    rows += [(50, x, 3, 3) for x in range(dim)] + [(51, 0, 3, 3), (51, 15, 3, 3), (51, 15, 4, 3), (-1, 1, 1, 1)]
    got = {r.structure: r for r in grid.structure_extents(spark.createDataFrame(rows, "structure int, ix int, iy int, iz int"), 2.0, dim).collect()}
    assert set(got) == {r[0] for r in rows if r[0] > -1}
    for s, r in got.items():
        volume = 8.0
        for a in range(3):
            own = sorted(x[a + 1] for x in rows if x[0] == s)
            center = lambda v: math.ceil(sum(v) / len(v) - 0.5)
            if own[-1] - own[0] == dim - 1:
                kinds = sorted(set(own))
                gap, edge = max((b - c, -b) for c, b in zip(kinds, kinds[1:]))
                cut = -edge if gap > 1 else dim // 2
                own = sorted(i + dim * (i < cut) for i in own) if center(own) >= dim // 2 else sorted(i - dim * (i >= cut) for i in own)
            median = int((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)
            name = ("ix", "iy", "iz")[a]
            assert [r[f"{k}_{name}"] for k in ("center", "median", "min", "max")] == [center(own), median, own[0], own[-1]]
            volume *= own[-1] - own[0]
        assert r.volume == pytest.approx(volume) and r.n == len(own)


@pytest.mark.parametrize(("reach", "dim"), [(2, 6), (5, 6)])
def test_local_density(spark, reach, dim):
    """Against the stencil, also where offsets go around the box."""
    rng, fwhm = random.Random(1), 2.0
    cube = {(rng.randrange(dim), rng.randrange(dim), rng.randrange(dim)): float(rng.randint(1, 9)) for _ in range(40)}
    points = [(i, *(rng.uniform(0, dim) for _ in "xyz")) for i in range(30)]
    s2 = 2 * (fwhm / (2 * math.sqrt(2 * math.log(2)))) ** 2
    offsets = [(i, j, k) for i in range(-reach, reach) for j in range(-reach, reach) for k in range(-reach, reach) if (i, j, k) != (0, 0, 0)]
    w = {o: math.exp(-sum(x * x for x in o) / s2) for o in offsets}
    want = {i: sum(w[o] * cube.get(tuple((int(p) + d) % dim for p, d in zip(at, o)), 0.0) for o in offsets) / sum(w.values()) for i, *at in points}
    p = spark.createDataFrame(points, "id int, x double, y double, z double")
    c = spark.createDataFrame([(*k, v) for k, v in cube.items()], "ix int, iy int, iz int, v double")
    got = {r.id: r.local_density for r in grid.local_density(p, c, float(dim), dim, reach, fwhm).collect()}
    assert got == pytest.approx(want)
    mean = grid.smooth(c, dim, 2.0).agg(F.sum("v")).first()[0] / dim**3
    assert mean == pytest.approx(1)


def test_copies_of_a_voxel_open_no_boxes(spark, monkeypatch):
    """Voxels at one place are one: they were divided down to the deepest level, and each was met by each point."""
    made, plain = [], grid.box_tree
    monkeypatch.setattr(grid, "box_tree", lambda v: made.append((v.count(), plain(v))) or made[-1][1])
    voxels = spark.createDataFrame([(i % 3, 1.0 + i % 2, 1.0, 1.0) for i in range(400)] + [(2, 1.0, 1.0, 1.0)] * 5, "structure int, x double, y double, z double")
    points = spark.createDataFrame([(1, 0.5, 1.0, 1.0), (2, 9.5, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {r.id: (r.structure, r.vx, r.dist) for r in grid.nearest_structure(points, voxels, 10.0).collect()}
    assert got == {1: (2, 1.0, 0.5), 2: (2, 1.0, 1.5)}
    assert made[0][0] == 2 and len(made[0][1][0]) == 1
