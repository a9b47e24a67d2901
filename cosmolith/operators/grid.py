"""Voxel grids: lookup, smoothing on a periodic box, and the nearest structure."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.astro import gaussian_kernel
from cosmolith.functions.segments import FEW
from cosmolith.functions.shared import ranked, with_groups, written

AXES = ("ix", "iy", "iz")


def voxelise(df: DataFrame, box: float, dim: int, position=("x", "y", "z")) -> DataFrame:
    """df with ix, iy, iz: floor(position / cell), held within the box."""
    cell = lambda c: F.greatest(F.least(F.floor(F.col(c) / F.lit(box / dim)), F.lit(dim - 1)), F.lit(0)).cast("int")
    return df.withColumns({a: cell(c) for a, c in zip(AXES, position, strict=True)})


def lookup(df: DataFrame, cube: DataFrame, box: float, dim: int, name: str = "density") -> DataFrame:
    """The cube's value v at each row's voxel."""
    return voxelise(df, box, dim).join(cube.select(*AXES, F.col("v").alias(name)), list(AXES), "left")


def cut(cube: DataFrame, axis: str = "iz", at: int = 0) -> DataFrame:
    """A plane of the cube: the other two indices and v."""
    return cube.where(F.col(axis) == at).drop(axis)


def smooth_axis(cube: DataFrame, axis: str, dim: int, kernel: list[tuple[int, float]]) -> DataFrame:
    """One periodic pass along an axis. A line of the cube (dim values at most) is gathered into a row, so a voxel is
    exchanged once a pass and not once a tap; lines are convolved in numpy, some at a time."""
    others = [a for a in AXES if a != axis]
    lines = cube.groupBy(*others).agg(F.collect_list(axis).alias("at"), F.collect_list(F.col("v").cast("double")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                b = batch.slice(lo, 256)
                at, v = b.column("at"), b.column("v")
                line = np.repeat(np.arange(len(b)), np.diff(at.offsets.to_numpy()))
                dense = np.zeros((len(b), dim))
                np.add.at(dense, (line, at.flatten().to_numpy()), v.flatten().to_numpy())
                out = sum(w * np.roll(dense, k, axis=1) for k, w in kernel)
                i, k = np.nonzero(out)
                made = {axis: k.astype(np.int32), "v": out[i, k], **{c: b.column(c).to_numpy()[i] for c in others}}
                yield pa.RecordBatch.from_pydict({c: made[c] for c in (*AXES, "v")})

    return lines.mapInArrow(run, "ix int, iy int, iz int, v double")


def smooth(cube: DataFrame, dim: int, fwhm: float, over_mean: bool = True) -> DataFrame:
    """Gaussian smoothing as three passes, over the mean of the dim**3 voxels if over_mean. Empty voxels may be left out.
    The kernel sums to 1 on a periodic box, so the mean is that of the input."""
    kernel, out = gaussian_kernel(fwhm), cube
    for axis in AXES:
        out = smooth_axis(out, axis, dim, kernel)
    if not over_mean:
        return out
    mean = cube.agg((F.sum("v") / float(dim**3)).alias("_m"))
    return out.crossJoin(F.broadcast(mean)).select(*AXES, (F.col("v") / F.col("_m")).alias("v"))  # one row


def local_density(df: DataFrame, cube: DataFrame, box: float, dim: int, reach: int, fwhm: float) -> DataFrame:
    """Kernel-weighted cube around each row's voxel, without the voxel itself, over offsets [-reach, reach) on each axis.

    The kernel is a product over the axes, so the whole sum is three passes along lines, and the voxel's own term is then
    taken off: a voxel is exchanged three times, whatever the reach. The last pass is over the rows' own lines only.
    """
    s2 = 2 * (fwhm / (2 * math.sqrt(2 * math.log(2)))) ** 2
    taps = [(d, math.exp(-d * d / s2)) for d in range(-reach, reach)]
    total = sum(w for _, w in taps) ** 3 - 1
    kernel = [(-d, w) for d, w in taps]  # a line is moved back by d to bring what stands d on to a voxel
    rows = voxelise(df, box, dim)
    near = smooth_axis(smooth_axis(cube, "ix", dim, kernel), "iy", dim, kernel)
    near = smooth_axis(near.join(rows.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi"), "iz", dim, kernel)
    around = near.select(*AXES, F.col("v").alias("_around"))
    own = cube.select(*AXES, F.col("v").cast("double").alias("_own"))
    cells = rows.select(*AXES).distinct().join(around, list(AXES), "left").join(own, list(AXES), "left")  # a voxel's sum is looked up once
    density = (F.coalesce("_around", F.lit(0.0)) - F.coalesce("_own", F.lit(0.0))) / total
    return rows.join(cells.select(*AXES, F.greatest(density, F.lit(0.0)).alias("local_density")), list(AXES))


def structures(voxels: DataFrame, cell: float) -> DataFrame:
    """Per structure: count, mean and integer-division centroid, bounding box, volume and radius."""
    mean = [F.avg(a).alias(f"mean_{a}") for a in AXES]
    whole = [F.floor(F.sum(a) / F.count("*")).cast("int").alias(f"center_{a}") for a in AXES]
    ends = [f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    out = voxels.where("structure > -1").groupBy("structure").agg(F.count("*").alias("n"), *mean, *whole, *ends)
    extent = F.lit(1.0)
    for a in AXES:
        extent = extent * (F.col(f"max_{a}") - F.col(f"min_{a}"))
    return out.withColumn("volume", extent * cell**3).withColumn("radius", cell * F.sqrt("n") / F.lit(3.141592653589793))


def structure_extents(voxels: DataFrame, cell: float, dim: int) -> DataFrame:
    """Per structure on a periodic box: n, and on each axis the rounded mean (center), the median and the ends (min, max) of its
    voxels; the volume of its ends and its radius.

    A structure that lies at both faces of an axis crosses it, and is put together again: its largest gap tells the part at
    the low face from that at the high one (the middle of the box does if it fills the axis), and the part that is farther from
    the mean is moved by the box, so ends may be below 0 or above dim. All is read off counts of voxels by structure, axis and
    index, so a structure of a third of all voxels is dim rows an axis.
    """
    axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("int").alias("i")) for a in AXES)))
    c = voxels.where("structure > -1").select("structure", axes.alias("s")).groupBy("structure", "s.axis", "s.i").agg(F.count("*").alias("n"))
    by = Window.partitionBy("structure", "axis")
    c = c.withColumn("_gap", F.col("i") - F.lag("i").over(by.orderBy("i")))
    mean = lambda i: F.ceil(F.sum(i * F.col("n")).over(by) / F.sum("n").over(by) - 0.5)
    c = c.withColumns({"_wide": F.max("_gap").over(by), "_edge": F.max_by("i", F.struct("_gap", -F.col("i"))).over(by), "_mean": mean(F.col("i")), "_across": F.max("i").over(by) - F.min("i").over(by) == dim - 1})
    low = F.col("i") < F.when(F.coalesce(F.col("_wide"), F.lit(1)) > 1, F.col("_edge")).otherwise(dim // 2)
    moved = F.when(~F.col("_across"), 0).when((F.col("_mean") >= dim // 2) & low, dim).when((F.col("_mean") < dim // 2) & ~low, -dim).otherwise(0)
    c = c.select("structure", "axis", "n", (F.col("i") + moved).alias("i"))
    run, all_ = F.sum("n").over(by.orderBy("i")), F.sum("n").over(by)
    c = c.withColumns({"_run": run, "_all": all_, "center": mean(F.col("i"))})
    at = lambda r: F.max(F.when((F.col("_run") - F.col("n") <= r) & (r < F.col("_run")), F.col("i")))
    half = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    rows = c.groupBy("structure", "axis").agg(F.max("_all").alias("n"), F.max("center").cast("int").alias("center"), half.cast("int").alias("median"), F.min("i").alias("min"), F.max("i").alias("max"))
    pick = lambda a, k: F.max(F.when(F.col("axis") == a, F.col(k))).alias(f"{k}_{a}")
    out = rows.groupBy("structure").agg(F.max("n").alias("n"), *(pick(a, k) for a in AXES for k in ("center", "median", "min", "max")))
    volume = F.lit(cell**3)
    for a in AXES:
        volume = volume * (F.col(f"max_{a}") - F.col(f"min_{a}"))
    return out.withColumn("volume", volume).withColumn("radius", cell * F.sqrt("n") / F.lit(math.pi))


LEAF = 64  # voxels that a box of the tree is not divided under
BITS, DEEPEST = 2, 16  # each level divides an axis by 2 ** BITS; at DEEPEST bits a box is a leaf, whatever it holds


def _apart(p: Column, lo: Column, hi: Column, box: float) -> Column:
    """The least distance on a periodic axis from p to an interval."""
    return F.least(*(F.greatest(lo - (p + s), (p + s) - hi, F.lit(0.0)) for s in (-box, 0.0, box)))


def box_tree(voxels: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, leaves) of a tree of boxes over voxels(vx, vy, vz, ...), each axis of a box cut in 2 ** BITS, from their bounds on.

    levels[d]: parent, node (numbers of boxes), leaf, the box's voxels' own bounds and one of them. leaves: the voxels
    with the node of their leaf. A box of at most LEAF voxels is a leaf; only voxels of larger ones go on to the next level.
    """
    cells = 1 << DEEPEST
    ends = voxels.agg(*(f(f"v{a}").cast("double") for a in "xyz" for f in (F.min, F.max))).first()
    lo, wide = {a: ends[2 * i] or 0.0 for i, a in enumerate("xyz")}, {a: (ends[2 * i + 1] or 0.0) - (ends[2 * i] or 0.0) or 1.0 for i, a in enumerate("xyz")}
    place = lambda a: F.greatest(F.least(F.floor((F.col(f"v{a}") - lo[a]) / wide[a] * cells), F.lit(cells - 1)), F.lit(0)).cast("long")
    left, levels = voxels.withColumns({f"_{a}": place(a) for a in "xyz"}).withColumn("node", F.lit(None).cast("long")), []

    def box(depth: int) -> Column:
        """The box at a depth: a leading 1, then as many bits of each axis."""
        part = lambda a, k: F.shiftright(f"_{a}", DEEPEST - depth) * (1 << depth * k)
        return F.lit(1 << 3 * depth) + part("x", 2) + part("y", 1) + part("z", 0)

    for depth in range(BITS, DEEPEST + 1, BITS):
        found = [f(f"v{a}").alias(f"_{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
        at = written(left.where("node is null").groupBy(box(depth - BITS).alias("parent"), box(depth).alias("node")).agg(F.count("*").alias("_n"), F.min(F.struct("vx", "vy", "vz")).alias("_one"), *found))
        leaf = (F.col("_n") <= LEAF) | F.lit(depth == DEEPEST)
        boxes, most = at.agg(F.count("*"), F.max("_n")).first()
        near = F.broadcast if boxes <= FEW else (lambda x: x)
        levels.append(near(at.select("parent", "node", leaf.alias("leaf"), "_one", *(f"_{n}{a}" for a in "xyz" for n in ("lo", "hi")))))
        closed = near(at.where(leaf).select(F.col("node").alias("_closed")))
        left = left.withColumn("_box", F.when(F.col("node").isNull(), box(depth))).join(closed, F.col("_box") == F.col("_closed"), "left")
        left = left.withColumn("node", F.coalesce("node", "_closed")).drop("_box", "_closed")
        if (most or 0) <= LEAF:
            break
        if depth % (4 * BITS) == 0:  # some levels are one plan
            left = written(left)
    return levels, written(left.select(*voxels.columns, "node"))


def nearest_structure(points: DataFrame, voxels: DataFrame, box: float) -> DataFrame:
    """Per point(id, x, y, z): dist to, position and structure of the nearest voxel(structure, x, y, z) on the periodic box.

    A point goes down a tree of boxes, all boxes of a level at a time. Of each it knows how near its voxels can be, by their
    bounds, and of one voxel how far it is; the least of those bounds the search, and boxes beyond it are left before they
    are opened. So a point carries a few boxes from level to level, however dense the voxels, and meets voxels in the last
    ones only: first those of its nearest leaf, which bound the others. Voxels at one place are one, that of the structure
    that ties go to. Exact; ties go to the structure of more voxels, then the least id. Ids must not repeat.
    """
    size = voxels.where("structure > -1").groupBy("structure").agg((-F.count("*")).alias("_less"))
    places = written(ranked(size, ["_less", "structure"], "_rank").select("structure", "_rank"))
    v = with_groups(voxels.where("structure > -1"), places, ["structure"])
    v = v.groupBy(*(F.col(a).cast("double").alias(f"v{a}") for a in "xyz")).agg(F.min("_rank").alias("_rank"))
    levels, leaves = box_tree(written(v))

    def squared(there) -> Column:
        out = F.lit(0.0)
        for a in "xyz":
            d = F.abs(F.col(a) - F.col(there(a)))
            out = out + F.pow(F.least(d, F.lit(box) - d), F.lit(2.0))
        return out

    near = squared(lambda a: f"v{a}")
    least = sum((F.pow(_apart(F.col(a), F.col(f"_lo{a}"), F.col(f"_hi{a}"), box), F.lit(2.0)) for a in "xyz"), F.lit(0.0))
    # Rows with few bytes meet many boxes or voxels, so they are dealt to a fixed number of tasks that isn't coalesced. Each
    # level is met twice, for the bound (a number, summed up by hash where it is met) and for the boxes within it: no task
    # holds or exchanges the others.
    spark = points.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))
    open_ = written(points.select("id", "x", "y", "z", F.lit(1).cast("long").alias("parent"), F.lit(float("inf")).alias("_bound")))
    held = []  # leaves that a point may have to look into, by level
    for boxes in levels:
        met = lambda rows: rows.repartition(n, "id", "parent").join(boxes, "parent").withColumn("_least", least).where("_least <= _bound")  # noqa: B023, E731
        bound = met(open_).groupBy("id").agg(F.min(F.least("_bound", squared(lambda a: f"_one.v{a}") * (1 + 1e-9))).alias("_bound"))
        kept = written(met(open_.drop("_bound").join(bound, "id")).select("id", "x", "y", "z", "node", "leaf", "_least", "_bound"))
        held.append(kept.where("leaf").drop("leaf"))
        open_ = kept.where("not leaf").select("id", "x", "y", "z", F.col("node").alias("parent"), "_bound")
    by = Window.partitionBy("id")  # over a point's few leaves
    leaf = reduce(DataFrame.unionByName, held).withColumn("_bound", F.min("_bound").over(by)).where("_least <= _bound")
    held = written(leaf.withColumn("_nth", F.row_number().over(by.orderBy("_least", "node"))).drop("_bound"))
    inside = lambda rows: rows.repartition(n, "node").join(leaves, "node").withColumn("_d2", near)
    first = inside(held.where("_nth = 1")).groupBy("id").agg(F.min("_d2").alias("_most"))  # a number, so it is summed up by hash
    few = inside(held.join(first, "id").where("_least <= _most * (1 + 1e-9)")).where("_d2 <= _most")
    best = few.groupBy("id").agg(F.first(F.struct("x", "y", "z")).alias("p"), F.min(F.struct(F.col("_d2").alias("d2"), "_rank", "vx", "vy", "vz")).alias("b"))
    found = best.select("id", "p.x", "p.y", "p.z", F.sqrt("b.d2").alias("dist"), "b.vx", "b.vy", "b.vz", F.col("b._rank").alias("_rank"))
    return with_groups(found, places, ["_rank"]).drop("_rank")
