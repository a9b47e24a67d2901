"""The command line: `python -m cosmolith -file=IN -type=hist1D -x=3 ...`, each flag as -name or -name=value.

Columns are given by position. A text or binary table is read with columns c0, c1, ...; the result is written as text at
-output (default IN.out_X_Y; a * in it stands for IN's base name), or as a .bin file with -bw. Nothing is overwritten.
"""

from __future__ import annotations

import math
import os
import sys
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.functions import astro
from cosmolith.operators import aggregates as agg
from cosmolith.operators import binning, catalog, forest, grid, profiles, tree
from cosmolith.sources import legacy
from cosmolith.sources.profile_binary import read_profile_binary, with_masses

# The flags with what they are without being given, and the positions of the columns of a tree table.
WHOLE = {"x": 0, "y": 1, "binx": 0, "nbinsx": 0, "nbinsy": 0, "autotnum": -1, "id": 0, "use_rw": -1, "points_per_cell": 3, "dim": 0}
REAL = {"share_lo": 0.0, "share_hi": 100.0, "binwidthx": 0.0, "binwidthy": 0.0, "exrad": 0.0, "slen": 1.0, "mstar": -1.0, "box": 250.0}
SWITCH = ["br", "bw", "logx", "logy", "logz", "logbinx", "norm", "smooth", "rank", "cdf", "massfunc", "use_percentiles_x", "use_percentiles_y", "mmp", "profiles", "scatter"]
TEXT = {"file": "", "output": "", "mergeTo": "", "type": "", "otherparam": "", "nbins": "1", "autobin": "true"}
TREE = {
    "epoch": 0, "id": 1, "desc_id": 3, "upid": 6, "mass": 10, "rvir": 11, "rs": 12, "almm": 15, "vmax": 16, "x": 17, "y": 18, "z": 19, "vx": 20, "vy": 21, "vz": 22, "lambda": 26, "tf": 35, "rs_klypin": 37,
    "xoff": 43, "voff": 44, "spin": 45, "b_to_a": 46, "c_to_a": 47, "ax": 48, "ay": 49, "az": 50, "b_to_a500": 51, "c_to_a500": 52, "tu": 56,
}
VIEWED = [c for c in TREE if c not in ("upid", "ax", "ay", "az")]
SELECTED_EPOCHS = {0: 1.00231, 1: 0.50112}
MOVED = {"doReorderFields": [34, 35, 36, 75], "doReorderFields2": [79, 80, 81, 82]}
STACK_SCALES = {"c85": -2.5, "c86": -2.5, "c79": 1.0}
REFERENCE_EPOCH = 0.67325
STRIPPED = "c80"


def parse(argv: list[str]) -> dict:
    """Flags as a dict; an unknown or malformed one stops the run."""
    o = {**WHOLE, **REAL, **TEXT, **dict.fromkeys(SWITCH, False)}
    for arg in argv:
        name, given, value = arg.removeprefix("-").partition("=")
        name = "slen" if name == "smoothing_length" else name
        if not arg.startswith("-") or name not in o or (not given and name not in SWITCH):
            raise ValueError(f"not a flag: {arg!r}")
        o[name] = True if name in SWITCH else int(value) if name in WHOLE else float(value) if name in REAL else value
    binning.parse_thresholds(o["nbins"])
    return o


def read(spark: SparkSession, path: str, o: dict) -> DataFrame:
    """A table by its extension, or as .bin with -br; of text the first line that isn't a comment tells the columns."""
    kind = "bin" if o["br"] and not path.endswith((".bin", ".bin2")) else None
    if kind or path.endswith((".bin", ".bin2", ".parquet")):
        return legacy.read_catalogue(spark, path, kind=kind)
    first = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).first()
    return legacy.read_text(spark, path, [f"c{i}" for i in range(len(first[0].split()) if first else 0)])


def forest_of(df: DataFrame) -> DataFrame:
    """The columns of a tree table by their positions, ids as integers."""
    have = {n: f"c{i}" for n, i in TREE.items() if f"c{i}" in df.columns}
    return df.select(*(F.col(c).cast("long" if n in ("id", "desc_id", "upid") else "double").alias(n) for n, c in have.items()))


def output_name(o: dict) -> str:
    base = os.path.basename(o["file"])
    return o["output"].replace("*", base) if o["output"] else f"{o['file']}.out_{o['x']}_{o['y']}"


def _cube(spark: SparkSession, path: str, o: dict) -> tuple[DataFrame, int]:
    dim = o["dim"] or round((os.path.getsize(path) / 8) ** (1 / 3))
    return legacy.read_cube(spark, path, dim), dim


def _bins(df: DataFrame, c: str, width: float, count: int) -> int | None:
    return agg.bins_of_width(df, c, width) if width > 0 else count or None


def _percent(df: DataFrame, c: str) -> DataFrame:
    """df with c replaced by the percentage of rows below it, ties by the other columns."""
    return agg.percent_ranks(df, c, [x for x in df.columns if x != c], c)


def _hist1d(df: DataFrame, o: dict, by: list[str] | None = None) -> DataFrame:
    n = _bins(df, o["cx"], o["binwidthx"], o["nbinsx"])
    if o["autobin"] == "true" and not by and o["autotnum"] > 0:
        return agg.hist1d_adaptive(df, o["cx"], n or agg.default_bins(df.count()), o["autotnum"])
    out = agg.hist1d(df, o["cx"], n, norm=o["norm"], by=by)
    if o["logz"] and not by:
        return agg.log_counts(out)
    return agg.mass_function(out, agg.effective_volume(o["share_lo"], o["share_hi"], o["box"])) if o["massfunc"] and o["norm"] else out


def _hist2d(df: DataFrame, o: dict) -> DataFrame:
    x, y = o["cx"], o["cy"]
    nx = _bins(df, x, o["binwidthx"], o["nbinsx"]) or agg.default_bins(df.count())
    ny = _bins(df, y, o["binwidthy"], o["nbinsy"]) or nx
    if o["rank"]:
        df = _percent(_percent(df, x), y)
    if o["scatter"]:
        return agg.hist2d_scatter(df, x, y, nx, ny, o["points_per_cell"], df.columns).select(x, y, "z")
    return agg.hist2d(df, x, y, nx, ny, log=o["logz"], smooth=o["smooth"], norm=o["norm"])


def _median(df: DataFrame, o: dict, by: list[str] | None = None) -> DataFrame:
    """Percentages of x leave out stripped rows after they are ranked; those of y are of the statistics, but not of mad."""
    n = _bins(df, o["cx"], o["binwidthx"], o["nbinsx"]) or agg.default_bins(df.count())
    if o["use_percentiles_x"] and not by:
        keep = F.coalesce(F.col(STRIPPED) <= 0.98, F.lit(True)) if STRIPPED in df.columns else None
        out = agg.percent_median(df, o["cx"], o["cy"], n, [c for c in df.columns if c != o["cx"]], keep)
    else:
        out = agg.binned_median(df, o["cx"], o["cy"], n, (o["autotnum"] if o["autotnum"] > 0 else n) if o["autobin"] == "true" else None, by)
    return agg.placed(out, df, o["cy"]) if o["use_percentiles_y"] else out


def _binned(df: DataFrame, o: dict) -> DataFrame:
    return binning.assign_bins(df, o["cb"], binning.bin_edges(df, o["cb"], o["nbins"]))


def _in_bins(df: DataFrame, o: dict) -> DataFrame:
    """df's rows in each bin of binx, as file_bin. With use_rw the bins are read from the files that hold them, which are
    named as the output with _BIN_rwNUMBER before the extension."""
    if o["use_rw"] < 0:
        return _binned(df, o).drop("lo", "hi").withColumnRenamed("bin_id", "file_bin")
    stem, dot, end = o["output"].rpartition(".")
    count, out = len(binning.bin_edges(df, o["cb"], o["nbins"])), None
    for i in range(count):
        rows = read(df.sparkSession, f"{stem}_{i}_rw{o['use_rw']}{dot}{end}", o).withColumn("file_bin", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def _binned_hist2d(df: DataFrame, o: dict) -> DataFrame:
    rows, x, y = _in_bins(df, o), o["cx"], o["cy"]
    nx = _bins(df, x, o["binwidthx"], o["nbinsx"]) or agg.default_bins(df.count())
    return agg.hist2d(rows, x, y, nx, _bins(df, y, o["binwidthy"], o["nbinsy"]) or nx, log=o["logz"], smooth=o["smooth"], norm=o["norm"], by=["file_bin"])


def _each_bin(operator: Callable, df: DataFrame, o: dict) -> DataFrame:
    """The operator over each bin of binx; there are as many as the thresholds name."""
    rows, out = _in_bins(df, o), None
    for i in range(len(binning.bin_edges(df, o["cb"], o["nbins"]))):
        found = operator(rows.where(F.col("file_bin") == i).drop("file_bin"), o).withColumn("file_bin", F.lit(i))
        out = found if out is None else out.unionByName(found)
    return out


def _voxels(spark: SparkSession, path: str, o: dict) -> DataFrame:
    """A cube of structure ids as positions at the voxels' centres."""
    cube, dim = _cube(spark, path, o)
    cell = o["box"] / dim
    return cube.where("v > -1").select(F.col("v").cast("long").alias("structure"), *((F.col(f"i{a}") + 0.5).alias(a) * cell for a in "xyz")).toDF("structure", "x", "y", "z")


def _density(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    cube, dim = _cube(spark, o["mergeTo"], o)
    at = {a: F.col(f"c{TREE[a]}") for a in "xyz"}
    return grid.lookup(df.withColumns(at), cube, o["box"], dim).drop("ix", "iy", "iz", "x", "y", "z")


def _smooth(spark: SparkSession, df: DataFrame | None, o: dict) -> DataFrame:
    cube, dim = _cube(spark, o["file"], o)
    return grid.smooth(cube, dim, 2 * o["slen"] * dim / o["box"])


def _voxel_hist(spark: SparkSession, df: DataFrame | None, o: dict) -> DataFrame:
    cube, _ = _cube(spark, o["file"], o)
    return agg.hist1d(cube.withColumn("log_v", astro.safe_log10("v")), "log_v", o["nbinsx"] or 100)


def _zip(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    """Files of one column each, joined to the catalogue by row."""
    return catalog.zipped(df, [read(spark, path, o).select("row_idx", F.col("c0").alias(f"added_{i}")) for i, path in enumerate(o["mergeTo"].split(","))])


def _stack(spark: SparkSession, df: DataFrame | None, o: dict) -> DataFrame:
    """-file=z:path,z:path ..."""
    pairs = [p.split(":", 1) for p in o["file"].split(",")]
    frames = {float(z): read(spark, path, o) for z, path in pairs}
    return catalog.stack(frames, {c: p for c, p in STACK_SCALES.items() if all(c in f.columns for f in frames.values())})


def _matched(df: DataFrame, o: dict) -> DataFrame:
    n = max(1, df.count())
    nx = agg.default_bins(n)
    ny = 2 * agg.default_bins(max(1, n // nx))
    rows = _percent(_percent(df.withColumns({"_px": F.col(o["cx"]), "_py": F.col(f"c{TREE['mass']}")}), "_px"), "_py")
    rows = binning.bucket(binning.bucket(rows, "_px", nx, 0.0, 100.0, "_ix"), "_py", ny, 0.0, 100.0, "_iy")
    return agg.match_downsample(rows, "_ix", "_iy", f"c{TREE['id']}", nx).drop("_ix", "_iy", "_px", "_py")


def _profiles(spark: SparkSession, o: dict) -> DataFrame:
    found = read_profile_binary(spark, o["file"]) if o["br"] or o["file"].endswith(".bin") else legacy.read_profiles(spark, o["file"])
    return with_masses(found)


def _stacked_profiles(spark: SparkSession, df: DataFrame | None, o: dict) -> DataFrame:
    rows = _profiles(spark, o).where(F.size("radii") > 1)
    r = rows.agg(F.min(F.array_min(F.filter("radii", lambda r: r > 0))), F.max(F.array_max("radii"))).first()
    wanted = read(spark, o["mergeTo"], o).select(F.col(f"c{TREE['id']}").cast("long").alias("id")) if o["mergeTo"] else rows.select("id")
    return profiles.stack_profiles(rows, wanted, o["nbinsx"] or 2000, r[0], r[1])


def _history(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    """Of every property of a tree table that it has; high spin is over the median of step 0."""
    n = forest.accreted(forest_of(df))
    steps = {r[0]: i for i, r in enumerate(sorted(n.select("epoch").distinct().collect(), key=lambda r: -r[0]))}
    at = spark.createDataFrame(list(steps.items()), "epoch double, step int")
    rows = forest.dynamical_rates(n.join(F.broadcast(at), "epoch"))
    middle = binning.order_values(rows.where("step = 0"), "spin", lambda k: [k // 2])
    rows = forest.properties(rows).withColumn("zed", astro.redshift("epoch"))
    rows = rows.withColumn("highspin", (F.col("lambdap") > F.lit(middle[0] if middle else 0.0)).cast("int"))
    t, have = forest.Table(), rows.columns
    rows = rows if t.merger in have else rows.withColumn(t.merger, F.lit(-1.0))
    table = forest.Table(ordered=tuple(c for c in t.ordered if c in have), means=tuple(c for c in t.means if c in have), mobile=tuple(c for c in t.mobile if c in have))
    main = rows.join(rows.where("step = 0").select("track_head"), "track_head", "left_semi")
    return forest.history_table(main, "track_head", "step", "zed", table)


def _viewer(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    n = forest_of(df)
    a, b = astro.rotation("ax", "ay", "az")
    return n.select(*VIEWED, a.alias("xrot"), b.alias("zrot"))


def _numbered(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    order = "row_idx" if "row_idx" in df.columns else "_order"
    rows = df if order == "row_idx" else df.withColumn("_order", F.monotonically_increasing_id())
    top = rows.agg(F.max("c0")).first()[0]
    return legacy.number_trees(rows, order, "c0", top).drop("_order")


def _window(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    mass = f"c{TREE['mass']}"
    trees = read(spark, o["mergeTo"], o)
    return catalog.mass_window(df, mass, catalog.select_epoch(trees, "c0", REFERENCE_EPOCH), mass, f"c{TREE['id']}")


def _nearest(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    points = forest_of(df).select("id", "x", "y", "z")
    return grid.nearest_structure(points, _voxels(spark, o["mergeTo"], o), o["box"])


def _full(spark: SparkSession, df: DataFrame, o: dict) -> DataFrame:
    epoch = SELECTED_EPOCHS.get(o["x"], 1.00231)
    objects = df.withColumn("id", F.col(f"c{TREE['id']}").cast("long"))
    return forest.full_run(objects, forest_of(read(spark, o["mergeTo"], o)), epoch)


def _moments(df: DataFrame, o: dict) -> DataFrame:
    return agg.medians(df, [o["cx"], o["cy"]])


TREE_WALK = lambda s, d, o: tree.tree_walk(forest_of(read(s, o["mergeTo"], o)), forest_of(d).select("id"), mmp_only=o["mmp"])
MERGE = lambda s, d, o: catalog.merge(read(s, o["mergeTo"], o), d, f"c{TREE['id']}")

TYPES: dict[str, Callable] = {
    "hist1D": lambda s, d, o: _hist1d(d, o), "hist2D": lambda s, d, o: _hist2d(d, o), "avg": lambda s, d, o: agg.binned_avg(d, o["cx"], o["cy"], _bins(d, o["cx"], o["binwidthx"], o["nbinsx"]) or agg.default_bins(d.count())),
    "median": lambda s, d, o: _median(d, o), "bin": lambda s, d, o: _binned(d, o), "binnedHist1D": lambda s, d, o: _each_bin(_hist1d, d, o), "binnedHist2D": lambda s, d, o: _binned_hist2d(d, o),
    "binnedMedian": lambda s, d, o: _median(_in_bins(d, o), o, ["file_bin"]), "toBin": lambda s, d, o: d, "toAscii": lambda s, d, o: d, "treeWalk": TREE_WALK, "merge": MERGE,
}

OTHER: dict[str, Callable] = {
    "": lambda s, d, o: d, "gaussianSmoothDensity": _smooth, "doCalcVoxelDensityDistributions": _voxel_hist, "combineHlistFiles": _zip, "buildDensityCatalog": _density,
    "addFieldToCatalog": lambda s, d, o: catalog.derived_epochs(d, o["cb"], o["cx"], o["cy"]), "stackCatalogs": _stack, "rankCorrelation": lambda s, d, o: agg.spearman(d, o["cx"], o["cy"], [c for c in d.columns if c not in (o["cx"], o["cy"])]),
    "genPlotStats": lambda s, d, o: _moments(d, o), "doProgenitorHistory": _history, "doDensityPercentileEvolution": _window, "doReweightMassDistribution": lambda s, d, o: _matched(d, o),
    "doStackProfiles": _stacked_profiles, "doSelectZ": lambda s, d, o: catalog.select_epoch(d, "c0", SELECTED_EPOCHS.get(o["x"], 0.0)), "doConvertMergerTracks": lambda s, d, o: forest.exported(forest_of(d), VIEWED),
    "doTreeAnalysis": lambda s, d, o: forest.branch_fields(forest_of(d)), **{k: partial(lambda at, s, d, o: catalog.move_last(d, [f"c{i}" for i in at]), v) for k, v in MOVED.items()},
    "doSpineTest": lambda s, d, o: catalog.spine_slab(d.withColumns({a: F.col(f"c{TREE[a]}") for a in "xyz"}), read(s, o["mergeTo"], o), "row_idx"), "doSpineCatalogAnalysis": _nearest,
    "doConvertToVizFormat": _viewer, "doIndvHaloTracks": _numbered, "doFullTreeAnalysis": _full,
}

NO_TABLE = {"gaussianSmoothDensity", "doCalcVoxelDensityDistributions", "stackCatalogs", "doStackProfiles"}
BY_COLUMN = {"bin": "bin_id", "doIndvHaloTracks": "tree_id"}


def result(spark: SparkSession, o: dict) -> DataFrame:
    """What a parsed command line asks for, not yet written."""
    o = o | {"cx": f"c{o['x']}", "cy": f"c{o['y']}", "cb": f"c{o['binx']}"}
    if o["profiles"] and o["otherparam"] != "doStackProfiles":
        return profiles.fit_profiles(_profiles(spark, o))
    table = OTHER if o["type"] == "other" else TYPES
    kind = o["otherparam"] if o["type"] == "other" else o["type"]
    if kind not in table:
        raise ValueError(f"not a type: {kind!r}; there are {', '.join(sorted(k for k in table if k))}")
    df = None if kind in NO_TABLE else read(spark, o["file"], o)
    if df is not None:
        logged = {o[c] for flag, c in (("logx", "cx"), ("logy", "cy"), ("logbinx", "cb")) if o[flag]}
        df = df.withColumns({c: astro.safe_log10(c) for c in logged}) if logged else df
    return table[kind](spark, df, o)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command line and returns the path that was written."""
    o = parse(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("cosmolith").getOrCreate()
    out, to = result(spark, o), output_name(o)
    by = BY_COLUMN.get(o["otherparam"] if o["type"] == "other" else o["type"])
    if os.path.exists(to):
        raise FileExistsError(to)
    if by:
        legacy.write_by(out, to, by, limit=o["x"] if by == "tree_id" and o["x"] > 0 else None)
    elif o["bw"] and o["otherparam"] == "gaussianSmoothDensity":
        legacy.write_cube(out, to, _cube(spark, o["file"], o)[1])
    elif o["bw"] or o["type"] == "toBin":
        legacy.write_bin(out.drop("row_idx"), to, rows=to.endswith(".bin2"))
    else:
        legacy.write_text(out.drop("row_idx"), to)
    return to
