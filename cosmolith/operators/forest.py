"""Whole forests: histories of the nodes, the fields a main branch gains, tables over epochs, and the full run.

A forest is an edge table as in `tree`. Loops run over epochs; each epoch's nodes meet only the nodes that descend into
it, in joins and aggregates by id, and are written, so a lost executor costs one epoch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions import astro
from cosmolith.functions.shared import ranked, written
from cosmolith.operators import catalog, tree
from cosmolith.operators.aggregates import order_stats


@dataclass(frozen=True)
class Names:
    """What the columns of a forest are called."""

    epoch: str = "epoch"
    mass: str = "mass"
    tide: str = "tf"
    spin: str = "spin"
    heat: str = "tu"
    last_merger: str = "almm"


HISTORY = ["mpeak", "a_mpeak", "maxtf_peak", "a_maxtf_peak", "min_bsr_peak", "a_min_bsr_peak", "min_bsr_lmm", "a_min_bsr_lmm", "spin_peak", "tu_peak", "mass_lost_as_sub", "mass_lost_peak"]

#: The fields that a main branch gains, in their order.
APPENDED = ["mpeak", "a_mpeak", "mdot_dyn", "npt", "high_tf", "maxtf_peak", "a_maxtf_peak", "min_bsr_peak", "a_min_bsr_peak", "min_bsr_lmm", "a_min_bsr_lmm", "spin_peak", "tu_peak", "mass_lost_mpeak"]


def _grown(n: Names) -> dict[str, Column]:
    """A node's history from that of its progenitors (_p, null for a leaf) and its main progenitor (_m)."""
    p, mass, at = (lambda c: F.col(f"_p.{c}")), F.col(n.mass), F.col(n.epoch)
    new = F.col("_p").isNull() | (mass > p("mpeak"))
    merged = F.col("_p").isNull() | (at == F.col(n.last_merger))
    peak = F.when(new, mass).otherwise(p("mpeak"))
    ratio = F.try_divide(mass, peak)
    lost = F.greatest(F.col("_m.mass") - mass, F.lit(0.0))
    both = (F.col("upid") != -1) & (F.col("_m.upid") != -1)
    since = lambda restart, now, old, better: F.when(restart, now).when(better, now).otherwise(old)
    tide, spin, heat = F.col(n.tide), F.col(n.spin), F.col(n.heat)
    out = {
        "mpeak": peak, "a_mpeak": F.when(new, at).otherwise(p("a_mpeak")),
        "maxtf_peak": since(new, tide, p("maxtf_peak"), tide > p("maxtf_peak")), "a_maxtf_peak": since(new, at, p("a_maxtf_peak"), tide > p("maxtf_peak")),
        "min_bsr_peak": F.when(new, 1.0).otherwise(F.least(ratio, p("min_bsr_peak"))), "a_min_bsr_peak": since(new, at, p("a_min_bsr_peak"), ratio < p("min_bsr_peak")),
        "min_bsr_lmm": F.when(merged, 1.0).otherwise(F.least(ratio, p("min_bsr_lmm"))), "a_min_bsr_lmm": since(merged, at, p("a_min_bsr_lmm"), ratio < p("min_bsr_lmm")),
        "spin_peak": F.when(merged, spin).otherwise(F.greatest(spin, p("spin_peak"))), "tu_peak": F.when(merged, heat).otherwise(F.greatest(heat, p("tu_peak"))),
        "mass_lost_as_sub": F.when(new, 0.0).otherwise(p("mass_lost_as_sub") + F.when(both, lost).otherwise(0.0)), "mass_lost_peak": F.when(new, 0.0).otherwise(p("mass_lost_peak") + lost),
    }
    return {c: out[c].cast("double").alias(c) for c in HISTORY}


def histories(nodes: DataFrame, names: Names = Names()) -> DataFrame:
    """nodes with HISTORY: peaks and what has happened since the mass peak and since the last major merger.

    A node inherits from the progenitor of the greatest peak (the more massive, then the least id among equals), and
    compares its mass with that of its main progenitor. A new peak must exceed the inherited one.
    """
    n = names
    state = F.struct("mpeak", *(c for c in HISTORY if c != "mpeak")).alias("state")
    kind = "struct<" + ",".join(f"{c}:double" for c in HISTORY) + ">"

    def grow(now: DataFrame, came: DataFrame | None) -> DataFrame:
        if came is None:
            now = now.withColumns({"_p": F.lit(None).cast(kind), "_m": F.lit(None).cast("struct<mass:double,upid:bigint>")})
        else:
            best = came.groupBy("desc_id").agg(
                F.max_by(state, F.struct("mpeak", n.mass, -F.col("id"))).alias("_p"),
                F.max_by(F.struct(F.col(n.mass).alias("mass"), "upid"), F.struct(n.mass, -F.col("id"))).alias("_m"),
            )
            now = now.join(best.withColumnRenamed("desc_id", "id"), "id", "left")
        return now.select(*nodes.columns, "_into", *_grown(n).values())

    return tree.by_levels(nodes, n.epoch, grow)


def accreted(nodes: DataFrame, names: Names = Names()) -> DataFrame:
    """nodes with track_head and, summed along each track: lumpy, smooth, n_mergers; the shares of the two, and the mean
    mass of a merger. A track's first node has grown smoothly by its whole mass."""
    n = names
    per = tree.tracks(tree.accretion(nodes, n.mass), n.mass)
    w = Window.partitionBy("track_head").orderBy(n.epoch)
    first = F.row_number().over(w) == 1
    per = per.withColumn("smooth", F.when(first, F.col(n.mass)).otherwise(F.col("smooth")))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({c: F.sum(c).over(run) for c in ("lumpy", "smooth", "n_mergers")})
    total = F.col("lumpy") + F.col("smooth")
    return per.withColumns({"lumpy_share": F.try_divide(F.col("lumpy"), total), "smooth_share": F.try_divide(F.col("smooth"), total), "merger_mean": F.coalesce(F.try_divide(F.col("lumpy"), F.col("n_mergers")), F.lit(0.0))})


def span_rates(rows: DataFrame, track: str, t: str, columns: list[str], span: Column, per: float = 1.0, ties: Sequence[str] = ()) -> DataFrame:
    """rows with {c}_dyn: the change of c over a span back, over the span times `per`. The span is an expression of the row.

    The value a span back is interpolated between the track's neighbouring rows. A row younger than its span is compared
    with the track's first row; the first row has the rate of the one after it. A track is exchanged once: each row is
    doubled into a sample at t and a question at t - span, and a window hands every question the sample before it.
    Rows alike in t are ordered by the columns `ties`.
    """
    names = rows.columns
    w = Window.partitionBy(track).orderBy(t, *ties)
    pack = lambda f: F.struct(f(F.col(t)).cast("double").alias("t"), *(f(F.col(c)).cast("double").alias(c) for c in columns))
    own = rows.withColumn("_span", span.cast("double")).withColumn("_first", pack(lambda c: F.first(c).over(w)))
    own = own.withColumn("_sample", F.struct(pack(lambda c: c).alias("a"), pack(lambda c: F.lead(c).over(w)).alias("b")))
    doubled = own.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    doubled = doubled.withColumn("_at", F.col(t).cast("double") - F.when(F.col("_k") == 1, F.col("_span")).otherwise(0.0))
    before = F.last(F.when(F.col("_k") == 0, F.col("_sample")), ignorenulls=True).over(Window.partitionBy(track).orderBy("_at", "_k", *ties).rowsBetween(Window.unboundedPreceding, 0))
    asked = doubled.withColumn("_s", before).where("_k = 1")
    back, step = F.col("_at") - F.col("_s.a.t"), F.col("_s.b.t") - F.col("_s.a.t")
    rates = {}
    for c in columns:
        then = F.col(f"_s.a.{c}") + F.coalesce(F.try_divide((F.col(f"_s.b.{c}") - F.col(f"_s.a.{c}")) * back, step), F.lit(0.0))
        whole = F.try_divide(F.col(c) - then, F.col("_span") * per)
        young = F.try_divide(F.col(c) - F.col(f"_first.{c}"), (F.col(t).cast("double") - F.col("_first.t")) * per)
        rates[f"{c}_dyn"] = F.when(F.col("_s").isNotNull(), whole).otherwise(young)
    out = asked.withColumns(rates)
    out = out.withColumns({c: F.coalesce(c, F.lead(c).over(w)) for c in rates})
    return out.select(*names, *rates)


def dynamical_rates(rows: DataFrame, names: Names = Names(), extra: tuple[str, ...] = ("lumpy", "smooth")) -> DataFrame:
    """rows(track_head, epoch, mass, ...) with mass_dyn and a rate for each of extra: mass a year over a dynamical time."""
    n = names
    timed = rows.withColumn("_t", astro.cosmic_time(n.epoch))
    return span_rates(timed, "track_head", "_t", [n.mass, *extra], astro.dynamical_time(n.epoch), 1e9).drop("_t")


def branch_fields(nodes: DataFrame, names: Names = Names()) -> DataFrame:
    """The main branch of every tree with APPENDED: spin and heat as ratios to their peaks since the last major merger,
    and of the mass lost since the peak the share that went while both epochs were subhaloes."""
    n = names
    known = tree.tracks(histories(nodes, n), n.mass)
    roots = tree.with_links(nodes.select("id", "desc_id", "upid")).where("is_root").select(F.col("id").alias("track_head"))
    rows = dynamical_rates(known.join(roots, "track_head", "left_semi"), n, ())
    w = Window.partitionBy("track_head").orderBy(n.epoch)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    at_peak, leaf = F.col(n.mass) == F.col("mpeak"), F.row_number().over(w) == 1
    left = (F.col("upid") == -1) & (F.lag("upid").over(w) != -1)
    rows = rows.withColumns({
        "_out": F.coalesce(left, F.lit(False)).cast("int"), "_since": F.sum(at_peak.cast("int")).over(so_far),
        "_tide": F.when(leaf, 0.0).when(F.col(n.tide) > 1, 1.0).when(at_peak, 0.0),
    })
    since = Window.partitionBy("track_head", "_since").orderBy(n.epoch).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.col("mass_lost_peak")
    made = {
        "mdot_dyn": F.col(f"{n.mass}_dyn"), "npt": F.sum("_out").over(since).cast("double"), "high_tf": F.last("_tide", ignorenulls=True).over(so_far),
        "spin_peak": F.try_divide(F.col(n.spin), F.col("spin_peak")), "tu_peak": F.try_divide(F.col(n.heat), F.col("tu_peak")),
        "mass_lost_mpeak": F.when(lost > 0, F.col("mass_lost_as_sub") / lost).otherwise(lost),
    }
    return rows.select(*nodes.columns, *(made[c].alias(c) if c in made else F.col(c) for c in APPENDED))


def full_run(objects: DataFrame, nodes: DataFrame, epoch: float, names: Names = Names(), within: float = 1e-6, max_levels: int = 200) -> DataFrame:
    """objects(id, ...) with APPENDED from their own trees at an epoch: walk, histories, selection, merge in one plan."""
    walked = tree.tree_walk(nodes, objects.select("id"), max_levels).dropDuplicates(["id"]).select(*nodes.columns)
    at = catalog.select_epoch(branch_fields(walked, names), names.epoch, epoch, within)
    return catalog.merge(objects, at.select("id", *APPENDED))


def exported(nodes: DataFrame, columns: list[str], axis: tuple[str, str, str] = ("ax", "ay", "az"), names: Names = Names()) -> DataFrame:
    """For a viewer: the given columns with xrot, zrot, list_count (an epoch's number, 1 the oldest), tree_count (a tree's
    number, by the mass of its root), track (in its tree) and mar (growth since the main progenitor, 0 at a track's start)."""
    n, spark = names, nodes.sparkSession
    roots = tree.with_links(nodes).where("is_root").select(*nodes.columns)
    ids = tree.tree_walk(nodes, roots).select("id", F.col("root_id").alias("tree_id"))
    rows = tree.track_numbers(nodes.join(ids, "id").withColumnRenamed(n.epoch, "epoch"), n.mass)
    epochs = sorted(r[0] for r in nodes.select(n.epoch).distinct().collect())
    lists = spark.createDataFrame([(e, i + 1) for i, e in enumerate(epochs)], f"epoch {dict(nodes.dtypes)[n.epoch]}, list_count int")
    trees = ranked(roots.select(F.col("id").alias("tree_id"), (-F.col(n.mass)).alias("_m")), ["_m", "tree_id"], "_r").select("tree_id", (F.col("_r") + 1).alias("tree_count"))
    rows = rows.join(F.broadcast(lists), "epoch").join(trees, "tree_id")
    grown = F.col(n.mass) - F.lag(n.mass).over(Window.partitionBy("track_head").orderBy("epoch"))
    xrot, zrot = astro.rotation(*axis)
    rows = rows.withColumn("mar", F.coalesce(grown, F.lit(0.0))).withColumnRenamed("epoch", n.epoch)
    return rows.select(*columns, xrot.alias("xrot"), zrot.alias("zrot"), "list_count", "tree_count", "track", "mar")


@dataclass(frozen=True)
class Table:
    """The properties of a history table: by order statistics, by mean, and those whose mobility is followed.

    With the default lists it has 153 columns: z, 25 properties of five numbers, three on high spin, two mobility tables.
    """

    # The names of the properties.
    ordered: tuple[str, ...] = ("mvir", "smar", "cnfw", "rvir", "rs", "lambdap", "dlambdap", "tf", "vmax", "xoff", "e", "rsp", "rvirp", "e500", "lambda", "cklypin", "mlumpy", "msmooth", "eratio", "tu", "mdot_dyn", "smdot_dyn")
    means: tuple[str, ...] = ("merger_count", "merger_mass_avg", "merger_ratio_avg")
    mobile: tuple[str, ...] = ("lambdap", "tf")
    flag: str = "highspin"
    merger: str = "almm"


def properties(rows: DataFrame, names: Names = Names()) -> DataFrame:
    """rows of tracks (track_head, epoch, mass and what a tree table holds) with the properties of a history table that
    their columns allow, all of them for a whole table with its accretion and dynamical rates.

    Masses are over the track's newest mass, accreted ones over its peak so far, rates to the next older row a Gyr.
    """
    n, w = names, Window.partitionBy("track_head").orderBy(F.desc(names.epoch))
    rows = rows.withColumns({"_t": astro.cosmic_time(n.epoch), "_m0": F.first(n.mass).over(w)})
    rows = rows.withColumn("_mpeak", F.max(n.mass).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rate = lambda c: F.try_divide(F.col(c) - F.lead(c).over(w), F.col("_t") - F.lead("_t").over(w))
    over = lambda a, b: F.try_divide(F.col(a), F.col(b))
    e, e500 = astro.elongation("b_to_a", "c_to_a"), astro.elongation("b_to_a500", "c_to_a500")
    made = {
        "mvir": ([n.mass], lambda: over(n.mass, "_m0")), "smar": ([n.mass], lambda: F.try_divide(rate(n.mass), F.col("_m0"))), "cnfw": (["rvir", "rs"], lambda: over("rvir", "rs")),
        "rvir": (["rvir"], lambda: F.col("rvir")), "rs": (["rs"], lambda: F.col("rs")), "lambdap": ([n.spin], lambda: F.col(n.spin)), "dlambdap": ([n.spin], lambda: rate(n.spin)), "tf": ([n.tide], lambda: F.col(n.tide)),
        "vmax": (["vmax"], lambda: F.col("vmax")), "xoff": (["xoff", "rvir"], lambda: over("xoff", "rvir")), "e": (["b_to_a", "c_to_a"], lambda: e), "rsp": (["rs"], lambda: astro.physical("rs", n.epoch)),
        "rvirp": (["rvir"], lambda: astro.physical("rvir", n.epoch)), "e500": (["b_to_a500", "c_to_a500"], lambda: e500), "lambda": (["lambda"], lambda: F.col("lambda")), "cklypin": (["rvir", "rs_klypin"], lambda: over("rvir", "rs_klypin")),
        "mlumpy": (["lumpy"], lambda: over("lumpy", "_mpeak")), "msmooth": (["smooth"], lambda: over("smooth", "_mpeak")), "eratio": (["b_to_a", "c_to_a", "b_to_a500", "c_to_a500"], lambda: F.try_divide(e, e500)),
        "tu": ([n.heat], lambda: F.col(n.heat)), "mdot_dyn": ([f"{n.mass}_dyn"], lambda: F.col(f"{n.mass}_dyn")), "smdot_dyn": ([f"{n.mass}_dyn"], lambda: over(f"{n.mass}_dyn", n.mass)),
        "merger_count": (["n_mergers"], lambda: F.col("n_mergers")), "merger_mass_avg": (["merger_mean"], lambda: F.col("merger_mean")), "merger_ratio_avg": (["merger_mean"], lambda: over("merger_mean", n.mass)),
    }
    found = {c: f().cast("double") for c, (needed, f) in made.items() if all(x in rows.columns for x in needed)}
    return rows.withColumns({f"_of_{c}": x for c, x in found.items()}).select(*(c for c in rows.columns if c[0] != "_" and c not in found), *(F.col(f"_of_{c}").alias(c) for c in found))


FIVE = ("median", "d20", "d80", "ci_lo", "ci_hi")


def history_table(rows: DataFrame, track: str, step: str, z: str, table: Table = Table(), balanced: bool = True, least: int = 5) -> DataFrame:
    """One row for each step of aligned tracks (step 0 the newest) that has `least` tracks: z and, of each property,
    five numbers; the share of flagged tracks, by those at step 0 and by all, and of the flagged those with a merger;
    for each mobile property the value at 20 to 80 % of three populations.

    A property given by its mean has mean, mean -+ deviation and mean -+ deviation / sqrt(n). With balanced, a track that
    ends takes the track of the opposite rank at that step with it, property by property (tree.balance). tree.living()
    says when a track begins and ends.
    """
    t = table
    names = [*t.ordered, *t.means]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("prop"), F.col(c).cast("double").alias("v")) for c in names)))
    long = rows.select(track, step, pairs.alias("s")).select(track, step, "s.*")
    if balanced:
        long = tree.balance(long, track, step, "v", ["prop"])
    long = written(long)
    by = [step, "prop"]
    order = order_stats(long.where(F.col("prop").isin(*t.ordered)), by, "v", mad=False).select(*by, *FIVE)
    m, d = F.avg("v"), F.stddev_pop("v")
    mean = long.where(F.col("prop").isin(*t.means)).groupBy(*by).agg(m.alias("median"), (m - d).alias("d20"), (m + d).alias("d80"), (m - d / F.sqrt(F.count("v"))).alias("ci_lo"), (m + d / F.sqrt(F.count("v"))).alias("ci_hi"))
    pick = [F.first(F.when(F.col("prop") == c, F.col(k)), ignorenulls=True).alias(f"{c}_{k}") for c in names for k in FIVE]
    out = order.unionByName(mean).groupBy(step).agg(*pick)
    high = F.col(t.flag) == 1
    at = rows.groupBy(step).agg(F.first(z).alias("z"), F.count("*").alias("_n"), F.count_if(high).alias("_high"), F.count_if(high & (F.col(t.merger) != -1)).alias("_merged"))
    zero = at.where(F.col(step) == 0).select(F.col("_high").alias("_zero"))
    at = at.crossJoin(F.broadcast(zero))  # one row
    at = at.select(step, "z", "_n", F.try_divide("_high", "_zero").alias("high_kept"), F.try_divide("_high", "_n").alias("high_share"), F.try_divide("_merged", "_high").alias("high_merged"))
    out = at.where(F.col("_n") >= least).drop("_n").join(out, step, "left")
    for c in t.mobile:
        followed = tree.mobility(rows, track, step, c)
        cells = [F.first(F.when(F.col("population") == p, F.col(f"p{k}")), ignorenulls=True).alias(f"{c}_{p}_p{k}") for k in (20, 40, 60, 80) for p in ("low", "middle", "high")]
        out = out.join(followed.groupBy(step).agg(*cells), step, "left")
    return out
