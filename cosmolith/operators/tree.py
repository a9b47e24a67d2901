"""Merger trees as an edge table (id, desc_id, upid, epoch, mass ...). Loops run over levels or epochs, never over rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.ranks import FEW_ROWS
from cosmolith.functions.shared import counted, dealt, looked_up, ranked, with_groups, written, written_by


def with_links(nodes: DataFrame) -> DataFrame:
    """nodes with has_desc, is_root (no descendant among them), has_host and is_orphan (a host that isn't among them)."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    out = nodes.join(ids.withColumn("_d", F.lit(True)), F.col("desc_id") == F.col("_id"), "left").drop("_id")
    out = out.join(ids.withColumn("_h", F.lit(True)), F.col("upid") == F.col("_id"), "left").drop("_id")
    return out.select(*nodes.columns, F.col("_d").isNotNull().alias("has_desc"), F.col("_d").isNull().alias("is_root"), F.col("_h").isNotNull().alias("has_host"), ((F.col("upid") != -1) & F.col("_h").isNull()).alias("is_orphan"))


def most_massive(nodes: DataFrame, mass: str = "mass") -> DataFrame:
    """nodes with is_mmp: the descendant's most massive progenitor, the least id among equals."""
    slim = written(nodes.select("id", "desc_id", F.col(mass).alias("_mass")))
    rows, key = slim.count(), ["id", "desc_id"]  # no two nodes share this key, but a third of all may share a descendant
    best = dealt(slim, rows, "id").groupBy("desc_id").agg(F.max_by("id", F.struct("_mass", -F.col("id"))).alias("id")).where("desc_id is not null")
    marked = dealt(nodes, rows, *key).join(dealt(best.withColumn("_best", F.lit(True)), rows, *key), key, "left")
    return marked.select(*nodes.columns, F.when(F.col("desc_id").isNotNull(), F.col("_best").isNotNull()).alias("is_mmp"))


def ends(edges: DataFrame, max_levels: int = 200) -> DataFrame:
    """Of edges(id, to), `to` null or one of the ids: id, end (where its chain ends) and steps, by pointer doubling.

    A round doubles the length of all chains and moves three columns; rows that have reached their end are set aside, so
    rounds get smaller and no end gathers its whole tree.
    """
    start = written(edges.select("id", F.coalesce("to", "id").alias("end"), F.col("to").isNotNull().cast("int").alias("steps"), F.col("to").isNull().alias("done")))
    rows, out, left = start.count(), start.where("done"), start.where("not done")
    for _ in range(max_levels.bit_length() + 2):
        if left.isEmpty():
            return out.drop("done")
        up = out.unionByName(left).select(F.col("id").alias("end"), F.col("end").alias("_up"), F.col("steps").alias("_more"), F.col("done").alias("_done"))
        nxt = written(looked_up(left, up, "end", rows).select("id", F.col("_up").alias("end"), (F.col("steps") + F.col("_more")).alias("steps"), F.col("_done").alias("done")))
        out, left = out.unionByName(nxt.where("done")), nxt.where("not done")
    raise RuntimeError(f"a chain is longer than {max_levels} steps, or has a cycle")


def _pointers(nodes: DataFrame, mmp_only: bool, mass: str) -> DataFrame:
    """id and to, its descendant if that is among the nodes (and, with mmp_only, if the node is its main progenitor)."""
    rows = most_massive(nodes, mass) if mmp_only else nodes
    to = F.when(F.col("is_mmp"), F.col("desc_id")) if mmp_only else F.col("desc_id")
    rows = written(rows.select("id", to.alias("to")))  # most nodes are no main progenitor: they stay out of the join, which would send them all to one task
    ids = nodes.select(F.col("id").alias("to"), F.lit(True).alias("_known"))
    main = looked_up(rows.where("to is not null"), ids, "to", rows.count(), "left").select("id", F.when(F.col("_known"), F.col("to")).alias("to"))
    return main.unionByName(rows.where("to is null"))


def tree_walk(nodes: DataFrame, roots: DataFrame, max_levels: int = 200, mmp_only: bool = False, mass: str = "mass") -> DataFrame:
    """All nodes of the trees of roots(id), or their main branches: the node's columns, root_id and level.

    Chains are followed to the first root above a node. Where a root lies in the tree of another, its nodes are in both.
    """
    asked = roots.select("id").distinct().withColumn("_root", F.lit(True))
    edges = written(_pointers(nodes, mmp_only, mass).join(asked, "id", "left"))
    chains = ends(edges.select("id", F.when(F.col("_root").isNull(), F.col("to")).alias("to")), max_levels)
    found = written(chains.join(asked.select(F.col("id").alias("end")), "end").select("id", F.col("end").alias("root_id"), F.col("steps").alias("level")))
    above = edges.where("_root and to is not null").select(F.col("id").alias("_inner"), F.col("to").alias("id"))
    above = written(above.join(found, "id").select("_inner", F.col("root_id").alias("_outer"), (F.col("level") + 1).alias("_more")))
    pairs = last = found
    for _ in range(max_levels):
        if above.isEmpty() or last.isEmpty():
            rows = pairs.count()
            return dealt(nodes, rows, "id").join(dealt(pairs, rows, "id"), "id")
        last = written(last.join(above, F.col("root_id") == F.col("_inner")).select("id", F.col("_outer").alias("root_id"), (F.col("level") + F.col("_more")).alias("level")))
        pairs = pairs.unionByName(last)
    raise RuntimeError(f"roots are nested deeper than {max_levels}, or have a cycle")


def by_levels(nodes: DataFrame, order: str, grow: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """nodes grown from the oldest epoch to the newest: grow(rows, came) gets an epoch's rows and the grown nodes that
    descend into it (None at first) and returns the rows, _into and what it has made.

    The table has a folder for each epoch, so an epoch reads its own rows; each result is written, so a lost executor
    costs one epoch.
    """
    descends = nodes.select(F.col("id").alias("desc_id"), F.col(order).alias("_into"))
    rows = written_by(nodes.join(descends, "desc_id", "left").select(*nodes.columns, "_into"), order, "id")
    pairs = rows.select(order, "_into").distinct().collect()  # a few for each epoch
    level: dict = {}
    for e in sorted({r[0] for r in pairs}):
        older = [level[r[0]].where(F.col("_into") == e) for r in pairs if r[1] == e and r[0] in level]
        level[e] = written(grow(rows.where(F.col(order) == e), reduce(DataFrame.unionByName, older) if older else None))
    return reduce(DataFrame.unionByName, level.values()).drop("_into") if level else grow(rows, None).drop("_into")


def peaks(nodes: DataFrame, mass: str = "mass", order: str = "epoch") -> DataFrame:
    """nodes with peak and peak_epoch over each node and all its progenitors, from the oldest epoch to the newest.

    A new peak must exceed what is inherited; among progenitors the greatest peak is inherited, the least id on ties.
    """

    def grow(rows: DataFrame, came: DataFrame | None) -> DataFrame:
        if came is None:
            rows = rows.withColumn("_p", F.lit(None).cast("struct<peak:double,nid:bigint,peak_epoch:double>"))
        else:
            best = came.groupBy("desc_id").agg(F.max(F.struct("peak", (-F.col("id")).alias("nid"), "peak_epoch")).alias("_p")).withColumnRenamed("desc_id", "id")
            rows = rows.join(best, "id", "left")
        own = F.col("_p").isNull() | (F.col(mass) > F.col("_p.peak"))
        peak, at = (F.when(own, F.col(c)).otherwise(F.col(f"_p.{n}")).cast("double").alias(n) for c, n in ((mass, "peak"), (order, "peak_epoch")))
        return rows.select(*nodes.columns, "_into", peak, at)

    return by_levels(nodes, order, grow)


def tracks(nodes: DataFrame, mass: str = "mass", max_levels: int = 200) -> DataFrame:
    """nodes with track_head: the newest node of the branch on which each is the main progenitor of the next."""
    heads = ends(_pointers(nodes, True, mass), max_levels).select("id", F.col("end").alias("track_head"))
    rows = heads.count()
    return dealt(nodes, rows, "id").join(dealt(heads, rows, "id"), "id")


def track_numbers(nodes: DataFrame, mass: str = "mass", max_levels: int = 1000) -> DataFrame:
    """tracks() with track: a tree's branches numbered breadth first. The root has 1; level by level, in the order of their
    descendants and then of mass (least id among equals), a main progenitor has its descendant's number, any other a new one.

    A level's places are prefix sums over the places of the level before, and its new numbers prefix sums over its own
    places, both by ranges of places: a tree of a third of all nodes is spread like any other. nodes has tree_id.
    """
    t = written(tracks(nodes, mass))
    order = Window.partitionBy("desc_id").orderBy(F.desc(mass), "id")  # over a node's own progenitors
    kids = written(most_massive(nodes, mass).select("id", "desc_id", "is_mmp", (F.row_number().over(order) - 1).alias("_nth")))
    ids = nodes.select(F.col("id").alias("desc_id"))
    first = nodes.join(ids, "desc_id", "left_anti").select("id", "tree_id")
    base = written(first.select("tree_id", F.lit(1).cast("long").alias("_base")))  # numbers that a tree has used; it has one root
    level = written(first.select("id", "tree_id", F.lit(0).cast("long").alias("_place"), F.lit(1).cast("long").alias("track")))
    heads = [level.select("id", "track")]
    for _ in range(max_levels):
        below = written(kids.join(level.select(F.col("id").alias("desc_id"), "tree_id", F.col("_place").alias("_up"), F.col("track").alias("_own")), "desc_id"))
        if below.isEmpty():
            found = reduce(DataFrame.unionByName, heads)
            return t.join(found.withColumnRenamed("id", "track_head"), "track_head").select(*t.columns, F.col("track").cast("int").alias("track"))
        starts = counted(below, "_up", ["tree_id"]).select("tree_id", "_up", "before")
        below = written(below.join(starts, ["tree_id", "_up"]).withColumn("_place", F.col("before") + F.col("_nth")).drop("before"))
        new = written(counted(below.where("not is_mmp"), "_place", ["tree_id"]).select("tree_id", "_place", "before", "total"))
        named = below.join(base, "tree_id").join(new.drop("total"), ["tree_id", "_place"], "left")
        level = written(named.select("id", "tree_id", "_place", "is_mmp", F.when(F.col("is_mmp"), F.col("_own")).otherwise(F.col("_base") + F.col("before") + 1).alias("track")))
        heads.append(level.where("not is_mmp").select("id", "track"))
        level = level.drop("is_mmp")
        more = new.groupBy("tree_id").agg(F.max("total").alias("_more"))
        base = written(base.join(more, "tree_id", "left").select("tree_id", (F.col("_base") + F.coalesce("_more", F.lit(0))).alias("_base")))
    raise RuntimeError(f"a tree is deeper than {max_levels}, or has a cycle")


def accretion(nodes: DataFrame, mass: str = "mass") -> DataFrame:
    """Per node: lumpy mass (progenitors but the main one), smooth mass (the rest of the growth, not below 0), and mergers."""
    m = most_massive(nodes, mass)
    p = m.groupBy("desc_id").agg(
        F.sum(F.when(~F.col("is_mmp"), F.col(mass)).otherwise(0.0)).alias("lumpy"), F.sum((~F.col("is_mmp")).cast("int")).alias("n_mergers"), F.max(F.when(F.col("is_mmp"), F.col(mass))).alias("_main")
    )
    out = nodes.join(p.withColumnRenamed("desc_id", "id"), "id", "left")
    lumpy = F.coalesce("lumpy", F.lit(0.0))
    return out.select(*nodes.columns, lumpy.alias("lumpy"), F.greatest(F.col(mass) - F.coalesce("_main", F.col(mass)) - lumpy, F.lit(0.0)).alias("smooth"), F.coalesce("n_mergers", F.lit(0)).alias("n_mergers"))


def merger_ratio(nodes: DataFrame, mass: str = "mass", major: float = 0.3, minor: float = 0.2) -> DataFrame:
    """Per host with two subhaloes or more: the largest one's share against the rest, and whether it is major or minor."""
    subs = nodes.where("upid <> -1").groupBy("upid").agg(F.count("*").alias("n_subs"), F.max(mass).alias("largest"), F.sum(mass).alias("_all"))
    ratio = F.try_divide(F.col("largest"), F.col("_all") - F.col("largest"))
    return subs.where("n_subs > 1").select(F.col("upid").alias("id"), "n_subs", "largest", ratio.alias("ratio"), (ratio > major).alias("is_major"), ((ratio > minor) & (ratio <= major)).alias("is_minor"))


def second_progenitors(nodes: DataFrame, column: str, mass: str = "mass") -> DataFrame:
    """id of each node with two progenitors or more, and the column's value of the second most massive one. nodes may have is_mmp."""
    others = (nodes if "is_mmp" in nodes.columns else most_massive(nodes, mass)).where("not is_mmp")
    return others.groupBy("desc_id").agg(F.max_by(column, F.struct(mass, -F.col("id"))).alias("_second")).withColumnRenamed("desc_id", "id")


def _inherited(rows: DataFrame, flags: dict[str, Column], order: str, leaf: Column) -> DataFrame:
    """The newest epoch up to each row of its track at which a flag held; `leaf` where there is none."""
    w = Window.partitionBy("track_head").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: F.coalesce(F.last(F.when(f, F.col(order)), ignorenulls=True).over(w), leaf).cast("double") for n, f in flags.items()})


def stellar_merger(nodes: DataFrame, ratio: float = 10.0, pairwise: bool = False, peak: str = "mpeak", mass: str = "mass", order: str = "epoch") -> DataFrame:
    """nodes(track_head, root_id, peak) with almms, the epoch of the last stellar major merger along the main branch.

    A merger is major if the stellar mass of the second progenitor (from its peak mass) is over 1 / ratio of the stellar
    mass of the tree's root, or, pairwise, of the first progenitor. Without one almms is -1, pairwise the leaf's epoch.
    """
    from cosmolith.functions import astro
    from cosmolith.functions.shared import with_groups

    star = written(nodes.withColumn("_star", astro.stellar_mass(peak)))
    n, slim = star.count(), written(most_massive(star.select("id", "desc_id", mass, "_star"), mass))
    rows = dealt(star, n, "id").join(dealt(second_progenitors(dealt(slim, n, "id"), "_star", mass), n, "id"), "id", "left")
    if pairwise:
        first = slim.where("is_mmp").select(F.col("desc_id").alias("id"), F.col("_star").alias("_other"))
        rows = rows.join(dealt(first, n, "id"), "id", "left")
    else:
        rows = with_groups(rows, star.where("id = root_id").select("root_id", F.col("_star").alias("_other")), ["root_id"])
    rows = dealt(rows, n, "track_head")
    oldest = F.first(order).over(Window.partitionBy("track_head").orderBy(order))
    major = F.col("_second").isNotNull() & (F.col("_other") < F.lit(ratio) * F.col("_second"))
    out = _inherited(rows, {"almms": major}, order, oldest if pairwise else F.lit(-1.0))
    return out.select(*nodes.columns, "almms")


def subhalo_mergers(nodes: DataFrame, mass: str = "mass", order: str = "epoch", major: float = 0.3, minor: float = 0.2) -> DataFrame:
    """nodes(track_head, upid) with almm2 and alminm, the epochs of the last major and minor merger along the main branch,
    told by the largest subhalo over the rest of its host's mass; a branch starts with one of each at its leaf."""
    nodes = written(nodes)
    n, subs = nodes.count(), nodes.where("upid <> -1").groupBy("upid").agg(F.max(mass).alias("_largest")).withColumnRenamed("upid", "id")
    rows = dealt(nodes, n, "id").join(dealt(subs, n, "id"), "id", "left")
    rows = dealt(rows, n, "track_head").withColumn("_share", F.try_divide(F.col("_largest"), F.col(mass) - F.col("_largest")))
    leaf = F.row_number().over(Window.partitionBy("track_head").orderBy(order)) == 1
    rows = rows.withColumn("_leaf", leaf)
    out = _inherited(rows, {"almm2": F.col("_leaf") | (F.col("_share") > major), "alminm": F.col("_leaf") | (F.col("_share") > minor)}, order, F.lit(-1.0))
    return out.select(*nodes.columns, "almm2", "alminm")


def history(rows: DataFrame, track: str, step: str, columns: list[str]) -> DataFrame:
    """(step, prop) order statistics over aligned tracks: long form, one pass for all properties."""
    from cosmolith.operators.aggregates import order_stats

    long = rows.select(step, F.explode(F.array(*(F.struct(F.lit(c).alias("prop"), F.col(c).cast("double").alias("v")) for c in columns))).alias("s")).select(step, "s.*")
    return order_stats(long, [step, "prop"], "v", mad=False)


def living(rows: DataFrame, track: str, step: str, mass: str, least: float = 1e10, epoch: str | None = None) -> DataFrame:
    """rows of aligned tracks (step 0 the newest) while they live: a track ends before the first step with a mass under
    `least`, or without a row; with `epoch`, tracks whose newest epoch is not over 1 don't begin."""
    low = rows.where(~(F.col(mass) >= least) | F.col(mass).isNull()).groupBy(track).agg(F.min(step).alias("_low"))
    out = rows.join(low, track, "left").where(F.col("_low").isNull() | (F.col(step) < F.col("_low"))).drop("_low")
    gap = F.col(step) - F.row_number().over(Window.partitionBy(track).orderBy(step)) + 1  # over a track's steps
    out = out.withColumn("_gap", gap).where("_gap = 0").drop("_gap")
    if epoch:
        begun = out.where((F.col(step) == 0) & (F.col(epoch) > 1)).select(track)
        out = out.join(begun, track, "left_semi")
    return out


def balance(rows: DataFrame, track: str, step: str, value: str, by: list[str] | None = None) -> DataFrame:
    """rows without those older than where their track was dropped: at each step at which a living track ends, the track of
    the opposite rank among those alive at that step, by their value there (then by track), goes too (within `by`).

    The loop is over the steps at which tracks end, on a slim table (track and until when it is kept); ranks of more
    than FEW_ROWS tracks come from a range exchange, so no task holds all of them. A step has a folder of its own, so a round reads that step only.
    """
    by = by or []
    rows_at = written_by(rows.select(*by, track, step, value), step, track)
    state = written(rows_at.groupBy(*by, track).agg(F.max(step).alias("_until")))
    few = state.count() <= FEW_ROWS
    deaths = sorted(r[0] for r in state.select("_until").distinct().collect())  # steps: a few hundred
    for s in deaths[:-1]:  # after the last nothing is left to balance
        alive = rows_at.where(F.col(step) == s).join(state.where(F.col("_until") >= s), [*by, track]).select(*by, track, value, (F.col("_until") == s).alias("_ends"))
        if few:  # tracks that a task could hold are ranked by a window
            order = alive.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(value, track)) - 1)
            order = order.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
        else:
            order = written(ranked(alive, [value, track], "_rank", by))
            size = order.groupBy(*by).agg(F.count("*").alias("_n"))
            order = with_groups(order, size, by) if by else order.crossJoin(F.broadcast(size))  # one row
        pair = Window.partitionBy(*by, F.least(F.col("_rank"), F.col("_n") - 1 - F.col("_rank")))
        dropped = order.select(*by, track, F.max("_ends").over(pair).alias("_drop")).where("_drop")
        state = written(state.join(dropped, [*by, track], "left").select(*by, track, F.when(F.col("_drop"), F.least("_until", F.lit(s))).otherwise(F.col("_until")).alias("_until")))
    return rows.join(state, [*by, track]).where(F.col(step) <= F.col("_until")).drop("_until")


def mobility(rows: DataFrame, track: str, step: str, value: str) -> DataFrame:
    """Populations under 20 %, 40 to 60 % and over 80 % by rank at step 0, and their value at 20, 40, 60, 80 % per step."""
    from cosmolith.functions.shared import at_rank, counted, ranked

    start = ranked(rows.where(F.col(step) == 0).select(track, value), [value, track], "_r")
    n = start.count()
    share = F.col("_r") / F.lit(max(n, 1))
    pop = F.when(share < 0.2, "low").when((share >= 0.4) & (share < 0.6), "middle").when(share >= 0.8, "high")
    member = start.select(track, pop.alias("population")).where("population is not null")
    of = counted(rows.join(member, track).select(step, "population", value), value, [step, "population"])
    at = [at_rank(value, F.least(F.floor(F.col("total") * F.lit(p / 100)), F.col("total") - 1)).alias(f"p{p}") for p in (20, 40, 60, 80)]
    return of.groupBy(step, "population").agg(F.max("total").alias("n"), *at)
