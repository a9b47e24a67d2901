"""Binned averages, medians with order statistics, histograms, and what is made from them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.ranks import FEW_ROWS, values_at
from cosmolith.functions.segments import small
from cosmolith.functions.shared import counted, finite, ranked, same_keys, with_groups, written
from cosmolith.operators.binning import bucket, order_values, span


def binned_avg(df: DataFrame, x: str, y: str, n_bins: int) -> DataFrame:
    """lower_edge, mean of the finite y in each equal-width bin of x; an empty bin has 0."""
    lo, hi = span(df, x)
    width = (hi - lo) / n_bins
    means = bucket(df.where(finite(y)), x, n_bins, lo, hi).groupBy("bin_id").agg(F.avg(y).alias("mean"))
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin_id"))
    return grid.join(means, "bin_id", "left").select("bin_id", (F.lit(lo) + F.col("bin_id") * width).alias("lower_edge"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def _indices(n):
    """0-based ranks of the order statistics of n values, clamped to the group."""
    at = lambda c: F.greatest(F.least(c, n - 1), F.lit(0)).cast("long")
    half = F.lit(0.5) * n
    wide = F.lit(1.96) * F.sqrt(F.lit(0.25) * n)
    return {
        "m_lo": at(F.floor((n - 1) / 2)), "m_hi": at(F.floor(n / 2)), "d20": at(F.floor(n * F.lit(0.2))), "d80": at(F.ceil(n * F.lit(0.8))),
        "ci_lo": at(F.floor(half - wide + 1)), "ci_hi": at(F.ceil(half + wide - 1)),
    }


def order_stats(df: DataFrame, by: list[str], y: str, mad: bool = True, few: int = FEW_ROWS) -> DataFrame:
    """by, n, median, d20, d80, ci_lo, ci_hi (and mad) of the finite y of each group. In a table of more than `few` rows each
    rank is bracketed by a sketch, so that only values near the wanted ones are exchanged; the deviations likewise."""
    values = written(df.where(finite(y)).select(*by, F.col(y).cast("double").alias("_y")))
    rows = values.count()
    stats = values_at(values, "_y", by, _indices(F.col("n")), rows, few)
    stats = stats.withColumn("median", (F.col("m_lo") + F.col("m_hi")) / 2).drop("m_lo", "m_hi")
    if mad:
        stats = written(stats)
        dev = same_keys(values, small(stats.select(*by, "median")), by, "inner").select(*by, F.abs(F.col("_y") - F.col("median")).alias("_d"))
        stats = same_keys(stats, values_at(dev, "_d", by, {"mad": F.floor(F.col("n") * F.lit(0.5))}, rows, few).drop("n"), by)
    return stats


def merge_small(counts: list[int], least: int) -> list[int]:
    """For each bin the bin it ends up in: left to right, a bin under `least` joins its smaller neighbour (ties go right;
    if the right one is smaller, that one is looked at first), until a pass merges nothing. Bins are named by their first."""
    groups = [[i] for i in range(len(counts))]
    size = list(counts)
    moved = True
    while moved and len(groups) > 1:
        moved, i = False, 0
        while i < len(groups) and len(groups) > 1:
            if size[i] >= least:
                i += 1
                continue
            if i + 1 < len(groups) and size[i + 1] < size[i]:
                i += 1
                continue
            left = size[i - 1] if i else math.inf
            right = size[i + 1] if i + 1 < len(groups) else math.inf
            j = i + 1 if right <= left else i - 1
            a, b = min(i, j), max(i, j)
            groups[a] += groups.pop(b)
            size[a] += size.pop(b)
            moved, i = True, a + 1
    return [g for i in range(len(counts)) for g in [next(min(x) for x in groups if i in x)]]


def default_bins(n: int) -> int:
    return max(1, int(3 * 2 ** (math.log10(n) - 2))) if n > 0 else 1


def bins_of_width(df: DataFrame, x: str, width: float) -> int:
    """How many bins of at most `width` hold the column; they are as wide as the range allows."""
    lo, hi = span(df, x)
    return max(1, math.ceil((hi - lo) / width))


def _grouped(df: DataFrame, by: list[str], *names: str) -> DataFrame:
    """df with {c}_lo and {c}_hi of its group for each of the columns, over the rows where all of them are finite."""
    for c in names:
        df = df.where(finite(c))
    ends = [f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in names for f, n in ((F.min, "lo"), (F.max, "hi"))]
    if by:
        return with_groups(df, df.groupBy(*by).agg(*ends), by)
    r = df.agg(*ends).first()
    return df.withColumns({c: F.lit(v) for c, v in r.asDict().items()})


def _cell(c: str, bins: int) -> Column:
    """The equal-width bin of a column between its {c}_lo and {c}_hi; the last bin holds its upper edge."""
    width = (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / bins
    return F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"{c}_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")


def binned_median(df: DataFrame, x: str, y: str, n_bins: int | None = None, merge_under: int | None = None, by: list[str] | None = None) -> DataFrame:
    """bin_id, lo, hi, center and the order statistics of y in equal-width bins of x; bins under merge_under rows merge.

    With `by` each group has bins of its own, over its own range, all in one pass.
    """
    by = by or []
    n_bins = n_bins or default_bins(df.count())
    rows = _grouped(df.select(*by, x, y), by, x)
    rows = rows.where(finite(y)).select(*by, _cell(x, n_bins).alias("bin_id"), F.col(f"{x}_lo").alias("_lo"), ((F.col(f"{x}_hi") - F.col(f"{x}_lo")) / n_bins).alias("_w"), F.col(y).alias("_v"))
    rows = rows.withColumn("_end", F.col("bin_id") + 1)
    if merge_under:
        found: dict[tuple, dict[int, int]] = {}
        for r in rows.groupBy(*by, "bin_id").count().collect():  # n_bins rows a group
            found.setdefault(tuple(r[c] for c in by), {})[r.bin_id] = r["count"]
        to = []
        for g, counts in found.items():
            into = merge_small([counts.get(i, 0) for i in range(n_bins)], merge_under)
            to += [(*g, i, t, max(k for k in range(n_bins) if into[k] == t) + 1) for i, t in enumerate(into)]
        kinds = ", ".join(f"`{c}` {k}" for c, k in df.select(*by).dtypes)
        moved = df.sparkSession.createDataFrame(to, f"{kinds}{', ' * bool(by)}bin_id int, _to int, _last int")
        rows = rows.join(F.broadcast(moved), [*by, "bin_id"]).withColumns({"bin_id": F.col("_to"), "_end": F.col("_last")}).drop("_to", "_last")
    stats = order_stats(rows, [*by, "bin_id", "_end", "_lo", "_w"], "_v")
    lo, hi = F.col("_lo") + F.col("bin_id") * F.col("_w"), F.col("_lo") + F.col("_end") * F.col("_w")
    return stats.select(*by, "bin_id", ((lo + hi) / 2).alias("center"), "median", "d20", "d80", "mad", "ci_lo", "ci_hi", lo.alias("lo"), hi.alias("hi"), "n")


def percent_ranks(df: DataFrame, c: str, ties: list[str], to: str = "percent") -> DataFrame:
    """df with the percentage of rows before each in the order of c; ties by further columns."""
    return ranked(df, [c, *ties], "_rank").withColumn(to, F.col("_rank") * 100.0 / F.lit(max(1, df.count()))).drop("_rank")


def percent_median(df: DataFrame, x: str, y: str, n_bins: int, ties: list[str], keep: Column | None = None) -> DataFrame:
    """binned_median over the percentage of rows before each in the order of x. Rows that `keep` leaves out are ranked too."""
    rows = percent_ranks(df, x, ties, "_p")
    rows = (rows if keep is None else rows.where(keep)).withColumn("bin_id", F.least(F.floor(F.col("_p") / F.lit(100.0 / n_bins)), F.lit(n_bins - 1)).cast("int"))
    width = F.lit(100.0 / n_bins)
    stats, lo = order_stats(rows, ["bin_id"], y), F.col("bin_id") * width
    return stats.select("bin_id", (lo + width / 2).alias("center"), "median", "d20", "d80", "mad", "ci_lo", "ci_hi", lo.alias("lo"), (lo + width).alias("hi"), "n")


PLACED = ("median", "d20", "d80", "ci_lo", "ci_hi")


def placed(stats: DataFrame, df: DataFrame, y: str) -> DataFrame:
    """stats with PLACED as percentages of where they lie among the finite y of df: the least is 0, the greatest 100, a value
    of y has that of the first of its kind, and one between two values half a row more than the lower one. mad stays.

    The statistics are counted among the values with weight 0, so nothing is gathered.
    """
    stats = written(stats.withColumn("_id", F.monotonically_increasing_id()))
    asked = stats.select("_id", F.explode(F.array(*(F.struct(F.lit(c).alias("_what"), F.col(c).alias("_v")) for c in PLACED))).alias("_s")).select("_id", "_s.*")
    values = df.where(finite(y)).select(F.col(y).cast("double").alias("_v"), F.lit(1).alias("_k")).unionByName(asked.select("_v", F.lit(0).alias("_k")))
    c = counted(values, "_v", weight=F.col("_k"))
    place = F.when(F.col("before") == 0, 0.0).when(F.col("before") + F.col("n") == F.col("total"), 100.0).otherwise((F.col("before") - F.when(F.col("n") == 0, 0.5).otherwise(0.0)) * 100.0 / F.col("total"))
    found = asked.join(c.select("_v", place.alias("_p")), "_v").groupBy("_id").agg(*(F.max(F.when(F.col("_what") == w, F.col("_p"))).alias(w) for w in PLACED))
    return stats.drop(*PLACED).join(found, "_id").select(*(k for k in stats.columns if k != "_id"))


def hist1d(df: DataFrame, x: str, n_bins: int | None = None, norm: bool = False, by: list[str] | None = None) -> DataFrame:
    """bin_id, center, pdf, width, cdf, count on a dense grid. The cdf is over all rows, as is n; with norm the area is 1."""
    by = by or []
    lo, hi = span(df, x)
    n_all = df.count()
    n_bins = n_bins or max(1, int(10 * 3 ** (math.log10(max(n_all, 1)) - 2)))
    width = (hi - lo) / n_bins
    counts = bucket(df, x, n_bins, lo, hi).groupBy(*by, "bin_id").agg(F.count("*").alias("count"))
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin_id"))
    if by:
        grid = df.select(*by).distinct().withColumn("bin_id", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = grid.join(counts, [*by, "bin_id"], "left").na.fill(0, ["count"])
    out = with_groups(out, df.groupBy(*by).agg(F.count("*").alias("_n")), by) if by else out.withColumn("_n", F.lit(n_all))
    w = Window.partitionBy(*by).orderBy("bin_id")  # over n_bins rows
    area = F.sum("count").over(Window.partitionBy(*by)) * F.lit(width or 1.0) if norm else F.lit(1.0)
    return out.select(
        *by, "bin_id", (F.lit(lo) + (F.col("bin_id") + F.lit(0.5)) * width).alias("center"), (F.col("count") / area).alias("pdf"), F.lit(width).alias("width"),
        (F.sum("count").over(w) / F.col("_n")).alias("cdf"), "count",
    )


def hist1d_discrete(df: DataFrame, x: str) -> DataFrame:
    """One bin per distinct value; a half-width is half the distance to the nearer neighbour's midpoint on each side.

    The distinct values are spread by range; the first and last of each partition (one row) tell its neighbours.
    """
    c = written(counted(df.where(finite(x)).select(F.col(x).cast("double").alias("value")), "value"))
    c = written(c.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    parts = Window.orderBy("_part")  # over one row a partition
    ends = c.groupBy("_part").agg(F.min("value").alias("_first"), F.max("value").alias("_last"))
    ends = ends.select("_part", F.lag("_last").over(parts).alias("_below"), F.lead("_first").over(parts).alias("_above"))
    w = Window.partitionBy("_part").orderBy("value")
    left, right = F.col("value") - F.coalesce(F.lag("value").over(w), F.col("_below")), F.coalesce(F.lead("value").over(w), F.col("_above")) - F.col("value")
    return c.join(ends, "_part").select("value", F.col("n").alias("count"), (F.coalesce(left + right, 2 * right, 2 * left, F.lit(0.0)) / 2).alias("width"), ((F.col("before") + F.col("n")) / F.col("total")).alias("cdf"))


def log_counts(hist: DataFrame) -> DataFrame:
    """Of hist1d(): bin_id, lower_edge and log10 of the count, null for an empty bin."""
    return hist.select("bin_id", (F.col("center") - F.col("width") / 2).alias("lower_edge"), F.when(F.col("count") > 0, F.log10(F.col("count").cast("double"))).alias("log_count"))


def mass_function(hist: DataFrame, volume: float) -> DataFrame:
    """Of hist1d(norm=True): the density as a number in each unit of volume and of x."""
    n = F.sum("count").over(Window.partitionBy())  # over the bins
    return hist.withColumn("pdf", F.col("pdf") * n / F.lit(volume))


def fractions(df: DataFrame, x: str, value: str, n_bins: int, over: float = 0.8, under: tuple[float, ...] = (0.6, 0.4)) -> DataFrame:
    """bin_id, lower_edge, and of the rows in each bin the shares with a value over a limit, not over it, and not over the
    lower ones; null for an empty bin."""
    lo, hi = span(df, x)
    width, v = (hi - lo) / n_bins, F.col(value)
    share = {"over": v > over, "rest": ~F.coalesce(v > over, F.lit(False)), **{f"under_{i + 1}": v <= u for i, u in enumerate(under)}}
    shares = bucket(df, x, n_bins, lo, hi).groupBy("bin_id").agg(*((F.count_if(c) / F.count("*")).alias(k) for k, c in share.items()))
    grid = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin_id"))
    return grid.join(shares, "bin_id", "left").select("bin_id", (F.lit(lo) + F.col("bin_id") * width).alias("lower_edge"), *share)


def _merge_hist(rows: pd.DataFrame, least: int, reach: float, width: float) -> pd.DataFrame:
    bins = [[float(c), width / 2, int(n), float(n)] for c, n in zip(rows.sort_values("bin_id")["center"], rows.sort_values("bin_id")["count"], strict=True)]
    while True:
        best = None
        for i, (_, half, n, _p) in enumerate(bins):
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(bins) and bins[j][1] <= reach * width]
            if n and n <= least and half <= reach * width and near:
                j = min(near, key=lambda k: bins[k][2])
                if best is None or (n, bins[j][2]) < best[0]:
                    best = ((n, bins[j][2]), i, j)
        if best is None:
            return pd.DataFrame([(i, c, 2 * h, n, p) for i, (c, h, n, p) in enumerate(bins)], columns=["bin_id", "center", "width", "count", "pdf"])
        a, b = sorted(best[1:])
        (c1, h1, n1, p1), (c2, h2, n2, p2) = bins[a], bins[b]
        bins[a : b + 1] = [[(c1 - h1 + c2 + h2) / 2, h1 + h2, n1 + n2, (p1 * h1 + p2 * h2) / (h1 + h2)]]


def hist1d_adaptive(df: DataFrame, x: str, n_bins: int, least: int, reach: float = 5.0) -> DataFrame:
    """hist1d whose thin bins merge into the emptier neighbour; the loop runs over the bins, not the data."""
    lo, hi = span(df, x)
    width = (hi - lo) / n_bins
    return hist1d(df, x, n_bins).groupBy().applyInPandas(lambda r: _merge_hist(r, least, reach, width), "bin_id int, center double, width double, count long, pdf double")


def hist2d(df: DataFrame, x: str, y: str, nx: int, ny: int, log: bool = False, smooth: bool = False, norm: bool = False, by: list[str] | None = None) -> DataFrame:
    """ix, iy, x_lo, y_lo, z on a dense grid. log: log10, -10 for empty cells; smooth: 1-2-1 by 1-2-1 inside, 0 at the border.

    With `by` each group has a grid of its own, over its own range, all in one pass.
    """
    by = by or []
    rows = _grouped(df.select(*by, x, y), by, x, y)
    ends = [f"{c}_{e}" for c in (x, y) for e in ("lo", "hi")]
    cells = written(rows.groupBy(*by, *ends, _cell(x, nx).alias("ix"), _cell(y, ny).alias("iy")).agg(F.count("*").cast("double").alias("z")))
    at = F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1)))
    grid = cells.select(*by, *ends).distinct().withColumn("_i", at).select(*by, *ends, F.floor(F.col("_i") / ny).cast("int").alias("ix"), (F.col("_i") % ny).cast("int").alias("iy"))
    key = [*by, "ix", "iy"]
    out = grid.join(cells.drop(*ends), key, "left").na.fill(0.0, ["z"])
    wx, wy = (F.col(f"{x}_hi") - F.col(f"{x}_lo")) / nx, (F.col(f"{y}_hi") - F.col(f"{y}_lo")) / ny
    if norm:
        out = out.withColumn("z", F.col("z") / (F.sum("z").over(Window.partitionBy(*by)) * wx * wy))  # over nx * ny cells
    if log:
        out = out.withColumn("z", F.when(F.col("z") > 0, F.log10("z")).otherwise(F.lit(-10.0)))
    if smooth:
        kernel = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit((2 - abs(i)) * (2 - abs(j)) / 16).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
        spread = out.select(*key, "z", kernel.alias("k")).select(*by, (F.col("ix") + F.col("k.dx")).alias("ix"), (F.col("iy") + F.col("k.dy")).alias("iy"), (F.col("z") * F.col("k.w")).alias("z"))
        inside = F.col("ix").between(1, nx - 2) & F.col("iy").between(1, ny - 2)
        out = grid.join(spread.where(inside).groupBy(*key).agg(F.sum("z").alias("z")), key, "left").na.fill(0.0, ["z"])
    return out.select(*key, (F.col(f"{x}_lo") + F.col("ix") * wx).alias("x_lo"), (F.col(f"{y}_lo") + F.col("iy") * wy).alias("y_lo"), "z")


def hist2d_scatter(df: DataFrame, x: str, y: str, nx: int, ny: int, k: int, order: list[str]) -> DataFrame:
    """The first k rows of each cell by `order`, with the cell's count z."""
    both = df.where(finite(x) & finite(y))
    (x0, x1), (y0, y1) = span(both, x), span(both, y)
    rows = bucket(bucket(both, x, nx, x0, x1, "ix"), y, ny, y0, y1, "iy")
    z = rows.groupBy("ix", "iy").agg(F.count("*").alias("z"))
    top = F.row_number().over(Window.partitionBy("ix", "iy").orderBy(*order))
    return rows.withColumn("_k", top).where(F.col("_k") <= k).drop("_k").join(z, ["ix", "iy"])


def spearman(df: DataFrame, x: str, y: str, tie: list[str]) -> DataFrame:
    """n and the rank correlation 1 - 6 sum d**2 / (n (n**2 - 1)); ties are broken by `tie`. Under two rows rho is null."""
    a = ranked(df.where(finite(x) & finite(y)).select(x, y, *tie), [x, *tie], "_rx")
    b = ranked(a, [y, *tie], "_ry")
    d = (F.col("_rx") - F.col("_ry")).cast("decimal(38,0)")
    return b.agg(F.count("*").alias("n"), F.sum(d * d).cast("double").alias("_d")).select("n", (1 - F.try_divide(6 * F.col("_d"), F.col("n").cast("double") * (F.col("n").cast("double") * F.col("n") - 1))).alias("rho"))


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with {c}_median of the finite values of each column, by ranks over a range exchange."""
    found = {c: order_values(df, c, lambda n: [(n - 1) // 2, n // 2]) for c in columns}
    row = tuple(sum(v) / 2 if v else None for v in found.values())
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{c}_median` double" for c in found))


def contingency(df: DataFrame, x: str, y: str, cut: float) -> DataFrame:
    """Code 1..4 of (x < cut, y < cut), counts and fractions."""
    a, b = F.col(x) < cut, F.col(y) < cut
    code = F.when(a & b, 1).when(a & ~b, 2).when(~a & b, 3).otherwise(4)
    return df.groupBy(code.alias("code")).agg(F.count("*").alias("n")).withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


def pdf_between(hist: DataFrame, lo: float, hi: float) -> DataFrame:
    """Fraction of the area of hist(center, pdf, width) strictly between lo and hi."""
    mass = F.col("pdf") * F.col("width")
    inside = (F.col("center") > lo) & (F.col("center") < hi)
    return hist.agg((F.sum(F.when(inside, mass).otherwise(0.0)) / F.sum(mass)).alias("fraction"))


def pdf_percentile(hist: DataFrame, percent: float) -> DataFrame:
    """The first centre whose cumulative percentage reaches percent; the last one for 100."""
    run = F.sum(F.col("pdf") * F.col("width")).over(Window.orderBy("center")) / F.sum(F.col("pdf") * F.col("width")).over(Window.partitionBy())
    return hist.withColumn("_c", run * 100).agg(F.coalesce(F.min(F.when(F.col("_c") >= percent, F.col("center"))), F.max("center")).alias("value"))


def effective_volume(percent_lo: float, percent_hi: float, box: float = 250.0) -> float:
    return (percent_hi - percent_lo) / 100 * box**3


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    c, d, k = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300), 0
    f = d
    while True:
        k += 1
        for t in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / ((1 + t * d) or 1e-300)
            c = (1 + t / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 4e-15:
            return f * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def bootstrap_ranks(n: int, share: float) -> int:
    """The 0-based rank that the upper median of resamples of n rows stays at or under with probability `share` at least."""
    middle, lo, hi = n // 2 + 1, 1, n
    while lo < hi:
        k = (lo + hi) // 2
        lo, hi = (lo, k) if beta_share(middle, n - middle + 1, k / n) >= share else (k + 1, hi)
    return lo - 1


def bootstrap_median(df: DataFrame, y: str, level: float = 0.95) -> DataFrame:
    """The interval of the median's bootstrap distribution, in the limit of infinitely many resamples.

    A resample's upper median is at most the value of rank k if more than half of n draws fall on the first k rows, a
    binomial probability. So the ends are two order statistics, and no row is drawn (Efron, 1979).
    """
    ends = order_values(df, y, lambda n: [bootstrap_ranks(n, (1 - level) / 2), bootstrap_ranks(n, (1 + level) / 2)])
    return df.sparkSession.createDataFrame([tuple(ends) or (None, None)], "ci_lo double, ci_hi double")


def match_downsample(df: DataFrame, ix: str, iy: str, key: str, n_x: int, seed: int = 1) -> DataFrame:
    """Of each cell keeps as many rows as the emptiest of the n_x cells in its y-row has, by a seeded hash of key."""
    n = df.groupBy(ix, iy).agg(F.count("*").alias("_n"))
    least = n.groupBy(iy).agg(F.when(F.count("*") < n_x, F.lit(0)).otherwise(F.min("_n")).alias("_keep"))
    rows = with_groups(df, least, [iy]).where("_keep > 0").withColumn("_h", F.xxhash64(key, F.lit(seed)))
    return ranked(rows, ["_h", key], "_r", [ix, iy]).where(F.col("_r") < F.col("_keep")).drop("_r", "_h", "_keep").select(*df.columns)
