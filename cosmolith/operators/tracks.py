"""Window operators along tracks: a track is the rows of one object, ordered by time and, among equal times, by the columns `ties`."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.segments import Segments, bordered, segmented, small
from cosmolith.functions.shared import finite, written


def _w(track: str, order: str, ties: Sequence[str] = ()):
    return Window.partitionBy(track).orderBy(order, *ties)


def differences(df: DataFrame, track: str, t: str, m: str, ties: Sequence[str] = ()) -> DataFrame:
    """rate: (m_j - m_{j+1}) / (t_j - t_{j+1}) to the next row of the track; null at its end."""
    w = _w(track, t, ties)
    return df.withColumn("rate", F.try_divide(F.col(m) - F.lead(m).over(w), F.col(t) - F.lead(t).over(w)))


def normalised(df: DataFrame, track: str, t: str, columns: list[str], ties: Sequence[str] = ()) -> DataFrame:
    """Each column over its value at the track's last time."""
    last = Window.partitionBy(track).orderBy(F.desc(t), *(F.desc(c) for c in ties)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"{c}_norm": F.try_divide(F.col(c), F.first(c).over(last)) for c in columns})


def _so_far(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _peaks(cut: Segments, m: str) -> Segments:
    """With peak: the greatest m so far; a long track's segments carry the greatest of those before."""
    cut = cut.carried({"_m": F.max(m)}, lambda w: {"_carried": F.max("_m").over(_before(w))})
    own = F.max(m).over(_so_far(cut.window()))
    return cut.having(cut.rows.withColumn("peak", F.greatest(own, "_carried")).drop("_carried"))


def running_peak(df: DataFrame, track: str, t: str, m: str, longest: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """peak so far, its time, and the least m / peak since the peak was last raised (or met again).

    A long track is cut: what goes on over a segment's start is carried, the peak, when it was, and the least m since.
    """
    cut = _peaks(segmented(df, track, t, longest, ties), m)
    raised = F.coalesce(F.col(m) == F.col("peak"), F.lit(False))
    cut = cut.having(cut.rows.withColumn("_epoch", F.sum(raised.cast("int")).over(_so_far(cut.window()))))
    since = cut.window("_epoch")
    cut = cut.having(cut.rows.withColumns({"peak_time": F.first(t).over(_so_far(since)), "_least": F.min(m).over(_so_far(since))}))
    if cut.long:  # of a segment: the last time that the peak was raised, and the least m since or, if it was not, of all
        ends = cut.rows.where("_long").withColumn("_i", F.row_number().over(cut.window()))
        ends = ends.groupBy(F.col(track).alias("_track"), F.col("_seg").alias("_s")).agg(F.max_by(F.struct(F.when(F.col("_epoch") > 0, F.col("peak_time")).alias("at"), F.col("_least").alias("least")), "_i").alias("_e"))
        ends = ends.select("_track", "_s", F.col("_e.at").alias("_at"), F.col("_e.least").alias("_end"))
        by_seg = Window.partitionBy("_track").orderBy("_s")
        ends = ends.withColumn("_raised", F.count("_at").over(_so_far(by_seg)))
        group = _so_far(Window.partitionBy("_track", "_raised").orderBy("_s"))
        ends = ends.withColumns({"_time": F.first("_at", ignorenulls=True).over(group), "_low": F.min("_end").over(group)})
        ends = ends.select("_track", "_s", F.lag("_time").over(by_seg).alias("_time"), F.lag("_low").over(by_seg).alias("_low"))
        on = F.col(track).eqNullSafe(F.col("_track")) & (F.col("_seg") == F.col("_s"))
        open_ = (F.col("_epoch") == 0) & F.col("_time").isNotNull()  # the peak of an earlier segment still stands
        rows = cut.rows.join(small(written(ends)), on, "left").withColumns({"peak_time": F.when(open_, F.col("_time")).otherwise(F.col("peak_time")), "_least": F.when(open_, F.least("_least", "_low")).otherwise(F.col("_least"))})
        cut = cut.having(rows.drop("_track", "_s", "_time", "_low"))
    return cut.having(cut.rows.withColumn("since_peak_min", F.try_divide(F.col("_least"), F.col("peak")))).done("_epoch", "_least")


def moving_average(df: DataFrame, track: str, t: str, m: str, reach: int = 10, longest: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Mean of 2 * reach rows around each, with the window growing from the start and shrinking to the end of a track. Blocks of
    long tracks get the rows around their borders as ghosts."""
    rows, w = bordered(df, track, t, reach, reach - 1, longest, ties=ties)
    return rows.withColumn("smooth", F.avg(m).over(w.rowsBetween(-reach, reach - 1))).where("not _ghost").select(*df.columns, "smooth")


def flag_back(df: DataFrame, track: str, t: str, value: str, least: float, longest: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """flag is 1 where this or any later row of the track falls under least."""
    low = (F.col(value) < least).cast("int")
    cut = segmented(df, track, t, longest, ties).carried({"_low": F.max(low)}, lambda w: {"_later": F.max("_low").over(w.rowsBetween(1, Window.unboundedFollowing))})
    own = F.max(low).over(cut.window().rowsBetween(0, Window.unboundedFollowing))
    return cut.having(cut.rows.withColumn("flag", F.greatest(own, "_later"))).done("_later")


def pass_through(df: DataFrame, track: str, t: str, inside: str, longest: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """npt: how often the track has left the inside (a boolean column) so far."""
    cut = segmented(df, track, t, longest, ties)
    cut = cut.carried({"_end": F.max_by(F.struct(F.col(inside).alias("v")), cut.place())}, lambda w: {"_last": F.lag("_end").over(w)["v"]})
    first = F.row_number().over(cut.window()) == 1
    back = F.when(first, F.col("_last")).otherwise(F.lag(inside).over(cut.window()))
    cut = cut.having(cut.rows.withColumn("_out", ((~F.col(inside)) & F.coalesce(back, F.lit(False))).cast("int")))
    cut = cut.carried({"_sum": F.sum("_out")}, lambda w: {"_earlier": F.sum("_sum").over(_before(w))})
    return cut.having(cut.rows.withColumn("npt", F.sum("_out").over(_so_far(cut.window())) + F.coalesce("_earlier", F.lit(0)))).done("_last", "_out", "_earlier")


def _forward(cut: Segments, column: str) -> Segments:
    """column, null replaced by the last value before that is not; segments carry the last one of those before."""
    cut = cut.carried({"_v": F.max_by(F.struct(F.col(column).alias("v")), F.when(F.col(column).isNotNull(), cut.place()))}, lambda w: {"_held": F.last("_v", ignorenulls=True).over(_before(w))["v"]})
    own = F.last(column, ignorenulls=True).over(_so_far(cut.window()))
    return cut.having(cut.rows.withColumn(column, F.coalesce(own, "_held")).drop("_held"))


def carry_forward(df: DataFrame, track: str, t: str, column: str, longest: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    return _forward(segmented(df, track, t, longest, ties), column).done()


def high_tide_flag(df: DataFrame, track: str, t: str, force: str, m: str, longest: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """1 if the force is over 1; else 0 at a new peak of m; else what the row before has (0 at the start)."""
    cut = _peaks(segmented(df, track, t, longest, ties), m)
    set_ = F.when(F.col(force) > 1, 1).when(F.col(m) == F.col("peak"), 0)
    cut = _forward(cut.having(cut.rows.withColumn("high_tf", set_)), "high_tf")
    return cut.done("peak").na.fill(0, ["high_tf"])


def dynamical_rate(df: DataFrame, track: str, t: str, m: str, span: float, ties: Sequence[str] = ()) -> DataFrame:
    """rate over one span back: (m - m at t - span) / span, m interpolated on the track; from the first row if it is younger.

    The rows at or before t - span are found by a range frame, those after by the row that follows, so a track is read once.
    """
    w, by_time = _w(track, t, ties), _w(track, t)
    rows = df.withColumn("_next", F.struct(F.lead(t).over(w).alias("t"), F.lead(m).over(w).alias("m")))
    back = by_time.rangeBetween(Window.unboundedPreceding, -int(span)) if float(span).is_integer() else by_time.rangeBetween(Window.unboundedPreceding, -span)
    row = F.struct(F.col(t).alias("t"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)), F.col(m).alias("m"), F.col("_next").alias("n"))
    rows = rows.withColumn("_b", F.max(row).over(back))  # a range frame is ordered by t alone: of equal times the last by ties
    rows = rows.withColumn("_f", F.first(F.struct(F.col(t).alias("t"), F.col(m).alias("m"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col(t) - F.lit(span)
    share = F.try_divide((at - F.col("_b.t")).cast("double"), (F.col("_b.n.t") - F.col("_b.t")).cast("double"))
    before = F.col("_b.m") + (F.col("_b.n.m") - F.col("_b.m")) * share
    rate = F.when(F.col("_b").isNotNull(), (F.col(m) - before) / F.lit(float(span))).otherwise(F.try_divide(F.col(m) - F.col("_f.m"), (F.col(t) - F.col("_f.t")).cast("double")))
    return rows.withColumn("dyn_rate", rate).drop("_next", "_b", "_f")


def lag2_derivative(df: DataFrame, series: str, t: str, m: str, ties: Sequence[str] = ()) -> DataFrame:
    """Difference to the row two on; the last rows repeat the last derivative."""
    w = _w(series, t, ties)
    d = F.try_divide(F.lead(m, 2).over(w) - F.col(m), F.lead(t, 2).over(w) - F.col(t))
    return df.withColumn("derivative", d).transform(lambda x: carry_forward(x, series, t, "derivative", ties=ties))


def gaussian_smooth(df: DataFrame, series: str, t: str, columns: list[str], sigma: float, longest: int | None = None) -> DataFrame:
    """series, t and {c}_smooth: each column convolved with a Gaussian cut at 4 sigma, ends mirrored (the end value repeats).

    Series of any length: blocks of long ones get the rows within 4 sigma of their borders as ghosts, and a series' true
    ends their mirror images. A value that is null adds nothing. t must not repeat within a series.
    """
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = F.array(*(F.lit(w / sum(raw)) for w in raw))
    rows, w = bordered(df.select(series, t, *(F.col(c).cast("double").alias(c) for c in columns)), series, t, reach, reach, longest, mirrored=True)
    near = w.rowsBetween(-reach, reach)

    def smooth(c: str):
        values = F.collect_list(F.coalesce(F.col(c), F.lit(0.0))).over(near)  # 2 * reach + 1 values
        return F.aggregate(F.zip_with(kernel, values, lambda k, v: k * v), F.lit(0.0), lambda a, v: a + v)

    made = rows.withColumns({f"{c}_smooth": smooth(c) for c in columns})
    return made.where("not _ghost").select(series, t, *(f"{c}_smooth" for c in columns))


def trim_trailing_zeros(df: DataFrame, series: str, t: str, m: str) -> DataFrame:
    later = _w(series, t).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("_any", F.max((F.col(m) != 0).cast("int")).over(later)).where("_any = 1").drop("_any")


def normalise_by_baseline(df: DataFrame, baseline: DataFrame, t: str, columns: list[str]) -> DataFrame:
    """Each column over the baseline's value at its first time."""
    first = baseline.agg(*(F.min_by(c, t).alias(f"_{c}") for c in columns))
    return df.crossJoin(F.broadcast(first)).withColumns({c: F.try_divide(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))  # one row


def trapezoid_normalise(df: DataFrame, series: str, x: str, y: str) -> DataFrame:
    """y over the trapezoid area of its series; rows with y <= 0 are dropped first."""
    rows = df.where((F.col(y) > 0) & finite(y))
    w = _w(series, x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.least(F.col(y), F.lag(y).over(w)) + F.abs(F.col(y) - F.lag(y).over(w)) / 2)
    return rows.withColumn("_a", area).withColumn("y_norm", F.try_divide(F.col(y), F.sum("_a").over(Window.partitionBy(series)))).drop("_a")


def rescale_axis(df: DataFrame, series: str, x: str, lo: float, hi: float) -> DataFrame:
    """x of each series moved linearly onto [lo, hi]."""
    w = Window.partitionBy(series)
    share = F.try_divide(F.col(x) - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))
    return df.withColumn("x_scaled", F.lit(lo) + share * F.lit(hi - lo))


def mass_history(df: DataFrame, track: str, z: str, t: str, m: str) -> DataFrame:
    """Per epoch the upper median, sorted[n // 2], of m over the track's newest m, of its rate to the next older row, and of
    that rate over the newest m. z is an epoch's redshift (0 the newest), t its time; a track's oldest row has no rate."""
    from cosmolith.functions.shared import at_rank, counted

    w = _w(track, z)
    rate = F.try_divide(F.col(m) - F.lead(m).over(w), F.col(t) - F.lead(t).over(w))
    rows = df.withColumns({"_m0": F.first(m).over(w), "_rate": rate}).where(F.col("_rate").isNotNull())
    kinds = {"mass": F.try_divide(F.col(m), F.col("_m0")), "rate": F.col("_rate"), "specific_rate": F.try_divide(F.col("_rate"), F.col("_m0"))}
    long = rows.select(z, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.cast("double").alias("v")) for k, c in kinds.items()))).alias("s")).select(z, "s.*")
    c = counted(long.where(finite("v")), "v", [z, "k"])
    out = c.groupBy(z, "k").agg(F.max("total").alias("n"), at_rank("v", F.floor(F.col("total") / 2)).alias("v"))
    return out.groupBy(z).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in kinds))
