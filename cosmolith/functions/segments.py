"""Scans along tracks of any length: long tracks are cut into segments, and what a segment needs of the others is carried.

A window by track puts a track's rows into one task. Here tracks of more than `longest` rows are cut at quantiles of their
order, so a window by track and segment is spread over tasks. A scan whose state combines associatively (a greatest value, the
last value that is not null, a count, a flag from behind) then needs of the other segments their summed-up state only: a
row for each segment of a long track, whose own scan is over as many rows as the track has segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.shared import written

LONGEST = 1 << 20  # rows of a track that are one segment
MOST_CUTS = 1000  # segments that a track is cut into
FEW = 100_000  # rows of a table that is broadcast


def small(df: DataFrame) -> DataFrame:
    """A written table for a join: broadcast where it is counted to be small."""
    return F.broadcast(df) if df.count() <= FEW else df


def under(edges: Column, x: Column, most: int, between: tuple[Column, Column] | None = None) -> Column:
    """How many of a rising array's elements are less than x, by bisection; between: that number is known to lie between
    these, at most `most` apart (else in the whole array, of at most `most` elements)."""
    lo, hi = between or (F.lit(0), F.size(edges))
    start = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        less = (acc["lo"] < acc["hi"]) & (F.get(edges, mid) < x)
        return F.struct(F.when(less, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(less, acc["hi"]).otherwise(F.least(mid, acc["hi"])).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most.bit_length() + 1))), start, step, lambda acc: acc["lo"])


@dataclass
class Segments:
    """rows: a table with _seg, 0 for a track of one segment; long: whether any track has more."""

    rows: DataFrame
    track: str
    t: str
    long: bool
    ties: Sequence[str] = ()

    def window(self, *also: str) -> WindowSpec:
        return Window.partitionBy(self.track, "_seg", *also).orderBy(self.t, *self.ties)

    def place(self) -> Column:
        """A row's place in its track, for max_by."""
        return F.struct(self.t, *self.ties)

    def _summed(self, **states: Column) -> DataFrame:
        """track, _seg and the states of each segment of a long track."""
        return self.rows.where("_long").groupBy(F.col(self.track).alias("_track"), F.col("_seg").alias("_s")).agg(*(c.alias(k) for k, c in states.items()))

    def carried(self, states: dict[str, Column], carry: Callable[[WindowSpec], dict[str, Column]]) -> Segments:
        """rows with carry's columns: windows over the states of the track's segments, in their order; null for other tracks.

        states are aggregates over a segment's rows.
        """
        made = carry(Window.partitionBy("_track").orderBy("_s"))
        if not self.long:
            return self.having(self.rows.withColumns({k: F.lit(None) for k in made}))
        found = small(written(self._summed(**states).select(F.col("_track"), "_s", *(c.alias(k) for k, c in made.items()))))
        on = F.col(self.track).eqNullSafe(F.col("_track")) & (F.col("_seg") == F.col("_s"))
        return self.having(self.rows.join(found, on, "left").drop("_track", "_s"))

    def having(self, rows: DataFrame) -> Segments:
        return Segments(rows, self.track, self.t, self.long, self.ties)

    def done(self, *drop: str) -> DataFrame:
        return self.rows.drop("_seg", "_long", *drop)


def segmented(df: DataFrame, track: str, t: str, longest: int | None = None, ties: Sequence[str] = ()) -> Segments:
    """df cut into segments of about `longest` rows; equal values of t are in one segment, where the columns `ties` order them.
    t is a number, date or timestamp."""
    longest = longest or LONGEST
    counts = df.groupBy(F.col(track).alias("_track")).count()
    most = counts.agg(F.max("count")).first()[0] or 0
    if most <= longest:
        return Segments(df.withColumns({"_seg": F.lit(0), "_long": F.lit(False)}), track, t, False, ties)
    counts = written(counts.where(F.col("count") > longest))
    n = min(MOST_CUTS, math.ceil(most / longest))
    same = F.col(track).eqNullSafe(F.col("_track"))
    at = ", ".join(f"{i / n!r}D" for i in range(1, n))
    cuts = df.join(small(counts.select("_track")), same).groupBy("_track").agg(F.expr(f"array_distinct(percentile_approx(`{t}`, array({at})))").alias("_cuts"))
    rows = df.join(small(written(cuts)), same, "left").withColumn("_long", F.col("_cuts").isNotNull())
    rows = rows.withColumn("_seg", F.when(F.col("_long"), F.coalesce(under(F.col("_cuts"), F.col(t), n), F.lit(0))).otherwise(0).cast("int"))
    return Segments(rows.drop("_track", "_cuts"), track, t, True, ties)


def bordered(df: DataFrame, track: str, t: str, before: int, after: int, longest: int | None = None, mirrored: bool = False, ties: Sequence[str] = ()) -> tuple[DataFrame, WindowSpec]:
    """(rows, window): rows of df with _ghost, and a window over them whose frames reach `before` rows back and `after` on.

    Long tracks are numbered through by their segments' counts and cut into blocks of `longest` rows; the rows within reach
    of a block's border are copied to it as ghosts, which the caller drops. mirrored: at a track's true ends its rows follow
    in mirrored order (d c b a | a b c d | d c b a), again and again where it has fewer rows than the reach. t must not repeat.
    """
    longest = max(longest or LONGEST, before, after, 1)
    cut = segmented(df, track, t, longest, ties)
    if not cut.long and not mirrored:
        return cut.rows.withColumns({"_ghost": F.lit(False), "_block": F.lit(0)}), Window.partitionBy(track, "_block").orderBy(t, *ties)
    counted = cut.carried({"_n": F.count(F.lit(1))}, lambda w: {"_earlier": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_all": F.sum("_n").over(Window.partitionBy("_track"))})
    own = F.row_number().over(counted.window()) - 1
    whole = F.count(F.lit(1)).over(Window.partitionBy(track, "_seg"))
    rows = counted.rows.withColumns({"_at": (F.coalesce("_earlier", F.lit(0)) + own).cast("long"), "_all": F.when(F.col("_long"), F.col("_all")).otherwise(whole).cast("long")})
    place = F.array(F.col("_at"))
    if mirrored:  # where the row stands again within reach of the ends: a series mirrored without end has period 2 * _all
        period = 2 * F.col("_all")
        image = lambda k: F.array(F.col("_at") + k * period, period - 1 - F.col("_at") + k * period)
        turns = F.sequence(-F.ceil(F.lit(before + 1) / period) - 1, F.ceil(F.lit(after + 1) / period) + 1)
        place = F.filter(F.flatten(F.transform(turns, image)), lambda p: (p >= -before) & (p < F.col("_all") + after))
    rows = rows.withColumn("_place", F.explode(place))
    block = lambda p: F.greatest(F.least(F.floor(p / longest), F.floor((F.col("_all") - 1) / longest)), F.lit(0))
    rows = rows.withColumn("_block", F.explode(F.sequence(block(F.col("_place") - after), block(F.col("_place") + before))))
    ghost = (F.col("_place") != F.col("_at")) | (block(F.col("_place")) != F.col("_block"))
    kept = rows.withColumn("_ghost", ghost).drop("_seg", "_long", "_earlier", "_all", "_at")
    return kept, Window.partitionBy(track, "_block").orderBy("_place")
