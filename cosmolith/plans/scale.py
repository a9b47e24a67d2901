"""Registered queries of what makes the operators hold at scale: long tracks, many ranges, brackets; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cosmolith.functions import astro
from cosmolith.operators import aggregates as agg
from cosmolith.operators import binning, grid, tracks
from cosmolith.plans.catalogue import _CELL, _POS, BOX, _events, _positions, _round, _t, query

# ---- tracks of a third of all rows, cut every 500 rows ----------------------------------------------------------

_LONG = "WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END track, event_type, value, cast(epoch_us(ts) // 1000000 AS bigint) * 100000000 + event_id t FROM events)"
_W = "(PARTITION BY track ORDER BY t"


def _long(spark, d):
    e = _events(spark, d)
    return e.select("event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("track"), "event_type", "value", (F.col("t") * 100_000_000 + F.col("event_id")).alias("t"))


@query(f"""{_LONG}, p AS (SELECT *, max(value) OVER {_W} ROWS UNBOUNDED PRECEDING) peak FROM e), q AS (SELECT *, sum(CASE WHEN value = peak THEN 1 ELSE 0 END) OVER {_W} ROWS UNBOUNDED PRECEDING) k FROM p)
SELECT event_id, peak, first(t) OVER w peak_time, round(min(value / nullif(peak, 0)) OVER w, 9) since_peak_min FROM q WINDOW w AS (PARTITION BY track, k ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def long_track_peaks(spark, d):
    return tracks.running_peak(_long(spark, d), "track", "t", "value", 500).select("event_id", "peak", "peak_time", F.round("since_peak_min", 9).alias("since_peak_min"))


@query(f"""{_LONG}, p AS (SELECT *, max(value) OVER {_W} ROWS UNBOUNDED PRECEDING) peak FROM e), s AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 WHEN value = peak THEN 0 END h FROM p)
SELECT event_id, coalesce(last_value(h IGNORE NULLS) OVER {_W} ROWS UNBOUNDED PRECEDING), 0) high_tf, max(CASE WHEN value < 1 THEN 1 ELSE 0 END) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) flag FROM s""")
def long_track_flags(spark, d):
    rows = _long(spark, d).withColumn("force", F.when(F.col("event_type") == "error", 2.0).otherwise(0.0))
    rows = tracks.high_tide_flag(rows, "track", "t", "force", "value", 500)
    return tracks.flag_back(rows, "track", "t", "value", 1.0, 500).select("event_id", "high_tf", "flag")


@query(f"""{_LONG}, o AS (SELECT *, CASE WHEN event_type <> 'error' AND lag(event_type) OVER {_W}) = 'error' THEN 1 ELSE 0 END x FROM e)
SELECT event_id, cast(sum(x) OVER {_W} ROWS UNBOUNDED PRECEDING) AS bigint) npt, round(avg(value) OVER {_W} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 6) smooth FROM o""")
def long_track_means(spark, d):
    rows = tracks.pass_through(_long(spark, d).withColumn("inside", F.col("event_type") == "error"), "track", "t", "inside", 500)
    return tracks.moving_average(rows, "track", "t", "value", 10, 500).select("event_id", "npt", F.round("smooth", 6).alias("smooth"))


@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 i, count(*) OVER () n FROM events),
 k AS (SELECT j, exp(-0.5 * (j / 5.0::double) ** 2) w FROM range(-20, 21) r(j)), s AS (SELECT sum(w) total FROM k),
 m AS (SELECT e.event_id, w, e.i + j p, n FROM e, k), r AS (SELECT event_id, w, ((p % (2 * n)) + 2 * n) % (2 * n) q, n FROM m)
SELECT r.event_id, round(sum(w / total * v.value), 6) smooth FROM r, s JOIN e v ON v.i = CASE WHEN q < r.n THEN q ELSE 2 * r.n - 1 - q END GROUP BY 1""")
def long_series_smooth(spark, d):
    """One series of all events, over many tasks."""
    from cosmolith.functions.shared import ranked

    e = ranked(_t(spark, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "i").withColumn("series", F.lit(1))
    return tracks.gaussian_smooth(e, "series", "i", ["value"], 5.0, 1000).join(e.select("i", "event_id"), "i").select("event_id", F.round("value_smooth", 6).alias("smooth"))


# ---- ten thousand ranges that overlap ----------------------------------------------------------------------------


@query("""WITH b AS (SELECT i bin_id, 10.0 * i lo, 10.0 * i + 5 + (i * 7919) % 400 hi FROM range(10000) r(i))
SELECT cast(bin_id AS int) bin_id, count(*) n, min(l_extendedprice) x_min, max(l_extendedprice) x_max FROM lineitem JOIN b ON l_extendedprice > lo AND l_extendedprice <= hi GROUP BY 1""")
def many_range_bins(spark, d):
    edges = [(10.0 * i, 10.0 * i + 5 + i * 7919 % 400) for i in range(10_000)]
    return binning.bin_counts(_t(spark, d, "lineitem"), "l_extendedprice", edges)


# ---- order statistics of many groups -----------------------------------------------------------------------------


@query("""WITH l AS (SELECT CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END k, l_extendedprice y FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y) - 1 r, count(*) OVER (PARTITION BY k) n FROM l),
 st AS (SELECT k, n, (max(CASE WHEN r = (n - 1) // 2 THEN y END) + max(CASE WHEN r = n // 2 THEN y END)) / 2 median, max(CASE WHEN r = least(cast(floor(n * cast(0.2 AS double)) AS bigint), n - 1) THEN y END) d20 FROM r GROUP BY 1, 2),
 dv AS (SELECT r.k, r.n, row_number() OVER (PARTITION BY r.k ORDER BY abs(y - median)) - 1 i, abs(y - median) dev FROM r JOIN st ON r.k IS NOT DISTINCT FROM st.k)
SELECT st.k, st.n, round(median, 6) median, round(d20, 6) d20, round(dev, 6) mad FROM st JOIN dv ON st.k IS NOT DISTINCT FROM dv.k AND i = st.n // 2""")
def group_order_stats(spark, d):
    """Groups by supplier, one of them (without a name) a third of all rows; always by sketched brackets."""
    rows = _t(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("k"), "l_extendedprice")
    return _round(agg.order_stats(rows, ["k"], "l_extendedprice", few=0).select("k", "n", "median", "d20", "mad"))


# ---- grids: extents across faces, wide kernels, dense boxes ------------------------------------------------------

_AXIS = """{a}c AS (SELECT structure, {a} i, count(*) n FROM v GROUP BY 1, 2), {a}g AS (SELECT *, i - lag(i) OVER (PARTITION BY structure ORDER BY i) gap FROM {a}c),
 {a}e AS (SELECT structure, max(gap) wide, arg_max(i, gap * 1000 - i) edge, ceil(sum(i * n) / cast(sum(n) AS double) - 0.5) mean, max(i) - min(i) = 15 across FROM {a}g GROUP BY 1),
 {a}m AS (SELECT c.structure, n, i + CASE WHEN NOT across THEN 0 WHEN mean >= 8 AND i < low THEN 16 WHEN mean < 8 AND i >= low THEN -16 ELSE 0 END i FROM {a}c c JOIN (SELECT *, CASE WHEN coalesce(wide, 1) > 1 THEN edge ELSE 8 END low FROM {a}e) e USING (structure)),
 {a}l AS (SELECT structure, i FROM {a}m, range(n) r), {a}r AS (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY i) - 1 r, count(*) OVER (PARTITION BY structure) k FROM {a}l),
 {a}o AS (SELECT structure, count(*) n, cast(ceil(avg(i) - 0.5) AS int) center_{a}, cast(trunc((max(CASE WHEN r = (k - 1) // 2 THEN i END) + max(CASE WHEN r = k // 2 THEN i END)) / 2.0) AS int) median_{a}, cast(min(i) AS int) min_{a}, cast(max(i) AS int) max_{a} FROM {a}r GROUP BY structure)"""


@query(f"""WITH {_POS}, v AS (SELECT least(structure, 4) + CASE WHEN y < 30 AND z > 40 THEN 10 ELSE 0 END structure, {", ".join(f"{_CELL.format(f'(({a} + 50) % 100)')} i{a}" for a in "xyz")} FROM p), {", ".join(_AXIS.format(a=a) for a in ("ix", "iy", "iz"))}
SELECT structure, ixo.n, {", ".join(f"{k}_{a}" for a in ("ix", "iy", "iz") for k in ("center", "median", "min", "max"))}, round(power(6.25, 3) * (max_ix - min_ix) * (max_iy - min_iy) * (max_iz - min_iz), 4) volume, round(6.25 * sqrt(ixo.n) / pi(), 6) radius
FROM ixo JOIN iyo USING (structure) JOIN izo USING (structure)""")
def structure_extents(spark, d):
    """Structures that cross faces of the box, with rounded means, medians and extents of what is put together."""
    p = _positions(spark, d)
    p = p.withColumn("structure", F.least(F.col("structure"), F.lit(4)) + F.when((F.col("y") < 30) & (F.col("z") > 40), 10).otherwise(0))
    p = p.withColumns({a: (F.col(a) + 50) % 100 for a in "xyz"})
    return grid.structure_extents(grid.voxelise(p, BOX, 16), BOX / 16, 16).withColumns({"volume": F.round("volume", 4), "radius": F.round("radius", 6)})


@query(f"""WITH {_POS}, v AS (SELECT id, {", ".join(f"least(greatest(cast(floor({a} / (100.0::double / 64)) AS int), 0), 63) i{a}" for a in "xyz")} FROM p), cube AS MATERIALIZED (SELECT ix, iy, iz, cast(count(*) AS double) v FROM v GROUP BY 1, 2, 3),
 k AS (SELECT d, exp(-(d * d) / (2 * power(12.0::double / (2 * sqrt(2 * ln(2))), 2))) w FROM range(-32, 32) r(d)), s AS (SELECT power(sum(w), 3) - 1 total FROM k),
 a AS MATERIALIZED (SELECT (ix - d + 128) % 64 ix, iy, iz, sum(v * w) v FROM cube, k GROUP BY 1, 2, 3), b AS MATERIALIZED (SELECT ix, (iy - d + 128) % 64 iy, iz, sum(v * w) v FROM a, k GROUP BY 1, 2, 3),
 l AS MATERIALIZED (SELECT b.* FROM b JOIN (SELECT DISTINCT ix, iy FROM v) USING (ix, iy)), c AS MATERIALIZED (SELECT ix, iy, (iz - d + 128) % 64 iz, sum(v * w) v FROM l, k GROUP BY 1, 2, 3)
SELECT v.id, round((c.v - cube.v) / total, 6) local_density FROM v JOIN c USING (ix, iy, iz) JOIN cube USING (ix, iy, iz), s""")
def local_density_wide(spark, d):
    """A reach of 32 voxels, 262 144 offsets, by three passes."""
    p = _positions(spark, d)
    cube = grid.voxelise(p, BOX, 64).groupBy("ix", "iy", "iz").agg(F.count("*").cast("double").alias("v"))
    return _round(grid.local_density(p, cube, BOX, 64, 32, 12.0).select("id", "local_density"))


_DENSE = "l_orderkey % 7 structure, 40 + l_extendedprice % 5 x, 40 + l_quantity / 20 y, 95 + (l_partkey % 1000) / 200.0::double z"
_FAR = " + ".join(f"power(least(abs(a.{c} - b.{c}), 100 - abs(a.{c} - b.{c})), 2)" for c in "xyz")


@query(f"WITH {_POS}, v AS (SELECT DISTINCT x, y, z FROM (SELECT {_DENSE} FROM lineitem)) SELECT a.id, round(sqrt(min({_FAR})), 6) dist FROM p a, v b GROUP BY 1")
def nearest_dense(spark, d):
    """All voxels in a dense corner of the box, at its face."""
    line = _t(spark, d, "lineitem")
    v = line.select((F.col("l_orderkey") % 7).alias("structure"), (40 + F.col("l_extendedprice") % 5).alias("x"), (40 + F.col("l_quantity") / 20).alias("y"), (95 + (F.col("l_partkey") % 1000) / 200.0).alias("z"))
    return grid.nearest_structure(_positions(spark, d).drop("structure"), v, BOX).select("id", F.round("dist", 6).alias("dist"))


@query("""WITH s AS (SELECT o_totalprice v, row_number() OVER (ORDER BY o_totalprice) - 1 r, count(*) OVER () n FROM orders), p AS (SELECT * FROM (VALUES (0.0), (1.0), (33.5), (50.0), (99.5)) t(percent))
SELECT cast(percent AS double) percent, v AS value FROM s JOIN p ON r = least(cast(floor(n * percent / 100) AS bigint), n - 1)""")
def price_percentiles(spark, d):
    """Ranks of a whole table by sketched brackets."""
    ask = [0.0, 1.0, 33.5, 50.0, 99.5]
    found = binning.order_values(_t(spark, d, "orders"), "o_totalprice", lambda n: [int(n * p / 100) for p in ask], few=0)
    return spark.createDataFrame(list(zip(ask, found, strict=True)), "percent double, value double")


# ---- normal variates by key --------------------------------------------------------------------------------------

_DRAWN = "list_transform(range(1, 65), lambda i: md5('7|' || event_id || '|' || user_id || '|' || i))"
_UNIT = "(cast('0x' || substr(h, {0}, 13) AS bigint) * power(2.0::double, -51) - 1)"


@query(f"""WITH d AS (SELECT event_id, value, list_filter(list_transform({_DRAWN}, lambda h: struct_pack(x := {_UNIT.format(1)}, w := power({_UNIT.format(1)}, 2) + power({_UNIT.format(14)}, 2))), lambda p: p.w > 0 AND p.w < 1)[1] p FROM events),
 z AS (SELECT event_id, value, p.x * sqrt(-2 * ln(p.w) / p.w) z FROM d) SELECT event_id, round(z, 6) draw, round(CASE WHEN value < 20 THEN -12 + 0.2 * z ELSE log10(value) - 9 END, 6) log_ssfr FROM z""")
def normal_draws(spark, d):
    """Specific rates with a normal draw for each galaxy at rest, the same under any partitioning."""
    e, key = _t(spark, d, "events").withColumns({"sfr": F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")), "log_mass": F.lit(9.0)}), ("event_id", "user_id")
    return e.select("event_id", F.round(astro.normal(*key, seed=7), 6).alias("draw"), F.round(F.log10(astro.dyn_ssfr("sfr", "log_mass", key=key, seed=7)), 6).alias("log_ssfr"))
