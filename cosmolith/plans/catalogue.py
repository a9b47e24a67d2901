"""Every registered query of the analytics operators over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.functions import astro
from cosmolith.functions.shared import finite, ranked
from cosmolith.operators import aggregates as agg
from cosmolith.operators import binning, catalog, forest, grid, profiles, tracks, tree

QUERIES: dict = {}
ORACLE_SQL: dict = {}
BOX = 100.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _rounded(name: str, digits: int) -> Column:
    """A double rounded as the SQL's round does it: times 10**digits to the next whole number, halves away from zero, and back, the
    sign of a zero kept. F.round goes by the shortest decimal instead, which tells other halves."""
    c, m = F.col(name), F.lit(10.0**digits)
    r = F.round(c * m) / m
    return F.when(r == 0, c * F.lit(0.0)).when(finite(r), r).otherwise(c)


# ---- binned averages, medians, histograms ------------------------------------------------------------------------


@query("""WITH s AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem),
 b AS (SELECT least(cast(floor((l_extendedprice - lo) / ((hi - lo) / 20)) AS int), 19) bin_id, l_quantity y FROM lineitem, s),
 m AS (SELECT bin_id, avg(y) mean FROM b GROUP BY 1)
SELECT cast(r.range AS int) bin_id, round(lo + r.range * ((hi - lo) / 20), 6) lower_edge, round(coalesce(mean, 0), 6) mean FROM range(20) r CROSS JOIN s LEFT JOIN m ON m.bin_id = r.range""")
def binned_avg(spark, d):
    return _round(agg.binned_avg(_t(spark, d, "lineitem"), "l_extendedprice", "l_quantity", 20))


_STATS = """n, round((max(CASE WHEN r = cast(floor((n - 1) / 2.0) AS bigint) THEN y END) + max(CASE WHEN r = cast(floor(n / 2.0) AS bigint) THEN y END)) / 2, 6) median,
 round(max(CASE WHEN r = greatest(least(cast(floor(n * cast(0.2 AS double)) AS bigint), n - 1), 0) THEN y END), 6) d20,
 round(max(CASE WHEN r = greatest(least(cast(ceil(n * cast(0.8 AS double)) AS bigint), n - 1), 0) THEN y END), 6) d80,
 round(max(CASE WHEN r = greatest(least(cast(floor(0.5 * n - cast(1.96 AS double) * sqrt(cast(0.25 AS double) * n) + 1) AS bigint), n - 1), 0) THEN y END), 6) ci_lo,
 round(max(CASE WHEN r = greatest(least(cast(ceil(0.5 * n + cast(1.96 AS double) * sqrt(cast(0.25 AS double) * n) - 1) AS bigint), n - 1), 0) THEN y END), 6) ci_hi"""


@query(f"""WITH s AS (SELECT min(l_quantity) lo, max(l_quantity) hi FROM lineitem),
 b AS (SELECT least(cast(floor((l_quantity - lo) / ((hi - lo) / 10)) AS int), 9) bin_id, l_extendedprice y FROM lineitem, s),
 r AS (SELECT bin_id, y, row_number() OVER (PARTITION BY bin_id ORDER BY y) - 1 r, count(*) OVER (PARTITION BY bin_id) n FROM b),
 st AS (SELECT bin_id, {_STATS} FROM r GROUP BY bin_id, n),
 md AS (SELECT bin_id, (max(CASE WHEN r = cast(floor((n - 1) / 2.0) AS bigint) THEN y END) + max(CASE WHEN r = cast(floor(n / 2.0) AS bigint) THEN y END)) / 2 m FROM r GROUP BY bin_id),
 dv AS (SELECT r.bin_id, n, abs(y - m) dev, row_number() OVER (PARTITION BY r.bin_id ORDER BY abs(y - m)) - 1 k FROM r JOIN md ON r.bin_id = md.bin_id),
 mad AS (SELECT bin_id, round(dev, 6) mad FROM dv WHERE k = cast(floor(n * cast(0.5 AS double)) AS bigint))
SELECT st.*, mad, round((lo + bin_id * ((hi - lo) / 10) + lo + (bin_id + 1) * ((hi - lo) / 10)) / 2, 6) center, round(s.lo + bin_id * ((hi - s.lo) / 10), 6) lo, round(s.lo + (bin_id + 1) * ((s.hi - s.lo) / 10), 6) hi FROM st JOIN mad USING (bin_id) CROSS JOIN s""")
def binned_median(spark, d):
    return _round(agg.binned_median(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10))


def _hist_sql(table: str, x: str, bins: int, norm: bool = False) -> str:
    pdf = f"c.n / (sum(c.n) OVER () * ((hi - lo) / {bins}))" if norm else "cast(c.n AS double)"
    return f"""WITH d AS (SELECT {x} x FROM {table}), s AS (SELECT min(x) lo, max(x) hi, count(*) n_all FROM d),
 b AS (SELECT least(cast(floor((x - lo) / ((hi - lo) / {bins})) AS int), {bins - 1}) bin_id, count(*) n FROM d, s WHERE x IS NOT NULL GROUP BY 1),
 c AS (SELECT cast(range AS int) bin_id, coalesce(n, 0) n FROM range({bins}) LEFT JOIN b ON bin_id = range)
SELECT bin_id, round(lo + (bin_id + cast(0.5 AS double)) * ((hi - lo) / {bins}), 6) center, round({pdf}, 9) pdf, round((hi - lo) / {bins}, 6) width, round(cast(sum(n) OVER (ORDER BY bin_id) AS double) / n_all, 9) cdf, n AS count FROM c, s"""


def _hist(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, k) for c, k in (("center", 6), ("width", 6), ("pdf", 9), ("cdf", 9))})


@query(_hist_sql("lineitem", "l_extendedprice", 30))
def hist1d_pdf_cdf(spark, d):
    return _hist(agg.hist1d(_t(spark, d, "lineitem"), "l_extendedprice", 30))


@query(_hist_sql("orders", "CASE WHEN o_totalprice > 0 THEN log10(o_totalprice) END", 25, True))
def hist1d_log_norm(spark, d):
    return _hist(agg.hist1d(_t(spark, d, "orders").withColumn("x", astro.safe_log10("o_totalprice")), "x", 25, norm=True))


@query("""WITH c AS (SELECT cast(l_quantity AS double) value, count(*) count FROM lineitem GROUP BY 1),
 w AS (SELECT *, value - lag(value) OVER o l, lead(value) OVER o - value r FROM c WINDOW o AS (ORDER BY value))
SELECT value, count, round(coalesce(l + r, 2 * r, 2 * l, 0) / 2, 9) width, round(cast(sum(count) OVER (ORDER BY value) AS double) / sum(count) OVER (), 9) cdf FROM w""")
def hist1d_discrete(spark, d):
    return _round(agg.hist1d_discrete(_t(spark, d, "lineitem"), "l_quantity"), 9)


_H2 = """WITH s AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM lineitem),
 c AS (SELECT least(cast(floor((l_quantity - x0) / ((x1 - x0) / 12)) AS int), 11) ix, least(cast(floor((l_extendedprice - y0) / ((y1 - y0) / 8)) AS int), 7) iy, count(*) n FROM lineitem, s GROUP BY 1, 2),
 g AS (SELECT cast(a.range AS int) ix, cast(b.range AS int) iy, coalesce(cast(n AS double), 0) z FROM range(12) a CROSS JOIN range(8) b LEFT JOIN c ON c.ix = a.range AND c.iy = b.range)"""
_H2_AT = "round(x0 + ix * ((x1 - x0) / 12), 6) x_lo, round(y0 + iy * ((y1 - y0) / 8), 6) y_lo"


@query(f"{_H2} SELECT ix, iy, {_H2_AT}, z FROM g, s")
def hist2d(spark, d):
    return _round(agg.hist2d(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 12, 8))


@query(f"""{_H2}, l AS (SELECT ix, iy, CASE WHEN z > 0 THEN log10(z) ELSE -10 END z FROM g),
 k AS (SELECT a.ix, a.iy, sum(b.z * (2 - abs(a.ix - b.ix)) * (2 - abs(a.iy - b.iy)) / 16) z FROM l a JOIN l b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 WHERE a.ix BETWEEN 1 AND 10 AND a.iy BETWEEN 1 AND 6 GROUP BY 1, 2)
SELECT g.ix, g.iy, round(x0 + g.ix * ((x1 - x0) / 12), 6) x_lo, round(y0 + g.iy * ((y1 - y0) / 8), 6) y_lo, round(coalesce(k.z, 0), 6) z FROM g LEFT JOIN k ON k.ix = g.ix AND k.iy = g.iy, s""")
def hist2d_log_smooth(spark, d):
    return _round(agg.hist2d(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 12, 8, log=True, smooth=True))


@query(f"{_H2} SELECT ix, iy, {_H2_AT}, round(z / (sum(z) OVER () * ((x1 - x0) / 12) * ((y1 - y0) / 8)), 12) z FROM g, s")
def hist2d_norm(spark, d):
    return _round(agg.hist2d(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 12, 8, norm=True), 12).withColumns({c: F.round(c, 6) for c in ("x_lo", "y_lo")})


@query("""WITH r AS (SELECT (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 100.0 / count(*) OVER () x, (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) * 100.0 / count(*) OVER () y FROM orders)
SELECT least(cast(floor(cast(x AS double) / 10) AS int), 9) ix, least(cast(floor(cast(y AS double) / 10) AS int), 9) iy, count(*) z FROM r GROUP BY 1, 2""")
def hist2d_rank(spark, d):
    o = _t(spark, d, "orders").select("o_totalprice", "o_custkey", "o_orderkey")
    n = o.count()
    r = ranked(ranked(o, ["o_totalprice", "o_orderkey"], "rx"), ["o_custkey", "o_orderkey"], "ry")
    cell = lambda c: F.least(F.floor(F.col(c) * 100.0 / n / 10), F.lit(9)).cast("int")
    return r.groupBy(cell("rx").alias("ix"), cell("ry").alias("iy")).agg(F.count("*").alias("z"))


@query("""WITH s AS (SELECT min(o_totalprice) x0, max(o_totalprice) x1, min(o_custkey) y0, max(o_custkey) y1 FROM orders),
 c AS (SELECT o_orderkey, least(cast(floor((o_totalprice - x0) / ((x1 - x0) / 10)) AS int), 9) ix, least(cast(floor((o_custkey - y0) / ((y1 - y0) / 10.0)) AS int), 9) iy FROM orders, s),
 k AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY o_orderkey) k, count(*) OVER (PARTITION BY ix, iy) z FROM c)
SELECT o_orderkey, ix, iy, z FROM k WHERE k <= 3""")
def hist2d_scatter(spark, d):
    return agg.hist2d_scatter(_t(spark, d, "orders"), "o_totalprice", "o_custkey", 10, 10, 3, ["o_orderkey"]).select("o_orderkey", "ix", "iy", "z")


# ---- thresholds --------------------------------------------------------------------------------------------------


def _bins(spark, d, table, x, spec):
    df = _t(spark, d, table)
    return _round(binning.assign_bins(df, x, binning.bin_edges(df, x, spec)).groupBy("bin_id", "lo", "hi").agg(F.count("*").alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max")))


def _bins_sql(table: str, x: str, edges: str) -> str:
    return f"""WITH v AS (SELECT {x} x, row_number() OVER (ORDER BY {x}) - 1 r, count(*) OVER () c FROM {table}), e AS ({edges})
SELECT cast(bin_id AS int) bin_id, round(lo, 6) lo, round(hi, 6) hi, count(*) n, round(min(x), 6) x_min, round(max(x), 6) x_max FROM v JOIN e ON x > lo AND x <= hi GROUP BY ALL"""


@query(_bins_sql("customer", "c_acctbal", "SELECT i.range bin_id, a.x lo, b.x hi FROM range(5) i JOIN v a ON a.r = i.range * (a.c // 5) JOIN v b ON b.r = CASE WHEN i.range = 4 THEN b.c - 1 ELSE (i.range + 1) * (b.c // 5) END"))
def equal_count_bins(spark, d):
    return _bins(spark, d, "customer", "c_acctbal", "5")


@query(_bins_sql("orders", "o_totalprice", "SELECT i.range bin_id, a.x lo, b.x hi FROM range(3) i JOIN v a ON a.r = [0, a.c // 4, a.c * 3 // 4][i.range + 1] JOIN v b ON b.r = [b.c // 4, b.c * 3 // 4, b.c - 1][i.range + 1]"))
def three_q_bins(spark, d):
    return _bins(spark, d, "orders", "o_totalprice", "3Q")


@query(_bins_sql("orders", "o_totalprice", "SELECT i.range bin_id, a.x lo, b.x hi FROM range(4) i JOIN v a ON a.r = [0, a.c * 10 // 100, a.c * 50 // 100, a.c * 90 // 100][i.range + 1] JOIN v b ON b.r = [b.c * 10 // 100, b.c * 50 // 100, b.c * 90 // 100, b.c - 1][i.range + 1]"))
def percent_bins(spark, d):
    return _bins(spark, d, "orders", "o_totalprice", "%[10,50,90]")


@query(_bins_sql("orders", "o_totalprice", "SELECT * FROM (VALUES (0, cast('-inf' AS double), 100000.0), (1, 50000.0, 200000.0), (2, 300000.0, cast('inf' AS double))) t(bin_id, lo, hi)"))
def range_bins(spark, d):
    return _bins(spark, d, "orders", "o_totalprice", "r[:100000,50000:200000,300000:]")


@query(_bins_sql("customer", "c_acctbal", "SELECT 0 bin_id, (SELECT min(x) FROM v) lo, 0.0 hi UNION ALL SELECT 1, 0.0, 5000.0 UNION ALL SELECT 2, 5000.0, (SELECT max(x) FROM v)"))
def value_bins(spark, d):
    return _bins(spark, d, "customer", "c_acctbal", "[0,5000]")


@query("""WITH s AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), t AS (SELECT l_returnflag, count(*) n FROM lineitem GROUP BY 1),
 b AS (SELECT l_returnflag, least(cast(floor((l_extendedprice - lo) / ((hi - lo) / 10)) AS int), 9) bin_id, count(*) n FROM lineitem, s GROUP BY 1, 2),
 g AS (SELECT t.l_returnflag, cast(range AS int) bin_id, t.n n_all, coalesce(b.n, 0) c FROM t CROSS JOIN range(10) LEFT JOIN b ON b.bin_id = range AND b.l_returnflag = t.l_returnflag)
SELECT l_returnflag, bin_id, round(lo + (bin_id + cast(0.5 AS double)) * ((hi - lo) / 10), 6) center, cast(c AS double) pdf, round((hi - lo) / 10, 6) width, round(cast(sum(c) OVER (PARTITION BY l_returnflag ORDER BY bin_id) AS double) / n_all, 9) cdf, c AS count FROM g, s""")
def binned_hist1d(spark, d):
    return _hist(agg.hist1d(_t(spark, d, "lineitem"), "l_extendedprice", 10, by=["l_returnflag"]))


# ---- ranks, contingency, distributions ---------------------------------------------------------------------------


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) a, row_number() OVER (ORDER BY o_custkey, o_orderkey) b FROM orders)
SELECT count(*) n, round(1 - 6 * cast(sum((a - b) * (a - b)) AS double) / (cast(count(*) AS double) * (cast(count(*) AS double) * count(*) - 1)), 9) rho FROM r""")
def spearman(spark, d):
    return _round(agg.spearman(_t(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderkey"]), 9)


@query("""WITH c AS (SELECT CASE WHEN p_size < 25 AND p_retailprice < 1400 THEN 1 WHEN p_size < 25 THEN 2 WHEN p_retailprice < 1400 THEN 3 ELSE 4 END code FROM part)
SELECT code, count(*) n, round(cast(count(*) AS double) / sum(count(*)) OVER (), 9) fraction FROM c GROUP BY 1""")
def quiescent_fractions(spark, d):
    p = _t(spark, d, "part").select(F.col("p_size") / 25.0, (F.col("p_retailprice") / 1400.0)).toDF("a", "b")
    return _round(agg.contingency(p, "a", "b", 1.0), 9)


@query("""SELECT round((SELECT quantile_cont(o_totalprice, 0.5) FROM orders), 6) median_x, round((SELECT quantile_cont(o_custkey, 0.5) FROM orders), 6) median_y, round(avg(o_totalprice), 4) mean_x, round(avg(o_custkey), 4) mean_y FROM orders""")
def plot_stats(spark, d):
    o = _t(spark, d, "orders").select("o_totalprice", "o_custkey")
    middle = agg.medians(o, o.columns).toDF("median_x", "median_y")
    means = o.agg(F.round(F.avg("o_totalprice"), 4).alias("mean_x"), F.round(F.avg("o_custkey"), 4).alias("mean_y"))
    return means.crossJoin(middle.select(F.round("median_x", 6).alias("median_x"), F.round("median_y", 6).alias("median_y")))  # one row each


@query("""WITH s AS (SELECT min(o_totalprice) x0, max(o_totalprice) x1 FROM orders), c AS (SELECT least(cast(floor((o_totalprice - x0) / ((x1 - x0) / 6)) AS int), 5) ix, o_custkey % 5 iy FROM orders, s),
 n AS (SELECT ix, iy, count(*) n FROM c GROUP BY 1, 2), k AS (SELECT iy, CASE WHEN count(*) < 6 THEN 0 ELSE min(n) END k FROM n GROUP BY 1)
SELECT ix, iy, k n FROM n JOIN k USING (iy) WHERE k > 0""")
def match_downsample_counts(spark, d):
    o = _t(spark, d, "orders")
    c = binning.bucket(o, "o_totalprice", 6, *binning.span(o, "o_totalprice"), "ix").withColumn("iy", F.col("o_custkey") % 5)
    return agg.match_downsample(c, "ix", "iy", "o_orderkey", 6).groupBy("ix", "iy").agg(F.count("*").alias("n"))


_PDF = """WITH d AS (SELECT o_totalprice x FROM orders), s AS (SELECT min(x) lo, max(x) hi FROM d), b AS (SELECT least(cast(floor((x - lo) / ((hi - lo) / 50)) AS int), 49) i, count(*) n FROM d, s GROUP BY 1),
 h AS (SELECT lo + (i + cast(0.5 AS double)) * ((hi - lo) / 50) c, n FROM b, s)"""


@query(f"{_PDF} SELECT round(cast(sum(CASE WHEN c > 100000 AND c < 200000 THEN n ELSE 0 END) AS double) / sum(n), 9) fraction FROM h")
def pdf_integrate(spark, d):
    return _round(agg.pdf_between(agg.hist1d(_t(spark, d, "orders"), "o_totalprice", 50), 100000, 200000), 9)


@query(f"{_PDF}, r AS (SELECT c, 100 * cast(sum(n) OVER (ORDER BY c) AS double) / sum(n) OVER () p FROM h) SELECT round(min(c), 6) value FROM r WHERE p >= 75")
def pdf_percentile(spark, d):
    return _round(agg.pdf_percentile(agg.hist1d(_t(spark, d, "orders"), "o_totalprice", 50), 75))


# ---- catalogues --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey id, o_totalprice, c.c_acctbal, c.c_nationkey FROM orders LEFT JOIN customer c ON o_custkey = c_custkey")
def catalog_merge(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("cust"), "c_acctbal", "c_nationkey")
    return catalog.merge(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), "o_totalprice"), c, "cust").select("id", "o_totalprice", "c_acctbal", "c_nationkey")


@query("SELECT o_custkey id, count(*) n_target, cast(1 AS bigint) n_other FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1 HAVING count(*) <> 1 UNION ALL SELECT c_custkey, 0, 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def merge_mismatches(spark, d):
    return catalog.not_one_to_one(_t(spark, d, "orders").select(F.col("o_custkey").alias("id")), _t(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT event_id, round(value * power(1 + z, 1), 9) AS value, z FROM events JOIN (VALUES ('click', 0.0::double), ('view', 1.0), ('purchase', 2.0), ('signup', 3.0), ('error', 4.0)) t(k, z) ON event_type = k")
def stack_rescale(spark, d):
    e = _t(spark, d, "events").select("event_id", "value", "event_type")
    return catalog.stack({z: e.where(F.col("event_type") == k).drop("event_type") for k, z in (("click", 0), ("view", 1), ("purchase", 2), ("signup", 3), ("error", 4))}, {"value": 1}).withColumn("value", F.round("value", 9))


@query("SELECT p_partkey, p_name, p_type, p_retailprice, p_size, p_brand FROM part")
def reorder_fields(spark, d):
    return catalog.move_last(_t(spark, d, "part"), ["p_retailprice", "p_size", "p_brand"])


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE abs(l_tax - 0.04) < 1e-6")
def select_epoch(spark, d):
    return catalog.select_epoch(_t(spark, d, "lineitem"), "l_tax", 0.04).select("l_orderkey", "l_linenumber", "l_tax")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 100 AND c_nationkey <= 12 AND c_mktsegment = 'BUILDING'")
def limited_catalog(spark, d):
    return catalog.limited(_t(spark, d, "customer"), {"c_acctbal": (100, -1), "c_nationkey": (-1, 12)}, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_acctbal")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 e, (l_discount + 0.5) p, (l_tax + 0.3) m FROM lineitem)
SELECT l_orderkey, l_linenumber, round(e - p, 9) da_peak, round(11.5570 * (asinh(1.50244 * power(e, 1.5)) - asinh(1.50244 * power(p, 1.5))), 6) dt_peak, round(e - m, 9) da_merger, round(11.5570 * (asinh(1.50244 * power(e, 1.5)) - asinh(1.50244 * power(m, 1.5))), 6) dt_merger FROM a""")
def derived_epochs(spark, d):
    a = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("e"), (F.col("l_discount") + 0.5).alias("p"), (F.col("l_tax") + 0.3).alias("m"))
    return catalog.derived_epochs(a, "e", "p", "m").select("l_orderkey", "l_linenumber", *(F.round(c, 9 if c[1] == "a" else 6).alias(c) for c in ("da_peak", "dt_peak", "da_merger", "dt_merger")))


@query("""SELECT l_orderkey, l_partkey, l_quantity, o.o_totalprice, c.c_acctbal FROM lineitem JOIN (SELECT o_orderkey, o_totalprice, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) = 1) o ON l_orderkey = o_orderkey JOIN customer c ON c_custkey = o_custkey WHERE l_linenumber = 1""")
def central_sam_join(spark, d):
    j = catalog.central_join(_t(spark, d, "lineitem"), _t(spark, d, "orders"), _t(spark, d, "customer"), "l_orderkey", "o_orderkey", "o_custkey", "c_custkey", F.col("l_linenumber") == 1, "o_orderdate")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return j.join(o, "l_orderkey").select("l_orderkey", "l_partkey", "l_quantity", "o_totalprice", "c_acctbal")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 a, l_extendedprice / 1000 r, l_quantity rs, l_discount b, l_tax c, 10 + l_quantity / 10.0 m, 0.307 * power(l_quantity / 50.0, -3.0) y FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1.0 / a - 1, 6) z, round(11.5570 * asinh(1.50244 * power(a, 1.5)), 6) age, round(power(rs, 3) * (ln((rs + r) / rs) - r / (rs + r)), 6) nfw, round(1 - sqrt(b * b + c * c) / sqrt(2), 6) elongation,
 round(power((18 * pi() * pi() + 82 * (y / (y + 0.693) - 1) - 39 * power(y / (y + 0.693) - 1, 2)) / (y / (y + 0.693)) * 3 * power(0.06934, 2) * (y + 0.693) / (8 * pi()), -0.5), 6) t_dyn,
 round(log10(power(10, -1.959715 + 11.483698 - log10(power(10, -1.84754 * (m - 11.483698)) + 1) + 3.85767 * power(log10(1 + exp(m - 11.483698)), 0.44557) / (1 + exp(power(10, 11.483698 - m))) + log10(2) - 3.85767 * power(log10(2), 0.44557) / (1 + exp(1))) / 0.678), 6) log_stellar FROM d""")
def domain_functions(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("a"), (F.col("l_extendedprice") / 1000).alias("r"), F.col("l_quantity").alias("rs"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"), (10 + F.col("l_quantity") / 10.0).alias("m"))
    return _round(li.select("l_orderkey", "l_linenumber", astro.redshift("a").alias("z"), astro.cosmic_time("a").alias("age"), astro.nfw_mass("r", "rs").alias("nfw"), astro.elongation("b", "c").alias("elongation"), astro.dynamical_time("a").alias("t_dyn"), F.log10(astro.stellar_mass("m")).alias("log_stellar")))


def _positions(spark, d) -> DataFrame:
    e = _t(spark, d, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("structure"), *(F.pmod(F.col("embedding")[i].cast("double") * 40 + BOX / 2, F.lit(BOX)).alias(a) for i, a in enumerate("xyz")))


_POS = "p AS (SELECT vec_id id, label structure, " + ", ".join(f"(cast(embedding[{i + 1}] AS double) * 40 + 50) - 100 * floor((cast(embedding[{i + 1}] AS double) * 40 + 50) / 100) {a}" for i, a in enumerate("xyz")) + " FROM embeddings)"


@query(f"WITH {_POS}, r AS (SELECT id, degrees(acos(z / sqrt(x * x + y * y + z * z))) a, degrees(atan(y / x)) b FROM p) SELECT id, round(CASE WHEN a > 90 THEN 90 - a ELSE a END, 6) xrot, round(b, 6) zrot FROM r")
def viz_angles(spark, d):
    a, b = astro.rotation("x", "y", "z")
    return _round(_positions(spark, d).select("id", a.alias("xrot"), b.alias("zrot")))


# ---- tracks ------------------------------------------------------------------------------------------------------

_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_EV = "WITH e AS (SELECT event_id, user_id, event_type, value, cast(epoch_us(ts) // 1000000 AS bigint) t FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 step FROM e)"


_TIES = ("event_id",)  # orders the events of a user and second, as in the SQL of steps


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.floor(F.expr(_US) / 1000000).cast("long").alias("t"))


@query(f"{_EV} SELECT event_id, round((value - lead(value) OVER w) / nullif(t - lead(t) OVER w, 0), 9) rate FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def progenitor_diff(spark, d):
    return tracks.differences(_events(spark, d), "user_id", "t", "value", ties=_TIES).select("event_id", _rounded("rate", 9).alias("rate"))


@query(f"""{_EV}, p AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) peak FROM e), q AS (SELECT *, sum(CASE WHEN value = peak THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) k FROM p)
SELECT event_id, peak, first(t) OVER w peak_time, round(min(value / nullif(peak, 0)) OVER w, 9) since_peak_min FROM q WINDOW w AS (PARTITION BY user_id, k ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def running_peak(spark, d):
    return tracks.running_peak(_events(spark, d), "user_id", "t", "value", ties=_TIES).select("event_id", "peak", "peak_time", _rounded("since_peak_min", 9).alias("since_peak_min"))


@query(f"{_EV} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING), 6) smooth FROM e")
def moving_avg(spark, d):
    return tracks.moving_average(_events(spark, d), "user_id", "t", "value", ties=_TIES).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"{_EV} SELECT event_id, max(CASE WHEN value < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) flag FROM e")
def flag_back(spark, d):
    return tracks.flag_back(_events(spark, d), "user_id", "t", "value", 1.0, ties=_TIES).select("event_id", "flag")


@query(f"{_EV}, o AS (SELECT *, CASE WHEN event_type <> 'error' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY t) = 'error' THEN 1 ELSE 0 END x FROM e) SELECT event_id, sum(x) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) npt FROM o")
def passthrough_count(spark, d):
    return tracks.pass_through(_events(spark, d).withColumn("inside", F.col("event_type") == "error"), "user_id", "t", "inside", ties=_TIES).select("event_id", "npt")


@query(f"""{_EV}, n AS (SELECT *, lead(t) OVER w nt, lead(value) OVER w nv, first(t) OVER w ft, first(value) OVER w fv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 j AS (SELECT a.event_id, a.t, a.value, a.ft, a.fv, b.t bt, b.value bv, b.nt, b.nv FROM n a ASOF LEFT JOIN n b ON a.user_id = b.user_id AND a.t - 86400 >= b.t)
SELECT event_id, round(CASE WHEN bt IS NOT NULL THEN (value - (bv + (nv - bv) * (t - 86400 - bt) / (nt - bt))) / 86400.0 ELSE (value - fv) / nullif(t - ft, 0) END, 9) dyn_rate FROM j""")
def dyn_time_avg(spark, d):
    return tracks.dynamical_rate(_events(spark, d), "user_id", "t", "value", 86400, ties=_TIES).select("event_id", F.round("dyn_rate", 9).alias("dyn_rate"))


@query(f"{_EV}, l AS (SELECT event_id, value / nullif(first(value) OVER (PARTITION BY user_id ORDER BY t DESC), 0) v FROM e) SELECT event_id, round(v, 9) value_norm FROM l")
def normalise_last(spark, d):
    return tracks.normalised(_events(spark, d), "user_id", "t", ["value"], ties=_TIES).select("event_id", F.round("value_norm", 9).alias("value_norm"))


@query(f"{_EV}, g AS (SELECT *, (lead(value, 2) OVER w - value) / nullif(lead(t, 2) OVER w - t, 0) dd FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, round(last_value(dd IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 9) derivative FROM g")
def lag2_derivative(spark, d):
    return tracks.lag2_derivative(_events(spark, d), "user_id", "t", "value", ties=_TIES).select("event_id", _rounded("derivative", 9).alias("derivative"))


@query(f"""{_EV}, p AS (SELECT *, max(value) OVER w peak FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 WHEN value = peak THEN 0 END h FROM p)
SELECT event_id, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 0) high_tf FROM s""")
def high_tide(spark, d):
    e = _events(spark, d).withColumn("force", F.when(F.col("event_type") == "error", 2.0).otherwise(0.0))
    return tracks.high_tide_flag(e, "user_id", "t", "force", "value", ties=_TIES).select("event_id", "high_tf")


@query(f"{_EV}, v AS (SELECT * FROM f WHERE value > 0), a AS (SELECT *, (step - lag(step) OVER w) * (least(value, lag(value) OVER w) + abs(value - lag(value) OVER w) / 2) area FROM v WINDOW w AS (PARTITION BY user_id ORDER BY step)) SELECT event_id, round(value / nullif(sum(area) OVER (PARTITION BY user_id), 0), 9) y_norm FROM a")
def trapezoid_norm(spark, d):
    return tracks.trapezoid_normalise(_steps(spark, d), "user_id", "step", "value").select("event_id", F.round("y_norm", 9).alias("y_norm"))


def _steps(spark, d) -> DataFrame:
    from pyspark.sql.window import Window

    return _events(spark, d).withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)


@query(f"{_EV} SELECT event_id, round(0 + (t - min(t) OVER w)::double / nullif(max(t) OVER w - min(t) OVER w, 0) * 100, 6) x_scaled FROM e WINDOW w AS (PARTITION BY user_id)")
def rescale_axis(spark, d):
    return tracks.rescale_axis(_events(spark, d), "user_id", "t", 0, 100).select("event_id", F.round("x_scaled", 6).alias("x_scaled"))


@query(f"""{_EV}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) n FROM f), k AS (SELECT cast(range AS int) - 8 k, exp(-0.5 * power((cast(range AS int) - 8) / 2.0, 2)) w FROM range(17)), s AS (SELECT sum(w) sw FROM k),
 q AS (SELECT n.event_id, n.user_id, n.n, w / sw w, ((step + k) % (2 * n) + 2 * n) % (2 * n) j FROM n CROSS JOIN k CROSS JOIN s)
SELECT q.event_id, round(sum(q.w * m.value), 6) smooth FROM q JOIN n m ON m.user_id = q.user_id AND m.step = CASE WHEN j < q.n THEN j ELSE 2 * q.n - 1 - j END GROUP BY 1""")
def gaussian_smooth(spark, d):
    s = _steps(spark, d)
    return tracks.gaussian_smooth(s, "user_id", "step", ["value"], 2.0).join(s.select("user_id", "step", "event_id"), ["user_id", "step"]).select("event_id", F.round("value_smooth", 6).alias("smooth"))


@query(f"{_EV}, r AS (SELECT step, value y, row_number() OVER (PARTITION BY step ORDER BY value) - 1 r, count(*) OVER (PARTITION BY step) n FROM f) SELECT step, 'value' prop, {_STATS} FROM r GROUP BY step, n")
def progenitor_history(spark, d):
    return _round(tree.history(_steps(spark, d), "user_id", "step", ["value"]))


@query(f"""{_EV}, p AS (SELECT user_id, (row_number() OVER (ORDER BY value, user_id) - 1)::double / count(*) OVER () s FROM f WHERE step = 0), m AS (SELECT user_id, CASE WHEN s < 0.2 THEN 'low' WHEN s >= 0.4 AND s < 0.6 THEN 'middle' WHEN s >= 0.8 THEN 'high' END population FROM p),
 r AS (SELECT step, population, value, row_number() OVER (PARTITION BY step, population ORDER BY value) - 1 r, count(*) OVER (PARTITION BY step, population) n FROM f JOIN m USING (user_id) WHERE population IS NOT NULL)
SELECT step, population, n, {", ".join(f"max(CASE WHEN r = least(cast(floor(n * cast({p / 100} AS double)) AS bigint), n - 1) THEN value END) p{p}" for p in (20, 40, 60, 80))} FROM r GROUP BY 1, 2, 3""")
def mobility(spark, d):
    return tree.mobility(_steps(spark, d), "user_id", "step", "value")


_OCT = "SELECT user_id, step // 8 AS step, avg(value) AS value, 2 * max(value) AS doubled, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::double errors FROM f GROUP BY 1, 2"


def _octets(spark, d) -> DataFrame:
    """Tracks of users in steps of eight events."""
    s = F.floor(F.col("step") / 8).cast("int")
    return _steps(spark, d).groupBy("user_id", s.alias("step")).agg(F.avg("value").alias("value"), (2 * F.max("value")).alias("doubled"), F.count_if(F.col("event_type") == "error").cast("double").alias("errors"))


def _balance_sql(columns: list[str]) -> str:
    """prop, step, user_id of the rows that are left: step by step, a track that ends takes the one of opposite rank with it."""
    return f"""oc AS ({_OCT}), pv AS (SELECT user_id, step, unnest({columns}) prop, unnest([{", ".join(f"{c}::double" for c in columns)}]) v FROM oc), pd AS (SELECT *, lead(step) OVER (PARTITION BY prop, user_id ORDER BY step) IS NULL ends FROM pv),
 al AS (SELECT 0::bigint step, prop, user_id FROM pd WHERE step = 0 UNION ALL SELECT step + 1, prop, user_id FROM (SELECT step, prop, user_id, ends, n, k, list(ends) OVER (PARTITION BY prop ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) every
   FROM (SELECT al.step, al.prop, al.user_id, ends, row_number() OVER (PARTITION BY al.prop ORDER BY v, al.user_id) k, count(*) OVER (PARTITION BY al.prop) n FROM al JOIN pd ON pd.step = al.step AND pd.prop = al.prop AND pd.user_id = al.user_id)) WHERE NOT ends AND NOT every[n + 1 - k])"""


@query(f"{_EV.replace('WITH', 'WITH RECURSIVE', 1)}, {_balance_sql(['value', 'doubled'])} SELECT prop, cast(step AS int) step, count(*) n, cast(sum(user_id) AS bigint) ids FROM al GROUP BY 1, 2")
def balanced_tracks(spark, d):
    o = _octets(spark, d)
    long = o.select("user_id", "step", F.explode(F.array(*(F.struct(F.lit(c).alias("prop"), F.col(c).alias("v")) for c in ("value", "doubled")))).alias("s")).select("user_id", "step", "s.*")
    return tree.balance(long, "user_id", "step", "v", ["prop"]).groupBy("prop", "step").agg(F.count("*").alias("n"), F.sum("user_id").alias("ids"))


# ---- trees: orders -> customers -> nations -> regions as four levels ---------------------------------------------


def _nodes(spark, d) -> DataFrame:
    o = _t(spark, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("id"), (F.col("o_custkey") + 1_000_000).alias("desc_id"), F.lit(1.0).alias("epoch"), F.col("o_totalprice").alias("mass"))
    c = _t(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("desc_id"), F.lit(2.0).alias("epoch"), (F.col("c_acctbal") * 20).alias("mass"))
    n = _t(spark, d, "nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("desc_id"), F.lit(3.0).alias("epoch"), F.lit(100000.0).alias("mass"))
    r = _t(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(-1).cast("long").alias("desc_id"), F.lit(4.0).alias("epoch"), F.lit(1000.0).alias("mass"))
    return o.unionByName(c).unionByName(n).unionByName(r).withColumn("upid", F.col("desc_id"))


_TREE = """WITH RECURSIVE nodes AS (SELECT o_orderkey + 10000000 id, o_custkey + 1000000 desc_id, 1.0::double epoch, o_totalprice mass FROM orders UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, 2.0, c_acctbal * 20 FROM customer
 UNION ALL SELECT n_nationkey + 1000, n_regionkey + 1, 3.0, 100000.0 FROM nation UNION ALL SELECT r_regionkey + 1, -1, 4.0, 1000.0 FROM region),
 best AS (SELECT id, desc_id, row_number() OVER (PARTITION BY desc_id ORDER BY mass DESC, id) = 1 is_mmp FROM nodes)"""


@query(f"{_TREE}, w AS (SELECT id, id root_id, 0 AS level FROM nodes WHERE desc_id = -1 UNION ALL SELECT n.id, w.root_id, w.level + 1 FROM nodes n JOIN w ON n.desc_id = w.id) SELECT id, root_id, level FROM w")
def tree_walk(spark, d):
    n = _nodes(spark, d)
    return tree.tree_walk(n, n.where("desc_id = -1")).select("id", "root_id", "level")


@query(f"{_TREE}, w AS (SELECT id, id root_id, 0 AS level FROM nodes WHERE desc_id BETWEEN 1 AND 5 UNION ALL SELECT n.id, w.root_id, w.level + 1 FROM best n JOIN w ON n.desc_id = w.id WHERE n.is_mmp) SELECT id, root_id, level FROM w")
def tree_walk_mmp(spark, d):
    n = _nodes(spark, d)
    return tree.tree_walk(n, n.where("desc_id between 1 and 5"), mmp_only=True).select("id", "root_id", "level")


@query(f"{_TREE} SELECT id, is_mmp FROM best WHERE desc_id <> -1")
def mmp_select(spark, d):
    return tree.most_massive(_nodes(spark, d)).where("desc_id <> -1").select("id", "is_mmp")


@query(f"{_TREE}, w AS (SELECT id anc, id, mass FROM nodes UNION ALL SELECT w.anc, n.id, n.mass FROM nodes n JOIN w ON n.desc_id = w.id) SELECT anc id, round(max(mass), 6) peak FROM w GROUP BY 1")
def tree_peaks(spark, d):
    return tree.peaks(_nodes(spark, d)).select("id", F.round("peak", 6).alias("peak"))


@query(f"{_TREE}, p AS (SELECT n.desc_id id, sum(CASE WHEN is_mmp THEN 0 ELSE mass END) lumpy, sum(CASE WHEN is_mmp THEN 0 ELSE 1 END) k, max(CASE WHEN is_mmp THEN mass END) m FROM nodes n JOIN best b ON b.id = n.id GROUP BY 1) SELECT n.id, round(coalesce(lumpy, 0), 2) lumpy, round(greatest(mass - coalesce(m, mass) - coalesce(lumpy, 0), 0), 2) smooth, coalesce(k, 0) n_mergers FROM nodes n LEFT JOIN p ON p.id = n.id")
def tree_accretion(spark, d):
    return _round(tree.accretion(_nodes(spark, d)).select("id", "lumpy", "smooth", "n_mergers"), 2)


@query(f"{_TREE}, h AS (SELECT n.id, CASE WHEN b.is_mmp AND n.desc_id <> -1 THEN n.desc_id END up FROM nodes n JOIN best b ON b.id = n.id), w AS (SELECT id, id head FROM h WHERE up IS NULL UNION ALL SELECT h.id, w.head FROM h JOIN w ON h.up = w.id) SELECT id, head track_head FROM w")
def tree_tracks(spark, d):
    return tree.tracks(_nodes(spark, d)).select("id", "track_head")


@query(f"{_TREE} SELECT id, desc_id NOT IN (SELECT id FROM nodes) is_root, desc_id IN (SELECT id FROM nodes) has_host, desc_id <> -1 AND desc_id NOT IN (SELECT id FROM nodes) is_orphan FROM nodes")
def forest_links(spark, d):
    return tree.with_links(_nodes(spark, d)).select("id", "is_root", "has_host", "is_orphan")


@query(f"{_TREE}, s AS (SELECT desc_id id, count(*) n_subs, max(mass) largest, max(mass) / nullif(sum(mass) - max(mass), 0) ratio FROM nodes WHERE desc_id <> -1 GROUP BY 1 HAVING count(*) > 1) SELECT id, n_subs, largest, round(ratio, 6) ratio, ratio > 0.3 is_major, ratio > 0.2 AND ratio <= 0.3 is_minor FROM s")
def merger_ratio(spark, d):
    return tree.merger_ratio(_nodes(spark, d)).withColumn("ratio", F.round("ratio", 6))


# ---- grids and profiles ------------------------------------------------------------------------------------------

_CELL = "least(greatest(cast(floor({0} / (100.0 / 16)) AS int), 0), 15)"
_VOX = f"{_POS}, v AS (SELECT id, " + ", ".join(f"{_CELL.format(a)} i{a}" for a in "xyz") + " FROM p), cube AS (SELECT ix, iy, iz, cast(count(*) AS double) v FROM v GROUP BY 1, 2, 3)"


def _cube(spark, d) -> DataFrame:
    return grid.voxelise(_positions(spark, d), BOX, 16).groupBy("ix", "iy", "iz").agg(F.count("*").cast("double").alias("v"))


@query(f"WITH {_VOX} SELECT id, ix, iy, iz, v density FROM v JOIN cube USING (ix, iy, iz)")
def voxel_lookup(spark, d):
    return grid.lookup(_positions(spark, d), _cube(spark, d), BOX, 16).select("id", "ix", "iy", "iz", "density")


@query(f"WITH {_VOX}, k AS (SELECT v v0, count(*) count FROM cube GROUP BY 1) SELECT v0 value, count FROM k")
def voxel_hist(spark, d):
    return _cube(spark, d).groupBy(F.col("v").alias("value")).agg(F.count("*").alias("count"))


_TAPS = astro.gaussian_kernel(1.5)
_K = "k AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {w!r}::double)" for k, w in _TAPS) + ") t(d, w))"


@query(f"WITH {_VOX}, {_K}, a AS (SELECT (ix + d + 16) % 16 ix, iy, iz, sum(v * w) v FROM cube, k GROUP BY 1, 2, 3), b AS (SELECT ix, (iy + d + 16) % 16 iy, iz, sum(v * w) v FROM a, k GROUP BY 1, 2, 3), c AS (SELECT ix, iy, (iz + d + 16) % 16 iz, sum(v * w) v FROM b, k GROUP BY 1, 2, 3) SELECT ix, iy, iz, round(v / (sum(v) OVER () / 4096), 6) v FROM c")
def smooth_grid(spark, d):
    return _round(grid.smooth(_cube(spark, d), 16, 1.5))


_D = " + ".join(f"power(least(abs(a.{c} - b.{c}), 100 - abs(a.{c} - b.{c})), 2)" for c in "xyz")


@query(f"WITH {_POS}, j AS (SELECT a.id, {_D} d2 FROM p a JOIN p b ON b.structure < 5 WHERE a.structure >= 5) SELECT id, round(sqrt(min(d2)), 6) dist FROM j GROUP BY 1")
def nearest_structure(spark, d):
    p = _positions(spark, d)
    return grid.nearest_structure(p.where("structure >= 5").drop("structure"), p.where("structure < 5").drop("id"), BOX).select("id", F.round("dist", 6).alias("dist"))


@query(f"WITH {_POS}, v AS (SELECT structure, " + ", ".join(f"{_CELL.format(a)} i{a}" for a in "xyz") + " FROM p) SELECT structure, count(*) n, cast(floor(sum(ix) / count(*)) AS int) center_ix, min(iy) min_iy, max(iz) max_iz, round((max(ix) - min(ix)) * (max(iy) - min(iy)) * (max(iz) - min(iz)) * power(6.25, 3), 4) volume, round(6.25 * sqrt(count(*)) / pi(), 6) radius FROM v GROUP BY 1")
def structure_stats(spark, d):
    s = grid.structures(grid.voxelise(_positions(spark, d), BOX, 16), BOX / 16)
    return s.select("structure", "n", "center_ix", "min_iy", "max_iz", F.round("volume", 4).alias("volume"), F.round("radius", 6).alias("radius"))


def _profiles(spark, d) -> DataFrame:
    """An order's cumulative quantity, by line, as an enclosed mass."""
    rows = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.least(F.floor(F.col("l_extendedprice") / 8000) + 1, F.lit(12)).alias("k")).agg(F.sum("l_quantity").alias("q"))
    a = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "q"))).alias("s"), F.sum("q").alias("mass"))
    cum = F.transform("s", lambda x, i: F.aggregate(F.slice("s", 1, i + 1), F.lit(0.0), lambda t, y: t + y["q"]))
    return a.select("id", "mass", F.lit(12.0).alias("radius"), F.lit(1000).alias("np"), F.transform("s", lambda x: x["k"].cast("double")).alias("radii"), cum.alias("masses"))


@query()
def profile_fit(spark, d):
    return _round(profiles.fit_profiles(_profiles(spark, d), 0.1))


@query("""WITH q AS (SELECT l_suppkey id, least(cast(floor(l_extendedprice / 8000) AS bigint) + 1, 12) k, sum(l_quantity) q FROM lineitem GROUP BY 1, 2), c AS (SELECT id, k, sum(q) OVER (PARTITION BY id ORDER BY k) m FROM q)
SELECT id, round(sum(power(m - 1000 * power(3.0, 3) * (ln((3.0 + k) / 3.0) - k / (3.0 + k)), 2)), 2) chi2 FROM c GROUP BY 1""")
def profile_chi2(spark, d):
    p = _profiles(spark, d).withColumn("model", F.transform("radii", lambda r: astro.nfw_mass(r, F.lit(3.0), 1000.0))).withColumn("w", F.transform("radii", lambda r: F.lit(1.0)))
    return p.select("id", F.round(astro.chi2("masses", "model", "w"), 2).alias("chi2"))


# ---- whole forests -----------------------------------------------------------------------------------------------


@query(f"""{_EV}, n AS (SELECT *, 3600 * (1 + event_id % 24) s, lead(t) OVER w nt, lead(value) OVER w nv, first(t) OVER w ft, first(value) OVER w fv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
 q AS (SELECT *, t - s asked FROM n), j AS (SELECT a.event_id, a.user_id, a.t, a.value, a.s, a.ft, a.fv, b.t bt, b.value bv, b.nt, b.nv FROM q a ASOF LEFT JOIN n b ON a.user_id = b.user_id AND a.asked >= b.t),
 r AS (SELECT *, CASE WHEN bt IS NOT NULL THEN (value - (bv + (nv - bv) * (t - s - bt)::double / (nt - bt))) / s ELSE (value - fv) / nullif(t - ft, 0) END x FROM j)
SELECT event_id, round(coalesce(x, lead(x) OVER (PARTITION BY user_id ORDER BY t)), 9) value_dyn FROM r""")
def span_rates(spark, d):
    span = 3600 * (1 + F.col("event_id") % 24)
    return forest.span_rates(_events(spark, d), "user_id", "t", ["value"], span, ties=_TIES).select("event_id", _rounded("value_dyn", 9).alias("value_dyn"))


_HEADS = "h AS (SELECT n.id, CASE WHEN b.is_mmp AND n.desc_id <> -1 THEN n.desc_id END up FROM nodes n JOIN best b ON b.id = n.id), w AS (SELECT id, id head FROM h WHERE up IS NULL UNION ALL SELECT h.id, w.head FROM h JOIN w ON h.up = w.id)"


@query(f"""{_TREE}, {_HEADS}, p AS (SELECT n.desc_id id, sum(CASE WHEN is_mmp THEN 0 ELSE mass END) lumpy, sum(CASE WHEN is_mmp THEN 0 ELSE 1 END) k, max(CASE WHEN is_mmp THEN mass END) m FROM nodes n JOIN best b ON b.id = n.id GROUP BY 1),
 a AS (SELECT n.id, head, epoch, coalesce(lumpy, 0) l, coalesce(k, 0) k, CASE WHEN row_number() OVER (PARTITION BY head ORDER BY epoch) = 1 THEN mass ELSE greatest(mass - coalesce(m, mass) - coalesce(lumpy, 0), 0) END s FROM nodes n JOIN w ON w.id = n.id LEFT JOIN p ON p.id = n.id)
SELECT id, round(sum(l) OVER t, 2) lumpy, round(sum(s) OVER t, 2) smooth, cast(sum(k) OVER t AS bigint) n_mergers FROM a WINDOW t AS (PARTITION BY head ORDER BY epoch ROWS UNBOUNDED PRECEDING)""")
def accreted_mass(spark, d):
    return _round(forest.accreted(_nodes(spark, d)).select("id", "lumpy", "smooth", "n_mergers"), 2)


def _forest(spark, d) -> DataFrame:
    m = F.col("mass")
    return _nodes(spark, d).withColumns({"tf": F.pmod(F.col("id"), F.lit(7)) / 3.0, "spin": F.pmod(F.col("id"), F.lit(11)) / 10.0, "tu": F.pmod(F.col("id"), F.lit(13)) / 10.0, "almm": F.when(F.pmod(F.col("id"), F.lit(2)) == 0, F.col("epoch")).otherwise(0.5), "mass": m.cast("double")})


def _level_sql(e: int) -> str:
    """The nodes of one level with their histories, from those of the level before."""
    own = f"(SELECT *, id % 7 / 3.0::double tf, id % 11 / 10.0::double spin, id % 13 / 10.0::double tu, CASE WHEN id % 2 = 0 THEN epoch ELSE 0.5 END almm FROM nodes WHERE epoch = {e})"
    if e == 1:
        return f"l1 AS (SELECT id, desc_id, epoch, mass::double mass, mass::double mpeak, epoch a_mpeak, tf maxtf_peak, 1.0::double min_bsr_peak, 1.0::double min_bsr_lmm, spin spin_peak, 0.0::double mass_lost_peak, 0.0::double mass_lost_as_sub, epoch a_maxtf_peak, epoch a_min_bsr_peak, epoch a_min_bsr_lmm, tu tu_peak FROM {own})"
    new, merged = "(p IS NULL OR mass > p.mpeak)", "(p IS NULL OR epoch = almm)"
    peak = f"CASE WHEN {new} THEN mass::double ELSE p.mpeak END"
    lost = "greatest(m - mass, 0)"
    return f"""b{e} AS (SELECT desc_id up, arg_max(l, (l.mpeak, l.mass, -l.id)) p, max(l.mass) m FROM l{e - 1} l GROUP BY 1),
 l{e} AS (SELECT id, desc_id, epoch, mass::double mass, {peak} mpeak, CASE WHEN {new} THEN epoch ELSE p.a_mpeak END a_mpeak, CASE WHEN {new} THEN tf ELSE greatest(tf, p.maxtf_peak) END maxtf_peak,
  CASE WHEN {new} THEN 1.0 ELSE least(mass / ({peak}), p.min_bsr_peak) END min_bsr_peak, CASE WHEN {merged} THEN 1.0 ELSE least(mass / ({peak}), p.min_bsr_lmm) END min_bsr_lmm,
  CASE WHEN {merged} THEN spin ELSE greatest(spin, p.spin_peak) END spin_peak, CASE WHEN {new} THEN 0.0 ELSE p.mass_lost_peak + {lost} END mass_lost_peak,
  CASE WHEN {new} THEN 0.0 ELSE p.mass_lost_as_sub + CASE WHEN desc_id <> -1 THEN {lost} ELSE 0 END END mass_lost_as_sub,
  CASE WHEN {new} OR tf > p.maxtf_peak THEN epoch ELSE p.a_maxtf_peak END a_maxtf_peak, CASE WHEN {new} OR mass / ({peak}) < p.min_bsr_peak THEN epoch ELSE p.a_min_bsr_peak END a_min_bsr_peak,
  CASE WHEN {merged} OR mass / ({peak}) < p.min_bsr_lmm THEN epoch ELSE p.a_min_bsr_lmm END a_min_bsr_lmm, CASE WHEN {merged} THEN tu ELSE greatest(tu, p.tu_peak) END tu_peak FROM {own} LEFT JOIN b{e} ON up = id)"""


_KEPT = forest.HISTORY


@query(f"{_TREE}, {', '.join(_level_sql(e) for e in (1, 2, 3, 4))} SELECT id, {', '.join(f'round({c}, 6) {c}' for c in _KEPT)} FROM ({' UNION ALL '.join(f'SELECT * FROM l{e}' for e in (1, 2, 3, 4))})")
def tree_histories(spark, d):
    return _round(forest.histories(_forest(spark, d)).select("id", *_KEPT))


@query(f"""{_TREE}, {_HEADS}, r AS (SELECT id, id root FROM nodes WHERE desc_id = -1 UNION ALL SELECT n.id, r.root FROM nodes n JOIN r ON n.desc_id = r.id),
 o AS (SELECT id root, row_number() OVER (ORDER BY mass DESC, id) tree_count FROM nodes WHERE desc_id = -1),
 g AS (SELECT n.id, n.desc_id, row_number() OVER (PARTITION BY n.desc_id ORDER BY mass DESC, n.id) nth, is_mmp FROM nodes n JOIN best b ON b.id = n.id),
 bf AS (SELECT id, id root, 0 AS level, [0::bigint] path, false AS main FROM nodes WHERE desc_id = -1 UNION ALL SELECT g.id, bf.root, level + 1, list_append(path, nth), is_mmp FROM g JOIN bf ON g.desc_id = bf.id),
 k AS (SELECT id head, row_number() OVER (PARTITION BY root ORDER BY level, path) track FROM bf WHERE NOT main)
SELECT n.id, cast(epoch AS int) list_count, tree_count, track, round(coalesce(mass - lag(mass) OVER (PARTITION BY w.head ORDER BY epoch), 0), 2) mar, round(CASE WHEN degrees(acos(z / sqrt(1 + z * z))) > 90 THEN 90 - degrees(acos(z / sqrt(1 + z * z))) ELSE degrees(acos(z / sqrt(1 + z * z))) END, 2) xrot, 0.0::double zrot
FROM (SELECT *, mass / 1000.0 - 50 z FROM nodes) n JOIN w ON w.id = n.id JOIN k ON k.head = w.head JOIN r ON r.id = n.id JOIN o ON o.root = r.root""")
def viewer_export(spark, d):
    n = _nodes(spark, d).withColumns({"ax": F.lit(1.0), "ay": F.lit(0.0), "az": F.col("mass") / 1000.0 - 50})
    return _round(forest.exported(n, ["id"]), 2)
