"""Registered queries of the sources and sinks: each writes a driver table in a format and reads it back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.functions.shared import finite, shared_dir, written
from cosmolith.operators import binning, catalog, grid
from cosmolith.plans.catalogue import _TREE, _VOX, _bins_sql, _cube, _nodes, _round, _t, query
from cosmolith.sources import legacy
from cosmolith.sources.profile_binary import read_profile_binary, with_masses, write_profile_binary


def _path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, with the scheme of its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _lines(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("double").alias("id"), F.col("l_quantity").alias("mass"), F.col("l_extendedprice").alias("radius"), F.col("l_tax").alias("spin"))


_LINES = "SELECT l_orderkey::double id, l_quantity mass, l_extendedprice radius, l_tax spin FROM lineitem"


@query(_LINES)
def text_scan(spark, d):
    path, df = _path(spark, "catalogue"), _lines(spark, d)
    legacy.write_text(df, path, digits=17)
    return legacy.read_text(spark, path, df.columns)


@query("""WITH t AS (SELECT l_orderkey::double id, l_quantity q, l_extendedprice m FROM lineitem)
SELECT id, CASE WHEN q IN (1, 4) THEN 'nan' WHEN q = 2 THEN 'inf' WHEN q = 3 THEN '-inf' ELSE 'finite' END kind, CASE WHEN q > 4 THEN m ELSE 0 END mass FROM t""")
def text_odd_values(spark, d):
    """A text table with values that aren't numbers, infinite ones and nulls is read back whole; filters are an operator's choice."""
    q, m = F.col("l_quantity"), F.col("l_extendedprice")
    odd = F.when(q == 1, float("nan")).when(q == 2, float("inf")).when(q == 3, float("-inf")).when(q == 4, F.lit(None)).otherwise(m)
    path = _path(spark, "odd")
    legacy.write_text(_t(spark, d, "lineitem").select(F.col("l_orderkey").cast("double").alias("id"), odd.cast("double").alias("mass")), path, digits=17)
    got, m = legacy.read_text(spark, path, ["id", "mass"]), F.col("mass")
    kind = F.when(F.isnan(m), "nan").when(m == float("inf"), "inf").when(m == float("-inf"), "-inf").otherwise("finite")
    return got.select("id", kind.alias("kind"), F.when(finite("mass"), m).otherwise(0.0).alias("mass"))


@query(f"SELECT id, radius FROM ({_LINES})")
def bin_scan(spark, d):
    path, df = _path(spark, "catalogue.bin"), _lines(spark, d)
    legacy.write_bin(df, path)
    return legacy.read_catalogue(spark, path, df.columns, columns=["id", "radius"], rows_per_partition=10_000).drop("row_idx")


@query(f"SELECT spin, mass FROM ({_LINES})")
def bin2_scan(spark, d):
    path, df = _path(spark, "catalogue.bin2"), _lines(spark, d)
    legacy.write_bin(df, path, rows=True)
    return legacy.read_catalogue(spark, path, df.columns, columns=["spin", "mass"], rows_per_partition=10_000).drop("row_idx")


@query(_LINES)
def sniffed_scan(spark, d):
    path, df = _path(spark, "catalogue"), _lines(spark, d)
    legacy.write_bin(df, path)
    return legacy.read_catalogue(spark, path, df.columns).drop("row_idx")


@query("SELECT p_partkey::double id, p_retailprice price, p_size::double AS size FROM part")
def positional_concat(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    added = {}
    for c in p.columns:
        path = _path(spark, f"{c}.bin")
        legacy.write_bin(p.select(c), path)
        added[c] = legacy.read_catalogue(spark, path, [c])
    return catalog.zipped(added["id"], [added["price"], added["size"]]).drop("row_idx")


@query(f"WITH {_VOX} SELECT ix, iy, iz, v FROM cube")
def cube_scan(spark, d):
    path = _path(spark, "density.bin")
    legacy.write_cube(_cube(spark, d), path, 16)
    return legacy.read_cube(spark, path, 16).where("v > 0")


@query(f"WITH {_VOX} SELECT cast(a.range AS int) ix, cast(b.range AS int) iy, coalesce(v, 0) v FROM range(16) a CROSS JOIN range(16) b LEFT JOIN cube ON ix = a.range AND iy = b.range AND iz = 8")
def cube_slice(spark, d):
    path = _path(spark, "density.bin")
    legacy.write_cube(_cube(spark, d), path, 16)
    return grid.cut(legacy.read_cube(spark, path, 16), "iz", 8)


def _ragged(spark, d) -> DataFrame:
    """Profiles with one to five radii."""
    s, k = _t(spark, d, "supplier"), F.col("s_suppkey")
    n = (k % 5 + 1).cast("int")
    named = {"id": k, "parent_id": F.lit(-1), "mass": F.col("s_acctbal"), "radius": k / 4.0, "vmax": F.lit(2.5), "x": k * 1.0, "y": k * 2.0, "z": k * 3.0, "vx": F.lit(0.0), "vy": F.lit(0.5), "vz": F.lit(1.0), "np": k * 10, "n_rbins": n, "ppbin": F.lit(7)}
    return s.select(*(c.alias(name) for name, c in named.items()), F.transform(F.sequence(F.lit(1), n), lambda i: i * k / 8.0).alias("radii"))


_RAGGED = "SELECT s_suppkey id, s_acctbal mass, s_suppkey / 4.0::double radius, s_suppkey * 10 np, s_suppkey % 5 + 1 n_rbins, list_transform(range(1, s_suppkey % 5 + 2), lambda i: i * s_suppkey / 8.0::double) radii FROM supplier"


@query(f"SELECT id, mass, radius, np, n_rbins, unnest(radii) r FROM ({_RAGGED})")
def profile_text_scan(spark, d):
    path, df = _path(spark, "profiles"), _ragged(spark, d)
    flat = [c for c in df.columns if c != "radii"]
    lines = F.concat_ws(" ", *(F.col(c).cast("string") for c in flat), F.transform("radii", lambda r: r.cast("string")))
    df.select(lines.alias("value")).write.text(path)
    return legacy.read_profiles(spark, path).select("id", "mass", "radius", "np", "n_rbins", F.explode("radii").alias("r"))


@query(f"WITH p AS ({_RAGGED}) SELECT id, mass, cast(np AS int) np, unnest(radii) r, 7.0::double * unnest(range(1, n_rbins + 1)) enclosed FROM p")
def profile_bin_scan(spark, d):
    path = _path(spark, "profiles.bin")
    write_profile_binary(_ragged(spark, d), path)
    p = with_masses(read_profile_binary(spark, path, rows_per_partition=30))
    pair = F.explode(F.transform("radii", lambda r, i: F.struct(r.alias("r"), F.get("masses", i).alias("m"))))
    return p.withColumn("masses", F.transform("radii", lambda r, i: (i + 1).cast("double") * F.col("ppbin"))).select("id", "mass", "np", pair.alias("p")).select("id", "mass", "np", "p.r", F.col("p.m").alias("enclosed"))


@query("SELECT o_orderkey::double AS order, o_custkey tree_id, o_totalprice mass FROM orders WHERE o_custkey % 10 = 3")
def tree_file_scan(spark, d):
    """The lines of some trees out of forest files, by their location table."""
    o, folder = _t(spark, d, "orders"), os.path.dirname(_path(spark, "x"))
    where = legacy.write_trees(o, folder, "o_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"], 7)
    wanted = _t(spark, d, "orders").where("o_custkey % 10 = 3").select(F.col("o_custkey").alias("id"))
    return legacy.read_trees(spark, folder, where, wanted, ["order", "mass"])


@query("""SELECT l_orderkey::double halo_id, l_partkey::double gal_id, l_quantity mstar, l_extendedprice sfr_ave, o_totalprice m_vir, c_acctbal m_star
 FROM lineitem JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) = 1) ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_linenumber = 1""")
def galaxy_files(spark, d):
    """Three text files of a galaxy catalogue, read by their layouts and joined."""
    at = {
        "galprop": (_t(spark, d, "lineitem"), {"halo_id": "l_orderkey", "gal_id": "l_partkey", "mstar": "l_quantity", "sfr_ave": "l_extendedprice", "c1": "l_linenumber", "mbh": "l_linenumber"}),
        "halos": (_t(spark, d, "orders"), {"halo_id": "o_orderkey", "halo_id_nbody": "o_custkey", "m_vir": "o_totalprice", "sfr": "unix_timestamp(o_orderdate)"}),
        "mock": (_t(spark, d, "customer"), {"halo_id_nbody": "c_custkey", "m_star": "c_acctbal"}),
    }
    paths = {}
    for kind, (df, given) in at.items():
        paths[kind] = _path(spark, f"{kind}.dat")
        legacy.write_text(df.select(*(F.expr(given.get(c, "0")).cast("double").alias(c) for c in legacy.galaxy_names(kind))), paths[kind], digits=17, compression="gzip")
    t = legacy.read_galaxies(spark, **paths)
    galaxies = t["galprop"].select("halo_id", "gal_id", "mstar", "sfr_ave", "mbh")
    halos, mock = written(t["halos"].select("halo_id", "halo_id_nbody", "m_vir", "sfr")), t["mock"].select("halo_id_nbody", "m_star")
    joined = catalog.central_join(galaxies, halos, mock, "halo_id", "halo_id", "halo_id_nbody", "halo_id_nbody", F.col("mbh") == 1, "sfr")
    return joined.join(halos.select("halo_id", "m_vir"), "halo_id").select("halo_id", "gal_id", "mstar", "sfr_ave", "m_vir", "m_star")


@query("SELECT event_type AS value, event_type || '.dat' file_name, event_id::double AS id, value AS y FROM events")
def many_files(spark, d):
    """Text tables at the paths of a template, in one scan."""
    kinds, folder = ["click", "view", "error", "purchase", "signup"], os.path.dirname(_path(spark, "x"))
    for k in kinds:
        df = _t(spark, d, "events").where(F.col("event_type") == k).select(F.col("event_id").cast("double").alias("id"), F.col("value").alias("y"))
        legacy.write_text(df.coalesce(1), f"{folder}/{k}.dat", digits=17)
    return legacy.read_many(spark, f"{folder}/%s.dat", kinds, ["id", "y"]).withColumn("file_name", F.concat("value", F.lit(".dat")))


@query(f"SELECT concat_ws(' ', {', '.join(f'p_partkey * 100 + {i}' for i in catalog.HLIST)}) line FROM part")
def hlist_layout(spark, d):
    wide = _t(spark, d, "part").select(*((F.col("p_partkey") * 100 + i).alias(f"c{i}") for i in range(93)))
    return catalog.hlist_layout(wide).select(F.concat_ws(" ", *(F.col(c).cast("string") for c in catalog.hlist_layout(wide).columns)).alias("line"))


@query("SELECT concat_ws(' ', c_custkey, c_nationkey + 1, c_nationkey, c_custkey + 7, c_custkey * 2) line FROM customer")
def inserted_columns(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    out = catalog.insert_columns(c, {"last": F.col("c_custkey") * 2, "next": F.col("c_nationkey") + 1, "later": F.col("c_custkey") + 7}, {"next": 1, "later": 3})
    return out.select(F.concat_ws(" ", *(F.col(x).cast("string") for x in out.columns)).alias("line"))


@query(_bins_sql("customer", "c_acctbal", "SELECT 0 bin_id, (SELECT min(x) FROM v) lo, 0.0 hi UNION ALL SELECT 1, 0.0, 5000.0 UNION ALL SELECT 2, 5000.0, (SELECT max(x) FROM v)"))
def partitioned_write(spark, d):
    path, c = _path(spark, "bins"), _t(spark, d, "customer")
    legacy.write_by(binning.assign_bins(c, "c_acctbal", binning.bin_edges(c, "c_acctbal", "[0,5000]")), path, "bin_id")
    return _round(spark.read.parquet(path).groupBy("bin_id", "lo", "hi").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("x_min"), F.max("c_acctbal").alias("x_max")))


@query(f"{_TREE}, r AS (SELECT id, id root FROM nodes WHERE desc_id = -1 UNION ALL SELECT n.id, r.root FROM nodes n JOIN r ON n.desc_id = r.id) SELECT id, cast(root AS int) root_id FROM r WHERE root <= 2")
def tree_folders(spark, d):
    """One folder a tree, of the first two trees."""
    from cosmolith.operators import tree

    path, n = _path(spark, "trees"), _nodes(spark, d)
    legacy.write_by(tree.tree_walk(n, n.where("desc_id = -1")).select("id", "root_id"), path, "root_id", limit=2)
    return spark.read.parquet(path).select("id", "root_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / 8 AS l_extendedprice, l_quantity / 8 AS l_quantity FROM lineitem")
def scale_columns(spark, d):
    return catalog.scale_columns(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"], 8)




@query("SELECT DISTINCT event_type, 'tables/' || event_type || '.dat.out_3_7' AS plain, 'made/' || event_type || '.dat.hist' AS starred FROM events")
def output_names(spark, d):
    """What results are called, by default and by a pattern."""
    from cosmolith.cli import output_name

    kinds = [r[0] for r in _t(spark, d, "events").select("event_type").distinct().collect()]
    named = [(k, *(output_name({"file": f"tables/{k}.dat", "output": o, "x": 3, "y": 7}) for o in ("", "made/*.hist"))) for k in kinds]
    return spark.createDataFrame(named, "event_type string, plain string, starred string")


_TRACK = "_{0}.dat'' using 2:(log10($12)) with lines linewidth 1 linecolor rgb ''black'' notitle"


@query(f"""SELECT DISTINCT event_type, 'plot ''' || event_type || '.dat'' using 2:3:4 with boxes linewidth 1 notitle' AS histogram, 'plot ''' || event_type || '.dat'' using 3:4:5 with image linewidth 1 notitle' AS map,
 'plot ''' || event_type || '{_TRACK.format(0)}, ''' || event_type || '{_TRACK.format(1)}' AS tracks FROM events""")
def plot_commands(spark, d):
    from cosmolith.plans import plots

    kinds = [r[0] for r in _t(spark, d, "events").select("event_type").distinct().collect()]
    return spark.createDataFrame([(k, plots.histogram_plot(f"{k}.dat"), plots.map_plot(f"{k}.dat"), plots.track_plot(f"{k}_%d.dat", 2)) for k in kinds], "event_type string, histogram string, map string, tracks string")
