"""Small hand-made frames: ties, empty bins, rows that aren't finite, tiny groups, periodic faces, formats."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cosmolith.functions import astro
from cosmolith.functions.shared import counted, ranked
from cosmolith.operators import aggregates as agg
from cosmolith.operators import binning, forest, grid, profiles, tracks, tree
from cosmolith.sources import legacy

NAN, INF = float("nan"), float("inf")


def test_ranked_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(g, (i * 7919) % 101, i) for i in range(300) for g in (i % 3,)], "g int, v int, i int")
    want = {}
    for g in range(3):
        for k, r in enumerate(sorted((r.v, r.i) for r in df.collect() if r.g == g)):
            want[r[1]] = k
    for n in (1, 7):
        got = {r.i: r["rank"] for r in ranked(df.repartition(n), ["v", "i"], by=["g"]).collect()}
        assert got == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_order_stats_of_tiny_groups(spark, n):
    v = [float(i * i) for i in range(n)]
    r = agg.order_stats(spark.createDataFrame([(0, x) for x in v] + [(0, NAN), (0, INF)], "g int, y double"), ["g"], "y").first()
    assert r.n == n and r.median == (v[(n - 1) // 2] + v[n // 2]) / 2
    assert r.d80 == v[min(math.ceil(n * 0.8), n - 1)] and v[0] <= r.ci_lo <= r.ci_hi <= v[-1]


def test_empty_bin_has_zero_mean(spark):
    got = [r.mean for r in agg.binned_avg(spark.createDataFrame([(0.0, 1.0), (10.0, 3.0), (NAN, 9.0)], "x double, y double"), "x", "y", 5).orderBy("bin_id").collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, 3.0]


def test_histogram_sums(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(200)] + [(NAN,), (None,)], "x double")
    rows = agg.hist1d(df, "x", 7, norm=True).orderBy("bin_id").collect()
    assert sum(r["count"] for r in rows) == 200 and abs(sum(r.pdf * r.width for r in rows) - 1) < 1e-12
    assert rows[-1].cdf == pytest.approx(200 / 202)
    merged = agg.hist1d_adaptive(df, "x", 20, 15).collect()
    assert sum(r["count"] for r in merged) == 200 and len(merged) < 20


def test_merge_small_keeps_all_rows():
    to = agg.merge_small([5, 1, 9, 0, 2, 30], 6)
    total = {}
    for i, t in enumerate(to):
        total[t] = total.get(t, 0) + [5, 1, 9, 0, 2, 30][i]
    assert sum(total.values()) == 47 and all(v >= 6 for v in total.values())
    assert agg.merge_small([3], 9) == [0]


def test_threshold_grammar():
    assert binning.parse_thresholds("4") == ("count", [4])
    assert binning.parse_thresholds("3Q") == ("quartiles", [])
    assert binning.parse_thresholds("%[10, 90]") == ("percent values", [10.0, 90.0])
    assert binning.parse_thresholds("r[:1,2:]") == ("ranges", [(-INF, 1.0), (2.0, INF)])
    with pytest.raises(ValueError):
        binning.parse_thresholds("q[1")


def test_overlapping_ranges_repeat_rows_and_minimum_is_left_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(6)], "x double")
    assert binning.assign_bins(df, "x", [(0.0, 3.0), (2.0, 5.0)]).count() == 6
    assert binning.assign_bins(df, "x", binning.bin_edges(df, "x", "2")).count() == 5


def test_periodic_nearest(spark):
    p = spark.createDataFrame([(1, 0.5, 50.0, 50.0), (2, 50.0, 50.0, 50.0)], "id long, x double, y double, z double")
    v = spark.createDataFrame([(7, 99.5, 50.0, 50.0), (8, 20.0, 50.0, 50.0), (8, 20.0, 51.0, 50.0)], "structure int, x double, y double, z double")
    got = {r.id: (r.structure, r.dist) for r in grid.nearest_structure(p, v, 100.0).collect()}
    assert got == {1: (7, 1.0), 2: (8, 30.0)}


def test_smoothing_keeps_the_mass_and_wraps(spark):
    cube = spark.createDataFrame([(0, 0, 0, 8.0)], "ix int, iy int, iz int, v double")
    out = grid.smooth(cube, 8, 2.0, over_mean=False)
    assert out.agg(F.sum("v")).first()[0] == pytest.approx(8.0)
    assert out.where("ix = 7 and iy = 0 and iz = 0").count() == 1


def test_local_density_leaves_the_own_voxel_out(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.5)], "id long, x double, y double, z double")
    cube = spark.createDataFrame([(0, 0, 0, 5.0)], "ix int, iy int, iz int, v double")
    assert grid.local_density(p, cube, 8.0, 8, 2, 2.0).first().local_density == 0.0


def test_small_tree(spark):
    n = spark.createDataFrame([(1, -1, 3.0, 5.0), (2, 1, 2.0, 4.0), (3, 1, 2.0, 3.0), (4, 2, 1.0, 9.0)], "id long, desc_id long, epoch double, mass double").withColumn("upid", F.lit(-1))
    assert {r.id: (r.peak, r.peak_epoch) for r in tree.peaks(n).collect()} == {1: (9.0, 1.0), 2: (9.0, 1.0), 3: (3.0, 2.0), 4: (9.0, 1.0)}
    assert {r.id: r.track_head for r in tree.tracks(n).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert [r.id for r in tree.tree_walk(n, n.where("id = 1"), mmp_only=True).orderBy("level").collect()] == [1, 2, 4]
    assert {r.id: (r.lumpy, r.smooth) for r in tree.accretion(n).collect()}[1] == (3.0, 0.0)
    got = tree.track_numbers(n.withColumn("tree_id", F.lit(1))).collect()
    assert {r.id: r.track for r in got} == {1: 1, 2: 1, 3: 2, 4: 1}


def test_breadth_first_numbers(spark):
    """Against the queue itself, on a tree where a deep, light branch comes before a later, heavy one, and on many trees."""
    import random

    rng, rows = random.Random(4), [(1, -1, 5.0, 1), (2, 1, 4.0, 1), (3, 1, 3.0, 1), (4, 3, 9.0, 1), (5, 3, 1.0, 1), (6, 2, 2.0, 1), (7, 2, 1.0, 1)]
    for t in range(2, 8):
        ids = [100 * t]
        rows.append((100 * t, -1, 1.0, t))
        for i in range(1, 60 if t == 2 else 12):
            rows.append((100 * t + i, rng.choice(ids), float(rng.randint(1, 4)), t))
            ids.append(100 * t + i)
    kids = {}
    for i, d, m, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        kids.setdefault(d, []).append(i)
    want = {}
    for root in kids[-1]:
        want[root], used, level = 1, 1, [root]
        while level:
            below = [(k, d, n) for d in level for n, k in enumerate(kids.get(d, []))]
            for k, d, n in below:
                used += n > 0
                want[k] = want[d] if n == 0 else used
            level = [k for k, _, _ in below]
    nodes = spark.createDataFrame(rows, "id long, desc_id long, mass double, tree_id int").withColumns({"epoch": F.lit(1.0), "upid": F.lit(-1)})
    got = {r.id: r.track for r in tree.track_numbers(nodes).collect()}
    assert got == want and [got[i] for i in range(1, 8)] == [1, 1, 2, 2, 4, 1, 3]


def test_balance_step_by_step(spark):
    """Against the loop over steps: the partner is the track of the opposite rank at the step where a track ends."""
    import random

    rng = random.Random(9)
    rows = [(prop, t, s, float(rng.randint(0, 6))) for prop in "ab" for t in range(21) for s in range(rng.choice([2, 3, 3, 5, 8]) + (t % 3))]
    want = set()
    for prop in "ab":
        at = {(t, s): v for p, t, s, v in rows if p == prop}
        alive, s = sorted(t for t, k in at if k == 0), 0
        while alive:
            order = sorted(alive, key=lambda t: (at[t, s], t))  # noqa: B023
            want |= {(prop, t, s) for t in order}
            dead = {i for i, t in enumerate(order) if (t, s + 1) not in at}
            alive = [t for i, t in enumerate(order) if i not in dead and len(order) - 1 - i not in dead]
            s += 1
    got = tree.balance(spark.createDataFrame(rows, "prop string, t int, s int, v double"), "t", "s", "v", ["prop"]).collect()
    assert {(r.prop, r.t, r.s) for r in got} == want and len(got) == len(want)
    mass = spark.createDataFrame([(1, 0, 2e10, 1.002), (1, 1, 1e11, 0.9), (1, 2, 9e9, 0.8), (1, 3, 5e10, 0.7), (2, 0, 1e10, 0.99), (3, 0, 3e10, 1.002), (3, 2, 3e10, 0.8), (4, 0, None, 1.002)], "t int, s int, m double, a double")
    assert sorted((r.t, r.s) for r in tree.living(mass, "t", "s", "m").collect()) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    assert sorted((r.t, r.s) for r in tree.living(mass, "t", "s", "m", epoch="a").collect()) == [(1, 0), (1, 1), (3, 0)]


def test_spline_hits_its_knots():
    x, y = np.array([0.0, 1, 3, 4]), np.array([1.0, 2, 0, 5])
    assert np.allclose(profiles.spline_at(x, y, x), y)


@pytest.mark.parametrize("optimiser", sorted(profiles.OPTIMISERS))
def test_fit_finds_the_scale_radius(optimiser):
    r = np.geomspace(0.5, 20, 40)
    fit = profiles.fit_profile(20, r, 3 * 4.0**3 * profiles.enclosed(r, 4.0), 0.01, optimiser)
    assert fit[0] == pytest.approx(4, rel=2e-2) and fit[3] == pytest.approx(4, rel=2e-2) and fit[4] == pytest.approx(3, rel=5e-2)
    assert fit[10] <= fit[5] + 1e-12  # a free slope fits no worse
    assert profiles.fit_profile(0.4, r, r, optimiser=optimiser) is None


@pytest.mark.parametrize("optimiser", sorted(profiles.OPTIMISERS))
def test_profiles_are_fitted_together_as_alone(optimiser):
    """300 profiles in turn took adadelta many minutes."""
    given = []
    for k in range(300):
        r, rs = np.geomspace(0.5, 20, 20 + k % 2), 2 + k % 7 / 2
        given.append((20.0, r, 3 * rs**3 * profiles.enclosed(r, rs)))
    fits = profiles.fit_many([*given, (0.4, r, r)], 0.01, optimiser)
    assert fits[-1] is None and [f[3] for f in fits[:-1]] == pytest.approx([2 + k % 7 / 2 for k in range(300)], rel=1e-2)
    assert [fits[k] for k in (0, 5)] == [profiles.fit_profile(*given[k], 0.01, optimiser) for k in (0, 5)]


def test_enclosed_is_the_integral_of_the_density():
    r = np.linspace(0, 3, 200_001)[1:]
    for outer in (0.5, 1.0, 1.5, 2.0, 3.0):
        grown = np.cumsum((r - r[0] / 2) * (1 + r - r[0] / 2) ** -outer) * r[0]
        assert profiles.enclosed(r, 1.0, outer)[-1] == pytest.approx(grown[-1], rel=1e-6)


def test_subhalo_track_counts_one_pass(spark):
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate([True, False, True, True, False])], "k int, t int, s boolean")
    assert [r.npt for r in tracks.pass_through(df, "k", "t", "s").orderBy("t").collect()] == [0, 1, 1, 1, 2]


def test_trim_zeros(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([0.0, 2.0, 0.0, 0.0])], "k int, t int, v double")
    assert tracks.trim_trailing_zeros(df, "k", "t", "v").count() == 2


def test_domain_functions(spark):
    r = spark.range(1).select(astro.cosmic_time(F.lit(1.0)), astro.dynamical_time(F.lit(1.0)), astro.safe_log10(F.lit(0.0)), astro.alignment(["id", "id"], ["id", "id"])).first()
    assert 13 < r[0] < 14.5 and 1 < r[1] < 4 and r[2] is None and r[3] is None
    assert sum(w for _, w in astro.gaussian_kernel(3.0)) == pytest.approx(1)


def test_text_scan(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# head\n1 2 3\nx y z\n4 5\n1e1 nan -inf\n")
    rows = legacy.read_text(spark, str(tmp_path / "t.txt"), ["a", "b", "c"])
    assert rows.count() == 2
    assert legacy.read_text(spark, str(tmp_path / "t.txt"), ["a", "b", "c"], mode="PERMISSIVE").where("_corrupt is not null").count() == 2
    with pytest.raises(Exception, match="malformed"):
        legacy.read_text(spark, str(tmp_path / "t.txt"), ["a", "b", "c"], mode="FAILFAST").collect()


def test_binary_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i * 0.5) for i in range(50)], "a double, b double").coalesce(1)
    for name, rows in (("x.bin", False), ("x.bin2", True)):
        at = str(tmp_path / name)
        legacy.write_bin(df, at, rows)
        assert legacy.header(at)[1:3] == (50, 2)
        back = legacy.read_catalogue(spark, at, ["a", "b"])
        assert sorted((r.a, r.b) for r in back.collect()) == [(float(i), i * 0.5) for i in range(50)]


def test_cube_and_profiles(spark, tmp_path):
    (tmp_path / "c").write_bytes(b"head" + np.arange(8, dtype="<f8").tobytes())
    got = {(r.ix, r.iy, r.iz): r.v for r in legacy.read_cube(spark, str(tmp_path / "c"), 2, 4).collect()}
    assert got[(1, 0, 1)] == 5.0
    (tmp_path / "p").write_text("#\n" + " ".join(map(str, [1, -1, 5, 2, 0, 0, 0, 0, 0, 0, 0, 200, 3, 10, 0.1, 0.2, 0.3])) + "\n")
    assert legacy.read_profiles(spark, str(tmp_path / "p")).first().radii == [0.1, 0.2, 0.3]
    assert struct.calcsize("<qq") == 16


def test_tree_numbers_by_root_rows(spark):
    rows = [(i, 1.0 if i in (0, 3, 7) else 0.5) for i in range(10)]
    got = [r.tree_id for r in legacy.number_trees(spark.createDataFrame(rows, "i long, a double").repartition(3), "i", "a", 1.0).orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_match_downsample_needs_every_cell(spark):
    df = spark.createDataFrame([(x, y, k) for k, (x, y) in enumerate([(0, 0)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 3)], "ix int, iy int, k int")
    assert {(r.ix, r.iy): r["count"] for r in agg.match_downsample(df, "ix", "iy", "k", 2).groupBy("ix", "iy").count().collect()} == {(0, 0): 2, (1, 0): 2}


def small_forest(spark):
    rows = [  # id, desc_id, upid, epoch, mass, tf, spin, tu, almm
        (1, -1, -1, 1.0, 8.0, 0.5, 0.2, 0.4, 0.5), (2, 1, 9, 0.75, 9.0, 2.0, 0.1, 0.5, 0.5), (3, 2, 9, 0.5, 10.0, 0.1, 0.3, 0.6, 0.5),
        (4, 2, -1, 0.5, 2.0, 0.1, 0.1, 0.1, 0.1), (5, 3, -1, 0.25, 4.0, 0.2, 0.1, 0.2, 0.1), (7, -1, -1, 1.0, 20.0, 0.0, 0.1, 0.1, 0.0),
    ]
    return spark.createDataFrame(rows, "id long, desc_id long, upid long, epoch double, mass double, tf double, spin double, tu double, almm double")


def test_histories_and_branch_fields(spark):
    n = small_forest(spark)
    h = {r.id: r for r in forest.histories(n).collect()}
    assert (h[1].mpeak, h[1].a_mpeak, h[1].maxtf_peak, h[1].a_maxtf_peak) == (10.0, 0.5, 2.0, 0.75)
    assert (h[1].min_bsr_peak, h[1].a_min_bsr_peak, h[2].min_bsr_lmm) == (0.8, 1.0, 0.9)
    assert (h[1].mass_lost_peak, h[1].mass_lost_as_sub, h[1].spin_peak, h[1].tu_peak) == (2.0, 1.0, 0.3, 0.6)
    b = {r.id: r for r in forest.branch_fields(n).collect()}
    assert sorted(b) == [1, 2, 3, 5, 7] and forest.branch_fields(n).columns == n.columns + forest.APPENDED
    assert (b[1].npt, b[1].high_tf, b[3].high_tf, b[1].mass_lost_mpeak) == (1.0, 1.0, 0.0, 0.5)
    assert b[1].spin_peak == pytest.approx(0.2 / 0.3) and b[5].mdot_dyn == b[3].mdot_dyn and b[7].mdot_dyn is None
    run = {r.id: r for r in forest.full_run(n.where("id in (1, 7)").select("id", F.col("mass").alias("m0")), n, 1.0).collect()}
    assert run[1].mpeak == 10.0 and run[7].npt == 0.0 and run[1].m0 == 8.0


def test_accreted_mass_is_summed_along_tracks(spark):
    a = {r.id: r for r in forest.accreted(small_forest(spark)).collect()}
    assert (a[5].smooth, a[3].smooth, a[2].lumpy, a[2].n_mergers, a[1].lumpy, a[1].merger_mean) == (4.0, 10.0, 2.0, 1, 2.0, 2.0)
    assert a[1].lumpy_share + a[1].smooth_share == pytest.approx(1)


def test_span_rates_interpolate_and_take_the_first_row(spark):
    df = spark.createDataFrame([(1, t, float(t * t)) for t in (0, 2, 4, 8)], "k int, t int, m double")
    got = {r.t: r.m_dyn for r in forest.span_rates(df, "k", "t", ["m"], F.lit(3.0)).collect()}
    want = {0: 2.0, 2: 2.0, 4: (16 - 2) / 3, 8: (64 - 28) / 3}
    assert {t: pytest.approx(v) for t, v in want.items()} == got


def test_exported_counts_epochs_trees_and_tracks(spark):
    n = small_forest(spark).withColumns({"ax": F.lit(0.0), "ay": F.lit(0.0), "az": F.lit(-1.0)})
    e = {r.id: r for r in forest.exported(n, ["id", "mass"]).collect()}
    assert len(e) == 6 and (e[1].list_count, e[1].tree_count, e[7].tree_count) == (4, 2, 1)
    assert (e[1].track, e[4].track, e[1].mar, e[5].mar, e[1].xrot, e[1].zrot) == (1, 2, -1.0, 0.0, -90.0, 0.0)


def test_history_table_has_all_columns(spark):
    t = forest.Table()
    rows = spark.range(40).selectExpr("id % 10 AS track", "cast(id div 10 AS int) AS step", "id")
    rows = rows.where("track <> 3 or step < 2").withColumns({c: (F.col("id") * 7 % 11).cast("double") for c in {*t.ordered, *t.means, t.merger}})
    rows = rows.withColumns({"z": F.col("step") * 0.5, t.flag: F.when(F.col("track") < 4, 1).otherwise(0)})
    out = forest.history_table(rows, "track", "step", "z").drop("step")
    assert len(out.columns) == 153
    got = out.orderBy("z").collect()
    assert [r.z for r in got] == [0.0, 0.5, 1.0, 1.5] and [r.high_kept for r in got] == [1.0, 1.0, 0.75, 0.75]
    flat = [(r.track, r.mvir) for r in rows.where("step = 2").collect()]
    order = sorted(rows.where("step = 0").select("mvir", "track").collect())
    gone = {3, order[9 - [r.track for r in order].index(3)].track}
    assert got[2].mvir_median == np.median([m for k, m in flat if k not in gone])
    assert got[0].merger_count_d80 - got[0].merger_count_median == pytest.approx(np.std([r.mvir for r in rows.where("step = 0").collect()]))


def test_counts_of_values_give_every_rank(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 9, 400), strict=True)] + [(5, 1.0)]
    got = counted(spark.createDataFrame(rows, "g int, v double").repartition(7), "v", ["g"]).collect()
    for g in {r[0] for r in rows}:
        flat = [r.v for r in sorted((x for x in got if x.g == g), key=lambda r: r.before) for _ in range(r.n)]
        assert flat == sorted(v for k, v in rows if k == g) and {x.total for x in got if x.g == g} == {len(flat)}


def test_rows_alike_get_ranks_of_their_own(spark):
    df = spark.createDataFrame([(0.0, i) for i in range(300)], "v double, i int")
    assert sorted(r["rank"] for r in ranked(df, ["v"]).collect()) == list(range(300))


def test_bootstrap_interval_is_the_limit_of_resampling(spark):
    v = np.sort(np.random.default_rng(2).normal(size=101))
    r = agg.bootstrap_median(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()
    drawn = np.sort(np.random.default_rng(3).choice(v, (20_000, 101)), axis=1)[:, 50]
    near = lambda x: np.searchsorted(v, x)
    assert abs(near(np.quantile(drawn, 0.025, method="higher")) - near(r.ci_lo)) <= 1 and abs(near(np.quantile(drawn, 0.975, method="higher")) - near(r.ci_hi)) <= 1
    assert agg.beta_share(2, 3, 0.4) == pytest.approx(0.5248)
    assert agg.bootstrap_median(spark.createDataFrame([], "v double"), "v").first().ci_lo is None


def test_percentages_of_statistics(spark):
    df = spark.createDataFrame([(float(i), float(i // 2)) for i in range(10)], "x double, y double")
    stats = spark.createDataFrame([(0, 1.5, 0.0, 4.0, 2.0, 9.0, 0.3)], "bin_id int, median double, d20 double, d80 double, ci_lo double, ci_hi double, mad double")
    r = agg.placed(stats, df, "y").first()
    assert (r.median, r.d20, r.d80, r.ci_lo, r.ci_hi, r.mad) == (35.0, 0.0, 100.0, 40.0, 100.0, 0.3)


def test_walks_of_nested_roots_and_cycles(spark):
    n = spark.createDataFrame([(1, -1), (2, 1), (3, 2), (4, 3), (5, 2)], "id long, desc_id long").withColumn("mass", F.col("id").cast("double"))
    got = {(r.id, r.root_id, r.level) for r in tree.tree_walk(n, n.where("id in (1, 2, 3)")).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (5, 1, 2), (2, 2, 0), (3, 2, 1), (4, 2, 2), (5, 2, 1), (3, 3, 0), (4, 3, 1)}
    assert tree.tree_walk(n, n.where("id > 9")).count() == 0
    with pytest.raises(RuntimeError, match="cycle"):
        tree.ends(spark.createDataFrame([(1, 2), (2, 1)], "id long, to long"))


def test_nearest_of_many_voxels_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.uniform(0, 10, (300, 3)) % 10, rng.normal(3, 0.2, (400, 3)) % 10])
    p = rng.uniform(0, 10, (60, 3))
    d = np.abs(p[:, None] - v[None])
    want = np.sqrt((np.minimum(d, 10 - d) ** 2).sum(axis=2)).min(axis=1)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
    voxels = spark.createDataFrame([(i % 7, *map(float, x)) for i, x in enumerate(v)], "structure int, x double, y double, z double")
    got = {r.id: r.dist for r in grid.nearest_structure(points, voxels, 10.0).collect()}
    assert np.allclose([got[i] for i in range(60)], want)


def test_cubes_are_written_with_empty_planes(spark, tmp_path):
    cube = spark.createDataFrame([(1, 2, 0, 5.0), (3, 3, 3, 7.0), (1, 0, 1, 2.0)], "ix int, iy int, iz int, v double").repartition(3)
    legacy.write_cube(cube, str(tmp_path / "c"), 4)
    want = np.zeros((4, 4, 4))
    want[1, 2, 0], want[3, 3, 3], want[1, 0, 1] = 5, 7, 2
    assert np.array_equal(np.fromfile(tmp_path / "c").reshape(4, 4, 4), want)


def test_merger_epochs_are_inherited(spark):
    n = spark.createDataFrame([(1, -1, -1, 1.0, 9.0, 13.0), (2, 1, -1, 0.8, 8.0, 13.0), (3, 2, -1, 0.6, 7.0, 12.9), (4, 2, 2, 0.6, 3.0, 12.8)], "id long, desc_id long, upid long, epoch double, mass double, mpeak double")
    t = tree.tracks(n).withColumn("root_id", F.lit(1).cast("long"))
    assert {r.id: r.almms for r in tree.stellar_merger(t).collect()} == {1: 0.8, 2: 0.8, 3: -1.0, 4: -1.0}
    assert {r.id: r.almms for r in tree.stellar_merger(t, 3.0, pairwise=True).collect()} == {1: 0.8, 2: 0.8, 3: 0.6, 4: 0.6}
    assert {r.id: (r.almm2, r.alminm) for r in tree.subhalo_mergers(t).collect()} == {1: (0.8, 0.8), 2: (0.8, 0.8), 3: (0.6, 0.6), 4: (0.6, 0.6)}


def test_normal_variates(spark):
    """Moments and tails of a standard normal; the same under any partitioning; keys, nulls and seeds tell draws apart."""
    d = spark.range(20_000).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 7))
    draw = lambda rows, seed=1: {r.id: r.z for r in rows.select("id", astro.normal("id", "k", seed=seed).alias("z")).collect()}
    one = draw(d)
    z = np.array(list(one.values()))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z**3).mean()) < 0.08 and abs((z**4).mean() - 3) < 0.25
    assert abs((np.abs(z) < 1.96).mean() - 0.95) < 0.006 and len(set(one.values())) == len(one)
    assert draw(d.repartition(7, "k")) == one and draw(d, 2)[5] != one[5]
    moved = d.select(astro.normal("id", "k", seed=1, mean=3.0, deviation=2.0).alias("z"), "id").where("id = 9").first()
    assert moved.z == pytest.approx(3 + 2 * one[9])


def test_history_table_query_keeps_every_step(spark, sf_dir):
    """A row for each step of the users' events that has five users, not for each eight steps."""
    from cosmolith.plans.catalogue import _steps
    from cosmolith.plans.registered import QUERIES

    steps = {r[0] for r in _steps(spark, sf_dir).groupBy("step").count().where("count >= 5").collect()}
    assert {r["step"] for r in QUERIES["history_table"](spark, sf_dir).select("step").collect()} == steps


def test_galaxy_text_files_are_packed(spark, tmp_path):
    """A packed text table is read back whole and takes a small part of the plain one's bytes."""
    import os

    from cosmolith.sources import legacy

    df = spark.range(5000).select(F.col("id").cast("double").alias("id"), *(F.lit(0.0).alias(f"c{i}") for i in range(38)))
    size = lambda d: sum(os.path.getsize(f"{d}/{f}") for f in os.listdir(d))
    for name, codec in (("plain", None), ("packed", "gzip")):
        legacy.write_text(df, f"{tmp_path}/{name}", digits=17, compression=codec)
    assert size(f"{tmp_path}/packed") * 5 < size(f"{tmp_path}/plain")
    back = legacy.read_text(spark, f"{tmp_path}/packed", df.columns)
    assert back.count() == 5000 and back.agg(F.sum("id"), F.sum("c37")).first() == (5000 * 4999 / 2, 0.0)


def test_galaxy_text_is_read_by_line(spark, tmp_path):
    """Only the fields that are asked are made numbers, once, and doubles are written as short as they are read again. What is a line of
    numbers is told by a pattern of the line or, if that doesn't match, by field: both tell the same."""
    from cosmolith.sources import legacy

    fields = ["1", "-1.5", "+2.", ".5", "1e5", "1.5E-7", "1e999", "nan", "NaN", "+NaN", "inf", "-Infinity", "\x011", "1d", "0x1p3", "1_0", "", ".", "e5", "1e", "--1", "x", "1,5"]
    lines = [f"{a} {b}" for a in fields for b in ("7", "inf", "y")] + ["1  2", "1\t2", "\t1 2", "1 2 3", "1", " 1 2 "]
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    by_line, by_field = (legacy.read_text(spark, str(tmp_path / "t.txt"), ["a", "b"], delimiter=d, mode="PERMISSIVE") for d in (r"\s+", r"[\s]+"))
    read = sorted(map(str, by_line.collect()))
    assert read == sorted(map(str, by_field.collect())) and sum("_corrupt=None" in r for r in read) == 29
    kept = legacy.read_text(spark, str(tmp_path / "t.txt"), ["a", "b"])
    assert sorted(map(str, kept.collect())) == sorted(r.replace(", _corrupt=None", "") for r in read if "_corrupt=None" in r)

    names = legacy.galaxy_names("galprop")
    xs = [0.0, 0.1, 1 / 3, 1e22, 5e-324, 123456789.125]
    legacy.write_text(spark.createDataFrame([(x,) * len(names) for x in xs], ", ".join(f"`{c}` double" for c in names)), f"{tmp_path}/g", digits=17)
    assert "0.1 0.1" in "".join(r.value for r in spark.read.text(f"{tmp_path}/g").collect())
    few = legacy.read_galaxies(spark, galprop=f"{tmp_path}/g")["galprop"].select("halo_id", "gal_id", "mstar")
    assert sorted(few.collect()) == sorted((x,) * 3 for x in xs)
    made = few._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
    assert made.count("as double") == 3 and "transform" not in made and "split" not in made


def test_nodes_without_a_pointer_are_spread(spark):
    """Most nodes are no main progenitor; a join by their null pointers had sent them all to one task."""
    rows = [(i, 10_000 + i % 100, float(i)) for i in range(500)] + [(10_000 + i, -1, 1.0) for i in range(100)]
    nodes = spark.createDataFrame(rows, "id long, desc_id long, mass double")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = tree._pointers(nodes, True, "mass").select("id", "to", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert {r.id: r.to for r in found if r.to is not None} == {400 + i: 10_000 + i for i in range(100)} and len(found) == 600
    none = [r.p for r in found if r.to is None]
    assert max(none.count(p) for p in set(none)) < 400


def test_forest_files_by_their_location_table(spark, tmp_path, monkeypatch):
    """One tree of many lines and trees of one: a location is the place of a tree's first line, and a
    task reads a few trees that lie one after another, so that many tasks read one file."""
    rows = [(7, i, 1.5 * i) for i in range(50_000)] + [(100 + i, i, float(i)) for i in range(300)]
    nodes = spark.createDataFrame(rows, "tree long, i long, v double")
    where = legacy.write_trees(nodes, str(tmp_path), "tree", "i", ["i", "v"], 3)
    for r in where.collect():
        data = open(legacy.tree_file(str(tmp_path), r.file_no), "rb").read()
        assert data[: r.byte_offset].endswith(b"#tree %d\n" % r.id) and not data[r.byte_offset :].startswith(b"#")
    wanted = spark.createDataFrame([(7,)] + [(100 + i,) for i in range(0, 300, 3)] + [(999,)], "id long")
    got = legacy.read_trees(spark, str(tmp_path), where, wanted, ["i", "v"]).collect()
    assert sorted((r.tree_id, r.i, r.v) for r in got) == [(t, float(i), v) for t, i, v in rows if t == 7 or (t - 100) % 3 == 0]
    monkeypatch.setattr(legacy, "TREES_A_TASK", 10)
    tasks = legacy.read_trees(spark, str(tmp_path), where, wanted, ["i", "v"]).select("tree_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.p for r in tasks}) > 5 and len({r.tree_id for r in tasks}) == len(tasks) == 101


def test_large_trees_are_dealt_by_rows(spark, monkeypatch):
    """Above FEW rows a task of the trees' joins has a fixed share of the nodes, however many they are and whatever descendant
    they have in common; walks, tracks and mergers are those of a table left to Spark's own exchanges."""
    from cosmolith.functions import shared

    rows = [(100 + i, 10 + i % 3, 1.0, float(i * 7919 % 1009)) for i in range(2000)] + [(9000 + i, 100 + i, 0.0, float(i)) for i in range(200)] + [(10 + i, 1, 2.0, 900.0 + i) for i in range(3)] + [(1, -1, 3.0, 1000.0)]
    nodes = spark.createDataFrame([(*r, r[1]) for r in rows], "id long, desc_id long, epoch double, mass double, upid long")

    def run():
        walked = tree.tree_walk(tree.tracks(nodes), nodes.where("id = 1")).withColumn("mpeak", F.lit(10.0) + F.col("id") % 31 / 10)
        outs = [walked, tree.most_massive(nodes), tree.subhalo_mergers(walked), tree.stellar_merger(walked), tree.stellar_merger(walked, 3.0, True), tree.accretion(nodes)]
        return [sorted(tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in d.collect()) for d in outs]

    want = run()
    for name, value in (("FEW", 0), ("ROWS_A_TASK", 50), ("HEAVY", 20)):
        monkeypatch.setattr(shared, name, value)
    assert run() == want and len(want[0]) == len(rows)
    shares = tree.tracks(nodes).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in shares) < 200  # else all rows are in a task or two
    left = nodes.select("id", F.col("desc_id").alias("end")).where("end between 10 and 12")
    found = shared.looked_up(shared.written(left), nodes.select(F.col("id").alias("end"), "mass"), "end", len(rows)).select("mass", F.spark_partition_id().alias("p")).collect()
    assert len(found) == 2000 and {r.mass for r in found} == {900.0, 901.0, 902.0}
