"""Scans along long tracks: cut into segments or blocks they give what one window by track gives, and no task gets a track whole."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.segments import bordered, segmented, under
from cosmolith.operators import forest, tracks


@pytest.fixture(scope="module")
def long_track(spark):
    """A track of a third of all rows, short ones, a track without a name; masses that repeat, zeros and nulls."""
    rng = random.Random(8)
    rows = [(7, t, float(rng.choice([0, 1, 1, 2, 3, 5, 8 + t // 40])) if rng.random() > 0.05 else None, rng.random() < 0.3) for t in rng.sample(range(3000), 300)]
    rows += [(rng.randint(100, 130), 10_000 + t, float(rng.randint(0, 9)), rng.random() < 0.5) for t in range(500)]
    rows += [(None, t, float(t % 13), t % 3 == 0) for t in range(60)]
    return spark.createDataFrame(rows, "track int, t long, m double, inside boolean").repartition(5)


def same(a, b):
    key = lambda rows: sorted(map(repr, rows))
    assert a.columns == b.columns
    assert key(a.collect()) == key(b.collect())


@pytest.mark.parametrize("longest", [1, 10, 45])
def test_scans_do_not_depend_on_the_cuts(long_track, longest):
    d = long_track
    flagged = d.withColumn("h", F.when(F.col("inside"), F.col("m")))
    for run in (
        lambda n: tracks.running_peak(d, "track", "t", "m", n), lambda n: tracks.flag_back(d, "track", "t", "m", 1.0, n), lambda n: tracks.carry_forward(flagged, "track", "t", "h", n),
        lambda n: tracks.high_tide_flag(d.withColumn("f", F.col("inside").cast("int") * 2), "track", "t", "f", "m", n), lambda n: tracks.pass_through(d, "track", "t", "inside", n),
        lambda n: tracks.moving_average(d, "track", "t", "m", 10, n).withColumn("smooth", F.round("smooth", 9)), lambda n: tracks.gaussian_smooth(d, "track", "t", ["m"], 2.0, n),
        lambda n: tracks.gaussian_smooth(d.where("track is not null"), "track", "t", ["m"], 30.0, n),
    ):
        same(run(longest), run(10**6))


def test_running_peak_by_hand(long_track):
    want = []
    by = {}
    for r in sorted(long_track.collect(), key=lambda r: r.t):
        by.setdefault(r.track, []).append(r)
    for rows in by.values():
        peak = at = low = None
        for r in rows:
            if r.m is not None and (peak is None or r.m >= peak):
                peak, at, low = r.m, r.t, None
            low = r.m if low is None else low if r.m is None else min(low, r.m)
            if peak is not None:
                want.append((r.track, r.t, peak, at, low / peak if peak else None))
    got = tracks.running_peak(long_track, "track", "t", "m", 20).where("peak is not null").select("track", "t", "peak", "peak_time", "since_peak_min").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_long_track_is_spread(long_track):
    cut = segmented(long_track, "track", "t", 30)
    sizes = {(r.track, r._seg): r["count"] for r in cut.rows.groupBy("track", "_seg").count().collect()}
    assert max(n for (k, _), n in sizes.items() if k == 7) <= 60 and sum(k == 7 for k, _ in sizes) >= 8
    rows, _ = bordered(long_track, "track", "t", 5, 4, 30)
    blocks = {(r.track, r._block): r["count"] for r in rows.groupBy("track", "_block").count().collect()}
    assert max(blocks.values()) <= 39 and rows.where("not _ghost").count() == long_track.count()


def test_gaussian_mirrors_ends(spark):
    """Against a series that is mirrored by hand, also where it is shorter than the reach."""
    import math

    for values, sigma in (([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0], 1.0), ([2.0, 7.0], 2.0), ([5.0], 1.0)):
        reach, n = int(4 * sigma + 0.5), len(values)
        kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
        at = lambda i: values[min(i % (2 * n), 2 * n - 1 - i % (2 * n))]  # noqa: E731, B023
        want = [sum(w * at(i + k - reach) for k, w in enumerate(kernel)) / sum(kernel) for i in range(n)]
        d = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, i int, v double")
        for longest in (1, 100):
            got = [r.v_smooth for r in tracks.gaussian_smooth(d, "s", "i", ["v"], sigma, longest).orderBy("i").collect()]
            assert got == pytest.approx(want)


def test_bisection(spark):
    d = spark.range(-2, 14).select(F.col("id").cast("double").alias("x"))
    for edges in ([], [3.0], [0.0, 1.0, 1.5, 4.0, 9.0, 11.0, 11.5]):
        arr = F.lit(edges).cast("array<double>") if edges else F.array().cast("array<double>")
        assert [r.n for r in d.select(under(arr, F.col("x"), len(edges)).alias("n"), "x").orderBy("x").collect()] == [sum(e < x for e in edges) for x in range(-2, 14)]


def test_ranges_that_overlap(spark):
    """Every row in every range that holds it: infinite, empty, repeated and crowded ranges, values at their ends."""
    from cosmolith.operators.binning import assign_bins

    rng, inf = random.Random(2), float("inf")
    for n in (0, 1, 40, 400):
        edges = [(rng.choice([-inf, rng.randint(0, 50), 20 + rng.randint(0, 40) / 1e6]), rng.choice([inf, rng.randint(0, 50), 20 + rng.randint(0, 40) / 1e6])) for _ in range(n)] + [(-1e300, 1e300)] * (n > 1)
        xs = [-inf, inf, float("nan"), None, -1e308, 1e308] + [float(x) for x in range(-1, 52)] + [20 + i / 2e6 for i in range(90)]
        d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
        got = sorted((r.i, r.bin_id, r.lo, r.hi) for r in assign_bins(d, "x", edges).collect())
        assert got == sorted((i, k, float(a), float(b)) for i, x in enumerate(xs) if x is not None for k, (a, b) in enumerate(edges) if a < x <= b)


def test_rows_alike_in_time_are_ordered_by_ties(spark):
    """Two rows at every time: whatever their order in the input, a track is read by time and number."""
    rng = random.Random(3)
    rows = [(k % 2, 10 * (k // 4), k, float(rng.randint(0, 9)), rng.random() < 0.5) for k in range(80)]
    plain = [(a, 1000 * t + k, k, m, i) for a, t, k, m, i in rows]
    names, ties, cut = "track int, t long, k long, m double, inside boolean", ["k"], {"longest": 20}
    rng.shuffle(rows)
    tied, apart = spark.createDataFrame(rows, names).repartition(3), spark.createDataFrame(plain, names)
    force = lambda d: d.withColumn("f", F.col("inside").cast("int") * 2)
    flagged = lambda d: d.withColumn("h", F.when(F.col("inside"), F.col("m")))
    for run in (
        lambda d, o: tracks.running_peak(d, "track", "t", "m", **o).drop("peak_time"), lambda d, o: tracks.flag_back(d, "track", "t", "m", 1.0, **o), lambda d, o: tracks.pass_through(d, "track", "t", "inside", **o),
        lambda d, o: tracks.carry_forward(flagged(d), "track", "t", "h", **o), lambda d, o: tracks.high_tide_flag(force(d), "track", "t", "f", "m", **o), lambda d, o: tracks.moving_average(d, "track", "t", "m", 3, **o).withColumn("smooth", F.round("smooth", 9)),
    ):
        same(run(tied, {**cut, "ties": ties}).drop("t"), run(apart, cut).drop("t"))
    at = {r["k"]: r for r in tracks.dynamical_rate(tied, "track", "t", "m", 10, ties).collect()}
    two = {r["k"]: r["d"] for r in tracks.lag2_derivative(tied, "track", "t", "m", ties).select("k", F.col("derivative").alias("d")).collect()}
    step = {r["k"]: r["rate"] for r in tracks.differences(tied, "track", "t", "m", ties).collect()}
    spans = {r["k"]: r["m_dyn"] for r in forest.span_rates(tied, "track", "t", ["m"], F.lit(10.0), ties=ties).collect()}
    m = {k: v for _, _, k, v, _ in rows}
    for k in range(4, 76):  # the row of a time that is later by k stands for its span back
        back = k - k % 4 - 4 + 2 + k % 2
        assert at[k]["dyn_rate"] == pytest.approx((m[k] - m[back]) / 10) and spans[k] == pytest.approx((m[k] - m[back]) / 10)
        assert two[k] == pytest.approx((m[k + 4] - m[k]) / 10) and (step[k] is None if k % 4 < 2 else step[k] == pytest.approx((m[k + 2] - m[k]) / 10))


def test_rows_are_counted_by_interval(spark, monkeypatch):
    """Counts of overlapping ranges against each row in each range, by lists and by the tree; a row goes into one sum only."""
    from cosmolith.operators import binning

    rng, inf = random.Random(4), float("inf")
    xs = [-inf, inf, float("nan"), None, *(float(rng.randint(-5, 60)) for _ in range(300)), *(20 + i / 2e6 for i in range(90))]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    even = [(10.0 * i, 10.0 * i + 5 + i * 7 % 40) for i in range(6)]
    crowded = [(rng.choice([-inf, rng.randint(0, 50), 20 + rng.randint(0, 40) / 1e6]), rng.choice([inf, rng.randint(0, 50), 20 + rng.randint(0, 40) / 1e6])) for _ in range(200)]
    for listed in (1 << 20, 0):
        monkeypatch.setattr(binning, "LISTED", listed)
        for edges in (even, crowded, [], [(3.0, 3.0)]):
            inside = {k: [x for x in xs if x is not None and a < x <= b] for k, (a, b) in enumerate(edges)}
            assert {r.bin_id: (r.n, r.x_min, r.x_max) for r in binning.bin_counts(d, "x", edges).collect()} == {k: (len(v), min(v), max(v)) for k, v in inside.items() if v}
            got = sorted((r.bin_id, r.x) for r in binning.assign_bins(d, "x", edges).collect())
            assert got == sorted((k, x) for k, v in inside.items() for x in v)
