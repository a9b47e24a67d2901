import numpy as np
import pytest
from pyspark.sql import functions as F

from cosmolith import cli
from cosmolith.plans import plots
from cosmolith.sources import legacy
from cosmolith.sources.profile_binary import read_profile_binary, write_profile_binary


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    path = tmp_path_factory.mktemp("cli") / "t.dat"
    rng = np.random.default_rng(3)
    rows = np.column_stack([np.arange(1, 201), rng.uniform(1, 9, 200), rng.normal(size=200)])
    path.write_text("# id x y\n" + "\n".join(" ".join(repr(float(v)) for v in r) for r in rows) + "\n")
    return str(path), rows


def run(spark, path, *flags):
    return cli.result(spark, cli.parse([f"-file={path}", *flags]))


def test_flags():
    o = cli.parse(["-file=a", "-type=hist1D", "-x=3", "-logx", "-smoothing_length=2.5", "-nbins=%[10,90]"])
    assert (o["x"], o["logx"], o["slen"], o["nbins"], o["y"]) == (3, True, 2.5, "%[10,90]", 1)
    for bad in (["file=a"], ["-what=1"], ["-x"], ["-nbins=[1"]):
        with pytest.raises(ValueError):
            cli.parse(bad)


def test_types(spark, table):
    path, rows = table
    h = run(spark, path, "-type=hist1D", "-x=1", "-nbinsx=8").collect()
    assert sum(r["count"] for r in h) == 200
    assert [r["count"] for r in sorted(h, key=lambda r: r.bin_id)] == np.histogram(rows[:, 1], 8)[0].tolist()
    assert run(spark, path, "-type=hist2D", "-x=1", "-y=2", "-nbinsx=4", "-nbinsy=3", "-rank").agg(F.sum("z")).first()[0] == 200
    assert run(spark, path, "-type=avg", "-x=1", "-y=2", "-nbinsx=5").count() == 5
    assert run(spark, path, "-type=median", "-x=1", "-y=2", "-nbinsx=4", "-use_percentiles_x", "-autobin=false").agg(F.sum("n")).first()[0] == 200
    assert run(spark, path, "-type=binnedHist1D", "-x=2", "-binx=1", "-nbins=[3,6]", "-nbinsx=4").select("file_bin").distinct().count() == 3
    assert run(spark, path, "-type=bin", "-binx=1", "-nbins=3Q").count() == 199
    assert [r.bin_id for r in run(spark, path, "-type=hist1D", "-x=1", "-nbinsx=8", "-logz").collect()] == list(range(8))
    placed = run(spark, path, "-type=median", "-x=1", "-y=2", "-nbinsx=4", "-autobin=false", "-use_percentiles_y").collect()
    assert all(0 <= r.d20 <= r.median <= r.d80 <= 100 for r in placed) and sum(r.n for r in placed) == 200
    assert run(spark, path, "-type=binnedMedian", "-x=1", "-y=2", "-binx=1", "-nbins=[3,6]", "-nbinsx=4", "-autobin=false").select("file_bin").distinct().count() == 3
    assert run(spark, path, "-type=binnedHist2D", "-x=1", "-y=2", "-binx=1", "-nbins=[3,6]", "-nbinsx=4").count() == 48
    stats = run(spark, path, "-type=other", "-otherparam=genPlotStats", "-x=1", "-y=2").first()
    assert stats.c1_median == np.median(rows[:, 1]) and stats.c2_median == np.median(rows[:, 2])
    d = np.argsort(np.argsort(rows[:, 1])) - np.argsort(np.argsort(rows[:, 2]))
    assert run(spark, path, "-type=other", "-otherparam=rankCorrelation", "-x=1", "-y=2").first().rho == pytest.approx(1 - 6 * (d**2).sum() / (200 * (200**2 - 1)))
    with pytest.raises(ValueError):
        run(spark, path, "-type=what")


def test_formats_round_trip(spark, table, tmp_path):
    path, rows = table
    at = cli.main([f"-file={path}", "-type=toBin", f"-output={tmp_path}/*.bin"], spark)
    assert at.endswith("t.dat.bin")
    back = cli.main([f"-file={at}", "-type=toAscii", f"-output={tmp_path}/text"], spark)
    got = legacy.read_text(spark, back, ["a", "b", "c"]).orderBy("a").collect()
    assert np.allclose(np.array([tuple(r) for r in got]), rows, rtol=1e-9)
    with pytest.raises(FileExistsError):
        cli.main([f"-file={at}", "-type=toAscii", f"-output={tmp_path}/text"], spark)


def tree_file(path):
    """Two trees of three epochs in the positions of a tree table."""
    lines = []
    for t in (1, 2):
        for k, a in enumerate((1.00231, 0.8, 0.6)):
            row = [0.0] * 57
            for n, v in {"epoch": a, "id": 10 * t + k, "desc_id": 10 * t + k - 1 if k else -1, "upid": -1, "mass": 10.0 * t - k, "x": 5.0 * t, "spin": 0.1, "tu": 0.2, "rvir": 2.0, "rs": 1.0, "az": 1.0}.items():
                row[cli.TREE[n]] = v
            lines.append(" ".join(map(repr, row)))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_tree_commands(spark, tmp_path):
    path = tree_file(tmp_path / "trees.dat")
    assert run(spark, path, "-type=other", "-otherparam=doTreeAnalysis").count() == 6
    assert run(spark, path, "-type=other", "-otherparam=doSelectZ", "-x=0").count() == 2
    assert run(spark, path, "-type=treeWalk", f"-mergeTo={path}", "-mmp").where("level = 0").count() == 6
    full = run(spark, path, "-type=other", "-otherparam=doFullTreeAnalysis", f"-mergeTo={path}").where("mpeak is not null").collect()
    assert sorted(r.id for r in full) == [10, 20]
    assert run(spark, path, "-type=other", "-otherparam=doConvertMergerTracks").select("track").distinct().count() == 1
    assert run(spark, path, "-type=other", "-otherparam=doConvertToVizFormat").count() == 6
    out = cli.main([f"-file={path}", "-type=other", "-otherparam=doIndvHaloTracks", f"-output={tmp_path}/split"], spark)
    assert sorted(r["count"] for r in spark.read.parquet(out).groupBy("tree_id").count().collect()) == [3, 3]


def test_history_command(spark, tmp_path):
    path = tree_file(tmp_path / "trees.dat")
    o = cli.parse([f"-file={path}", "-type=other", "-otherparam=doProgenitorHistory"])
    columns = cli.result(spark, o).columns
    assert "mvir_median" in columns and len(columns) == 1 + 1 + 25 * 5 + 3 + 2 * 12  # with step


def test_profile_binary_round_trip(spark, tmp_path):
    radii = {1: [0.0, 1.0], 2: [0.0, 1.0, 2.0, 3.0], 3: [0.0, 2.0, 5.0], 4: []}
    rows = [(i, -1, *[float(i)] * 9, 100, len(r), 7, r) for i, r in radii.items()]
    kinds = ["long"] * 2 + ["double"] * 9 + ["int"] * 3 + ["array<double>"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip([*legacy.PROFILE_FIELDS, "radii"], kinds, strict=True)))
    write_profile_binary(df, str(tmp_path / "p.bin"))
    for size in (1, 2, 100):
        got = read_profile_binary(spark, str(tmp_path / "p.bin"), size).collect()
        assert {r.id: list(r.radii) for r in got} == radii and {r.id: (r.mass, r.np, r.ppbin) for r in got} == {i: (float(i), 100, 7) for i in radii}


def test_plot_commands():
    assert plots.track_plot("t_%d.dat", 2) == "plot 't_0.dat' using 2:(log10($12)) with lines linewidth 1 linecolor rgb 'black' notitle, 't_1.dat' using 2:(log10($12)) with lines linewidth 1 linecolor rgb 'black' notitle"
    assert "2:5" in plots.histogram_plot("h", cdf=True) and "image" in plots.map_plot("m")


def test_cube_profile_and_matching_commands(spark, tmp_path):
    cube = np.full((8, 8, 8), -1.0)
    cube[1, 1, 1], cube[6, 6, 6] = 4, 9
    (tmp_path / "ids.cube").write_bytes(cube.astype("<f8").tobytes())
    (tmp_path / "d.cube").write_bytes(np.ones((8, 8, 8)).astype("<f8").tobytes())
    path = tree_file(tmp_path / "trees.dat")
    near = run(spark, path, "-type=other", "-otherparam=doSpineCatalogAnalysis", f"-mergeTo={tmp_path}/ids.cube", "-box=16").collect()
    assert len(near) == 6 and {r.structure for r in near} <= {4, 9}
    smooth = run(spark, f"{tmp_path}/d.cube", "-type=other", "-otherparam=gaussianSmoothDensity", "-box=16", "-slen=2").collect()
    assert len(smooth) == 512 and all(r.v == pytest.approx(1) for r in smooth)
    assert run(spark, path, "-type=other", "-otherparam=buildDensityCatalog", f"-mergeTo={tmp_path}/d.cube", "-box=16").agg(F.sum("density")).first()[0] == 6
    lines = [" ".join(map(str, [i, -1, 10.0, 6.0, *[0.0] * 7, 700, 8, 100, *range(8)])) for i in (1, 2, 3)]
    (tmp_path / "p.txt").write_text("# profiles\n" + "\n".join(lines) + "\n")
    assert run(spark, f"{tmp_path}/p.txt", "-type=other", "-otherparam=doStackProfiles", "-nbinsx=4").count() > 0
    assert run(spark, f"{tmp_path}/p.txt", "-profiles").count() == 3
    assert run(spark, path, "-type=other", "-otherparam=doReweightMassDistribution", "-x=17").columns == run(spark, path, "-type=toAscii").columns
