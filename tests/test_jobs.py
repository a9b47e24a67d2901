"""Both jobs on copies of the driver's tables: growing input, reruns, a run that died, the command line."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from jobs import common, text_catalogue, track_histories


def copy(spark, table, path, where="true", parts=1):
    """Rows of a table as new files of a folder."""
    spark.read.parquet(table).where(where).coalesce(parts).write.mode("append").parquet(path)


def rows(spark, path):
    return sorted(map(str, spark.read.parquet(path).collect()))


@pytest.fixture
def grown(spark, sf_dir, tmp_path):
    """An input of two thirds of the events, the settings of a job over it, and what one run over all events gives."""
    events = f"{sf_dir}/events.parquet"
    whole = common.load_config(track_histories.NAME, input=events, output=f"{tmp_path}/whole")
    assert track_histories.run(spark, whole)["rows_read"] == spark.read.parquet(events).count()
    copy(spark, events, f"{tmp_path}/in", "event_id % 3 <> 0")
    return events, common.load_config(track_histories.NAME, input=f"{tmp_path}/in", output=f"{tmp_path}/out"), rows(spark, f"{tmp_path}/whole/histories")


def test_only_what_is_new_is_read(spark, grown, tmp_path):
    events, config, want = grown
    n = spark.read.parquet(events).count()
    first = track_histories.run(spark, config)
    before = rows(spark, f"{tmp_path}/out/histories")
    copy(spark, events, f"{tmp_path}/in", "event_id % 3 = 0", 2)  # late rows of days that are there already
    second = track_histories.run(spark, config)
    assert 0 < second["rows_read"] < first["rows_read"] and first["rows_read"] + second["rows_read"] == n
    assert rows(spark, f"{tmp_path}/out/histories") == want != before
    third = track_histories.run(spark, config)
    assert (third["rows_read"], third["rows_written"]) == (0, 0) and rows(spark, f"{tmp_path}/out/histories") == want


def test_a_batch_that_is_run_again_counts_once(spark, grown, tmp_path):
    """The last batch's end is forgotten, as if the run had died before it; and histories were not made."""
    events, config, want = grown
    track_histories.run(spark, config)
    copy(spark, events, f"{tmp_path}/in", "event_id % 3 = 0")
    track_histories.run(spark, config)
    commits = tmp_path / "out" / "checkpoint" / "commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        (commits / f).unlink()
    shutil.rmtree(tmp_path / "out" / "histories")
    shutil.rmtree(tmp_path / "out" / "marks")
    again = track_histories.run(spark, config)
    assert again["rows_read"] > 0 and rows(spark, f"{tmp_path}/out/histories") == want


def test_odd_rows_and_empty_input(spark, tmp_path):
    nan = float("nan")
    odd = [(1, "2024-01-01 10:00:00", 2.0), (1, "2024-01-01 11:00:00", 3.0), (1, "2024-02-01 00:00:00", 4.0), (None, "2024-01-01 00:00:00", 1.0), (1, None, 1.0), (1, "2024-01-01 00:00:00", nan), (1, "2024-01-01 00:00:00", None), (2, "2024-01-05 00:00:00", 0.0)]
    df = spark.createDataFrame(odd, "user_id long, ts string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "value", "7 as n", "'x' as batch")
    df.where("false").write.parquet(f"{tmp_path}/in")
    config = common.load_config(track_histories.NAME, input=f"{tmp_path}/in", output=f"{tmp_path}/out")
    assert track_histories.run(spark, config)["rows_written"] == 0
    df.write.mode("append").parquet(f"{tmp_path}/in")
    assert track_histories.run(spark, config)["rows_read"] == len(odd)
    got = {(r.track, str(r.day)): r for r in spark.read.parquet(f"{tmp_path}/out/histories").collect()}
    assert set(got) == {(1, "2024-01-01"), (1, "2024-02-01"), (2, "2024-01-05")}
    r = got[1, "2024-01-01"]
    assert (r.n, r.mass, r.total, r.peak, r.month) == (2, 5.0, 5.0, 5.0, "2024-01") and r.rate == pytest.approx(4 / 31)
    assert got[1, "2024-02-01"].since_peak_min == pytest.approx(0.8) and got[2, "2024-01-05"].rate is None
    assert sorted(os.listdir(tmp_path / "out" / "histories"))[-2:] == ["month=2024-01", "month=2024-02"]


@pytest.mark.parametrize("bins", ["r[:64,64:256,256:1024,1024:]", "%[25,75]", "r[:100,50:]"])
def test_text_catalogue(spark, sf_dir, tmp_path, bins):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, " \n ", "zz"), (10**6 + 3, "One two two", "en")], docs.schema))
    docs.write.parquet(f"{tmp_path}/docs")
    config = common.load_config(text_catalogue.NAME, input=f"{tmp_path}/docs", output=f"{tmp_path}/out", bins=bins)
    said = text_catalogue.run(spark, config)
    got = rows(spark, f"{tmp_path}/out/catalogue")
    assert text_catalogue.run(spark, config) == said and rows(spark, f"{tmp_path}/out/catalogue") == got
    table = spark.read.parquet(f"{tmp_path}/out/catalogue").collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sizes = {i: len(t.split()) for i, t in texts.items()}
    if bins.startswith("r[:64"):
        assert sorted(r.id for r in table) == sorted(texts)
    elif bins.startswith("r"):
        assert len(table) == sum((n <= 100) + (n > 50) for n in sizes.values())  # a row is in every range that holds it
    else:
        assert sorted(r.id for r in table) == sorted(i for i, n in sizes.items() if n > min(sizes.values()))
    kinds = {}
    for r in table:
        words = texts[r.id].split()
        assert (r.n_words, r.n_chars) == (len(words), len(texts[r.id]))
        if words:
            assert r.length == pytest.approx(sum(map(len, words)) / len(words)) and r.distinct == pytest.approx(len(set(words)) / len(words))
            kinds.setdefault((r.bin_id, r.group), []).append(r.length)
        else:
            assert r.length is None and r.offset is None
    median = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    assert all(r.offset == pytest.approx(r.length - median(kinds[r.bin_id, r.group]), abs=1e-12) for r in table if r.length is not None)
    assert {(m.bin_id, m.group): (m.n, m.median) for m in spark.read.parquet(f"{tmp_path}/out/medians").collect()} == {k: (len(v), pytest.approx(median(v))) for k, v in kinds.items()}


def test_command_line(sf_dir, tmp_path):
    config = json.load(open(os.path.join(common.HERE, "text_catalogue.json")))
    (tmp_path / "own.json").write_text(json.dumps(config | {"bins": "3Q"}))
    call = [sys.executable, "-m", "jobs.text_catalogue", "--config", str(tmp_path / "own.json"), "--input", f"{sf_dir}/documents.parquet", "--output", str(tmp_path / "out")]
    root = os.path.dirname(common.HERE)
    done = subprocess.run(call, cwd=root, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows to" in done.stderr and any(f.startswith("bin_id=") for f in os.listdir(tmp_path / "out" / "catalogue"))
    done = subprocess.run([*call[:3], "--input", "x"], cwd=root, capture_output=True, text=True, timeout=100)
    assert done.returncode == 2 and "output" in done.stderr
    with pytest.raises(ValueError, match="no setting"):
        common.load_config("track_histories", typo="x")
