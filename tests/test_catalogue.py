"""Each query against its SQL in DuckDB, on the smallest driver tables."""

import duckdb
import pytest

from cosmolith.plans.registered import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings documents".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canon(rows):
    value = lambda v: float(v) if type(v).__name__ in ("int", "float", "Decimal") else v
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = canon([tuple(r[c] for c in cols) for r in df.collect()])
    out = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    assert got == canon([tuple(r[names.index(c)] for c in cols) for r in out.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


HALVES = {  # tracks (event_id, second, value) with results half way between two roundings
    "span_rates": [(5001906, 1706228147, 20.9), (5081691, 1706262707, 6.05)],
    "running_peak": [(1, 1705323678, 256.0), (2, 1705323690, 2.01), (3, 1705323700, 4.05)],
    "progenitor_diff": [(1, 1705241264, 64.46), (2, 1705248944, 2.36), (3, 1705302239, 2.36)],
    "lag2_derivative": [(1, 1705419303, 68.91), (2, 1705459710, 12.16), (3, 1705483303, 29.65), (4, 1705483304, 68.91)],
}


@pytest.mark.parametrize("name", sorted(HALVES))
def test_halves_are_rounded_as_in_the_sql(spark, tmp_path, name):
    """Results that lie half way are the SQL's to the last digit, and to the sign of a zero."""
    c = duckdb.connect()
    c.execute("CREATE TABLE e (event_id bigint, t bigint, value double)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?)", HALVES[name])
    c.execute(f"COPY (SELECT event_id, make_timestamp(t * 1000000) ts, 1::bigint user_id, 'view' event_type, value FROM e) TO '{tmp_path}/events.parquet'")
    c.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = c.execute(ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).select(*cols).collect())
