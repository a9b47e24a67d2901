"""The queries that SQL can state, against DuckDB over whole tables."""

import duckdb
import pytest

from cosmolith.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf_dir).select(*columns).toPandas().values.tolist()
    plain = lambda rows: sorted(repr([v.tolist() if hasattr(v, "tolist") else v for v in r]).replace("array", "") for r in rows)
    assert len(got) > 0
    flat = lambda v: [list(map(int, x)) for x in v] if hasattr(v, "__len__") and not isinstance(v, str) else v
    assert plain([[flat(v) for v in r] for r in got]) == plain([[flat(v) for v in r] for r in want.fetchall()])


@pytest.mark.parametrize("parts", [2, 13])
def test_substring_dedup_does_not_depend_on_the_chunks(spark, sf_dir, parts):
    """One chunk settles what repeats within it; over many, anchors ask and windows meet across them."""
    from cosmolith.llm.substring_dedup import substring_dedup

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(parts)
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({ORACLE_SQL['op5_substring_dedup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_removed for r in got) > 0
