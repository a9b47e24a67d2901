"""The vector operator against all pairs, and the pipeline as a whole."""

import numpy as np

from cosmolith.llm.embedding_dedup import codes, embedding_dedup, hadamard, HOW


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(hadamard(x) / 8, axis=1), np.linalg.norm(x, axis=1))
    assert codes(x, HOW).shape == (5, HOW.tables, HOW.probes)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for c in range(12):
        centre = rng.normal(size=64)
        for _ in range(10):
            rows.append((k, [float(v) for v in centre + rng.normal(size=64) * 0.15], c % 3))
            k += 1
    rows += [(k, rows[0][1], 0), (k, rows[0][1], 0), (k + 1, [0.0] * 64, 1), (k + 2, None, 1), (k + 3, rows[5][1], None), (k + 4, [float("nan")] + [1.0] * 63, 1), (k + 5, [], 1), (k + 6, [1.0, 2.0], 1), (k + 7, [2.0, 4.0], 1), (k + 8, [None] + [1.0] * 63, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup(df).collect()]
    ok = lambda e, l: l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
    n, group = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[a], rows[b]
            if ok(x, p) and ok(y, q) and p == q and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                n[a], n[b] = n[a] + 1, n[b] + 1
                group = [group[b] if g == group[a] else g for g in group]
    want = [(r[0], c, min(s[0] for s, h in zip(rows, group, strict=True) if h == g)) for r, c, g in zip(rows, n, group, strict=True)]
    assert sum(x[1] for x in got) >= 0.9 * sum(n) > 0
    assert {(x[0], x[2]) for x in got} == {(x[0], x[2]) for x in want} and len(got) == len(rows)
    by = dict((x[0], x[1]) for x in want)
    assert all(x[1] <= by[x[0]] for x in got)
    assert embedding_dedup(df.where("false")).count() == 0


def test_pipeline(spark, sf_dir):
    import __spark_entry__
    import corpus_pipeline

    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "private data", "mixing", "packing"]
    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() > 0


def test_stages_take_odd_rows(spark, cluttered, nothing):
    import corpus_pipeline

    for d in (cluttered, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, "")
            assert name == "packing" or out.columns == d.columns
            assert d is not nothing or out.count() == 0
            out.count()
