"""The pipeline's near-duplicate stage against exact similarities of 5-word shingles."""

import random

from cosmolith.llm import simhash


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    out = words[:]
    for i in rng.sample(range(len(out)), edits):
        out[i] = "x%d" % rng.randrange(10**9)
    return out


def pairs(low, high, count, seed):
    """Pairs of texts, unlike all others, of a similarity within [low, high)."""
    rng, out = random.Random(seed), []
    while len(out) < count:
        a = ["w%d" % rng.randrange(10**9) for _ in range(rng.randint(60, 300))]
        b = edited(rng, a, max(1, round(len(a) * rng.uniform(0.01, 0.06))))
        if low <= similarity(a, b) < high:
            out.append((a, b))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def kept(spark, texts):
    return {r.doc_id for r in simhash.near_dedup_stage(spark, table(spark, texts), "").collect()}


def test_pairs_from_080_to_090_are_all_found(spark):
    flat = [t for p in pairs(0.8, 0.9, 300, 1) for t in p]
    assert kept(spark, flat) == set(range(0, len(flat), 2))


def test_pairs_below_080_all_stay(spark):
    flat = [t for p in pairs(0.65, 0.8, 300, 2) for t in p]
    assert kept(spark, flat) == set(range(len(flat)))


def test_classes_of_families_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):  # families of edited copies of edited copies
        family = [["w%d" % rng.randrange(10**9) for _ in range(120)]]
        while len(family) < 25:
            family.append(edited(rng, rng.choice(family), rng.randint(1, 4)))
        texts += family
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if a // 25 == b // 25 and least[a] != least[b] and similarity(texts[a], texts[b]) >= 0.8:
                lo, hi = sorted((least[a], least[b]))
                least = [lo if x == hi else x for x in least]
    d = table(spark, texts)
    assert {r.doc_id for r in simhash.near_dedup_stage(spark, d, "").collect()} == set(least) and 12 < len(set(least)) < len(texts) - 12


def test_a_false_link_does_not_part_true_ones():
    """Rows 0-1 and 0-2 are candidates that prove false; the forest of the list leaves 1-2 out, the second round brings it."""
    import numpy as np

    how = simhash.STAGE
    n, low = np.full(3, 100), np.zeros((3, how.minima), np.uint8)
    assert simhash._spanning(n, low, how) == [(0, 1), (0, 2)]
    asked = []
    alike = lambda x, y: asked.append(frozenset((int(x), int(y)))) or {x, y} == {1, 2}
    assert [set(p) for p in simhash.joining(n, low, np.array([b"a", b"b", b"c"]), alike, how)] == [{1, 2}]
    assert set(asked) == {frozenset(p) for p in ((0, 1), (0, 2), (1, 2))}
    assert simhash.joining(n, low, np.array([b"a"] * 3), alike, how) == []


def test_unlike_texts_stay_whatever_their_ids(spark):
    rows = [(None, "one text"), (None, "another text"), (None, "one text"), (5, "a b c"), (5, "d e f"), (5, "a b c"), (6, "d e f"), (None, None), (9, "")]
    d = spark.createDataFrame([(*r, {"k": 1}) for r in rows], "doc_id long, text string, extra map<string, int>")
    got = simhash.near_dedup_stage(spark, d, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(None, "one text"), (None, "another text"), (5, "a b c"), (5, "d e f"), (9, "")], key=str)


def test_long_lists_are_dealt_out(spark, monkeypatch):
    import numpy as np

    rng = random.Random(4)
    base = ["w%d" % rng.randrange(10**9) for _ in range(120)]
    texts = [base] + [edited(rng, base, 2) for _ in range(60)] + [["v%d" % rng.randrange(10**9) for _ in range(50)] for _ in range(20)]
    want = kept(spark, texts)
    prints = spark.createDataFrame([(bytearray(int(x).to_bytes(8, "big")),) for x in {0xABCDEF << 40 | int(y) for y in np.random.default_rng(1).integers(0, 1 << 40, 300)}], "fp binary")
    links = lambda: {frozenset((bytes(r.u), bytes(r.v))) for r in simhash.fingerprint_links(prints, simhash.SimHash(max_bits=14, min_shared=3)).collect()}

    def classes(edges):
        own = {}
        for e in edges:
            merged = set(e).union(*(own.get(x, {x}) for x in e))
            own |= dict.fromkeys(merged, merged)
        return {frozenset(v) for v in own.values()}

    whole = classes(links())
    monkeypatch.setattr(simhash, "LIST", 7)
    monkeypatch.setattr(simhash, "FAMILY", 5)
    assert kept(spark, texts) == want and len(want) == 21
    assert classes(links()) == whole and whole


def test_candidates_come_from_fingerprints_too(spark, monkeypatch):
    """Without any band, texts of one SimHash, or of SimHashes a few bits apart, are candidates; the shingles decide."""
    words = [f"w{i}" for i in range(400)]
    a, other = " ".join(words), " ".join(f"v{i}" for i in range(400))
    docs = spark.createDataFrame([(1, a), (2, a.upper()), (3, f"{a} end"), (4, other), (5, None), (6, " ")], "doc_id long, text string")
    none = spark.createDataFrame([], "u binary, v binary")
    monkeypatch.setattr(simhash, "forest_pairs", lambda prints, how: (none, None))
    found = {bytes(r["node"]): bytes(r["label"]) for r in simhash.near_classes(docs).collect()}
    node = {r["doc_id"]: bytes(r["n"]) for r in docs.select("doc_id", simhash.text_node().alias("n")).collect()}
    assert found[node[1]] == found[node[2]] and found[node[5]] == found[node[6]]
    assert node[4] not in found or len([n for n in found if found[n] == found[node[4]]]) == 1
