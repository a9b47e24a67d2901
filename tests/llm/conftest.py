import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Small documents with copies, near copies, shared passages, and every odd case: null and empty texts, a long one,
    repeated rows, a null id and a null source."""
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(40)]
    rows = [(i, " ".join(w), "en", f"s{i % 3}") for i, w in enumerate(base)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows += [(100 + i, f"{rows[i][1]}\n{shared}\t{rows[i + 1][1]}", "de", "s1") for i in range(6)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(5)]
    near = base[3][:]
    near[50 % len(near)] = "other"
    rows += [(300, " ".join(near), "en", "s2"), (301, " ".join(near), "en", "s2"), (301, " ".join(near), "en", "s2")]
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, " \n\t ", "en", "s0"), (403, "One", "fr", None), (None, rows[7][1], "en", "s1")]
    rows += [(500, " ".join(rng.choice(vocabulary) for _ in range(30_000)), "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, prose):
    return spark.createDataFrame(prose, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def cluttered(docs):
    """docs with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "taken", "target", "copies", "kept", "quality", "n_words", "fp", "key", "_key", "_row", "first", "spans", "bucket", "label", "score", "n_cards", "component_id", "n_chars"]
    return docs.select("*", *(F.lit(7).alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
