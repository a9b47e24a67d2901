"""Secrets of either case."""

import re

from cosmolith.llm import pii


def test_secrets_of_either_case_are_replaced(spark):
    low = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    mixed = low[:20] + low[20:].upper()
    d = spark.createDataFrame([(1, f'token = "{low}"'), (2, f'TOKEN = "{low.upper()}"'), (3, f"a {mixed} b")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(d, ["doc_id"]).collect()}
    one, two, three = (re.search("[0-9A-Fa-f]{40}", rows[i].text)[0] for i in (1, 2, 3))
    assert one == one.lower() != low and two == one.upper() and three != mixed
    assert re.sub("[a-f]", "a", re.sub("[A-F]", "A", re.sub("[0-9]", "9", three))) == re.sub("[a-f]", "a", re.sub("[A-F]", "A", re.sub("[0-9]", "9", mixed)))
    assert all(r.n_secret == 1 for r in rows.values())
