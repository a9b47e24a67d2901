"""A training corpus from raw documents: quality rules, near duplicates, private data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cosmolith.llm.common import table, written
from cosmolith.llm.mixing import mixing_stage
from cosmolith.llm.packing import packing_stage
from cosmolith.llm.pii import pii_stage
from cosmolith.llm.quality import quality_stage
from cosmolith.llm.simhash import near_dedup_stage

STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_dedup_stage),
    ("private data", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, XXH64 fingerprints, keyed permutations and a tokenizer are beyond SQL; tests/llm holds the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents; each result is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
