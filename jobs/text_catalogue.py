"""A catalogue of texts by size: measured, split into bins, each text with its distance from the median of its kind.

    python -m jobs.text_catalogue --input /data/documents.parquet --output /data/catalogue --bins "%[25,50,75]"

Every text is measured (words, characters, characters a word, distinct words over words, lines). Rows go to the bins of
their number of words that the threshold grammar gives: N (equal counts), 3Q, [a,b], %[a,b], r[lo:hi,...] or %r[lo:hi,...],
where bins hold lo < x <= hi; ranges may overlap, a row is then in each. In every bin and group (a column, null as "und")
the order statistics of characters a word are taken. Output, overwritten by each run, so that a rerun gives the same:

    catalogue/bin_id=.../group=.../   id, n_words, n_chars, n_lines, distinct, length, offset (length less the median), deviation
                                      (offset over the median absolute deviation)
    medians/                          bin_id, group, lo, hi, n, median, d20, d80, mad, ci_lo, ci_hi

A text without words has no length and is in no median. A null text has 0 of everything.
"""

from __future__ import annotations

import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.functions.shared import with_groups
from cosmolith.operators import aggregates, binning
from jobs.common import entry

NAME = "text_catalogue"
log = logging.getLogger(NAME)
GAP = r"[\x20\x09-\x0D]+"


def measured(docs: DataFrame, config: dict) -> DataFrame:
    """id, group, n_words, n_chars, n_lines, distinct, length of each row of docs."""
    text = F.coalesce(F.col(config["text"]), F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    rows = docs.select(F.col(config["id"]).alias("id"), F.coalesce(F.col(config["group"]).cast("string"), F.lit("und")).alias("group"), text.alias("_text"), words.alias("_words"))
    lines = F.size(F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != ""))
    solid = F.length(F.regexp_replace("_text", GAP, ""))
    return rows.select(
        "id", "group", F.size("_words").cast("long").alias("n_words"), F.length("_text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"),
        F.try_divide(F.size(F.array_distinct("_words")).cast("double"), F.size("_words")).alias("distinct"), F.try_divide(solid.cast("double"), F.size("_words")).alias("length"),
    )


def run(spark: SparkSession, config: dict) -> dict:
    """Measures, bins and writes; says what it read and wrote."""
    out = config["output"].rstrip("/")
    docs = spark.read.parquet(config["input"])
    log.info("reading %s", config["input"])
    rows = measured(docs, config)
    edges = binning.bin_edges(rows, "n_words", config["bins"])
    binned = binning.assign_bins(rows, "n_words", edges)
    binned.drop("lo", "hi").write.mode("overwrite").partitionBy("bin_id", "group").parquet(f"{out}/measured")  # texts are read and measured once
    kept = spark.read.schema(f"id {dict(rows.dtypes)['id']}, n_words long, n_chars long, n_lines long, distinct double, length double, bin_id int, group string").parquet(f"{out}/measured")
    stats = aggregates.order_stats(kept, ["bin_id", "group"], "length")
    limits = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(edges)], "bin_id int, lo double, hi double")
    stats.join(F.broadcast(limits), "bin_id").select("bin_id", "group", "lo", "hi", "n", "median", "d20", "d80", "mad", "ci_lo", "ci_hi").coalesce(1).write.mode("overwrite").parquet(f"{out}/medians")
    medians = spark.read.parquet(f"{out}/medians")
    none = kept.select("bin_id", "group").distinct().join(medians, ["bin_id", "group"], "left_anti")  # groups of texts without words
    medians = medians.select("bin_id", "group", "median", "mad").unionByName(none, allowMissingColumns=True)
    offset = F.col("length") - F.col("median")
    final = with_groups(kept, medians, ["bin_id", "group"]).withColumns({"offset": offset, "deviation": F.try_divide(offset, "mad")})
    final.drop("median", "mad").write.mode("overwrite").partitionBy("bin_id", "group").parquet(f"{out}/catalogue")
    said = {"rows_read": docs.count(), "rows_written": spark.read.parquet(f"{out}/catalogue").count(), "bins": len(edges), "groups": spark.read.parquet(f"{out}/medians").count()}
    log.info("read %d rows, wrote %d rows to %s/catalogue and %d to %s/medians", said["rows_read"], said["rows_written"], out, said["groups"], out)
    return said


if __name__ == "__main__":
    entry(NAME, run, __doc__)
