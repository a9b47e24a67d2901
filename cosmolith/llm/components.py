"""Connected components over an edge table: alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cosmolith.llm.common import delete, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v), of any one type that orders; component is the least node it can reach.

    Self-loops and repeated edges do no harm; rows with a null end are dropped, as they link nothing. Every round is
    written to the shared folder, which cuts the lineage; the table before it is then deleted. A hub's rows meet in
    joins only, which adaptive execution can split, and in minima, which are taken before the shuffle.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = tuple(mark)
        nxt, at = written(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct(), "edges")
        delete(spark, path)
        now, path = nxt, at
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
