"""Tables in the folder that all executors share; ranks and counts over whole tables without a single-task window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session in one process (tests, local runs) that sets none gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cosmolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, column: str, spread: str) -> DataFrame:
    """written(), with a folder for each value of a column, so that a filter on it reads those rows only. Rows are spread by
    range on the column and `spread`, so a task writes few folders and a value with many rows has many files."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.repartitionByRange(column, spread).write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def finite(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))


def same_keys(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """left joined with right, which holds one row for each value of `by`; nulls are alike. Without `by`, right is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & left[c].eqNullSafe(named[f"_k{i}"])
    return left.join(named, on, how).drop(*(f"_k{i}" for i in range(len(by))))


def with_groups(df: DataFrame, groups: DataFrame, by: list[str], most: int = 100_000) -> DataFrame:
    """df joined with groups, which holds one row for each value of `by`; nulls are alike. That table is written and counted first: up to
    `most` rows it is broadcast, so df stays where it is; with more groups both sides are exchanged, as then keys are many."""
    kept = written(groups)
    return same_keys(df, F.broadcast(kept) if kept.count() <= most else kept, by, "inner")


FEW = 1_000_000  # rows of a table that is left to Spark's own exchanges
ROWS_A_TASK = 100_000  # of a larger one
HEAVY = 10_000  # rows of one key; in a table of n rows there are at most n / HEAVY such keys


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as `rows` rows need at ROWS_A_TASK each: unlike an exchange that is made for a join and
    merged to the number of cores, a task's share does not grow with the table. Two tables dealt alike are joined as they lie."""
    return df if rows <= FEW else df.repartition(-(-rows // ROWS_A_TASK), *keys)


def looked_up(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """left, written and without null keys, joined with right, of at most `rows` rows, one for each key. Keys that more than HEAVY rows of left
    share are few: their rows of right are broadcast, so no task gathers them; all others are dealt."""
    if rows <= FEW:
        return left.join(right, key, how)
    heavy = written(left.groupBy(key).count().where(F.col("count") > HEAVY).select(key))
    if heavy.isEmpty():
        return dealt(left, rows, key).join(dealt(right, rows, key), key, how)
    many = F.broadcast(right.join(F.broadcast(heavy), key, "left_semi"))  # at most rows / HEAVY
    rest = dealt(left.join(F.broadcast(heavy), key, "left_anti"), rows, key).join(dealt(right, rows, key), key, how)
    return rest.unionByName(left.join(F.broadcast(heavy), key, "left_semi").join(many, key, how))


def ranked(df: DataFrame, order: list[str], rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """df with the 0-based rank of each row by `order` (within `by`), in parallel: a range exchange sorts the rows, each
    partition numbers its own, and the partitions' counts (one row each) give where a partition starts. A group that
    holds a third of all rows is spread over partitions like any other, and so are rows alike in `order`: a number of the
    row's place in its input comes last in the order. Which of them is ranked first is open."""
    spark, by = df.sparkSession, by or []
    place = F.xxhash64(F.monotonically_increasing_id())
    sorted_ = df.withColumn("_place", place).repartitionByRange(*by, *order, "_place").sortWithinPartitions(*by, *order, "_place").drop("_place")
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    kept = written(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_low", low))
    sizes, start, at = kept.groupBy("_part").count().collect(), [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        start.append((r["_part"], at))
        at += r["count"]
    starts = spark.createDataFrame(start, "_part int, _start long")
    out = kept.join(F.broadcast(starts), "_part").withColumn(rank, F.col("_start") + F.col("_low")).drop("_part", "_low", "_start")
    if by:
        first = out.groupBy(*by).agg(F.min(rank).alias("_first"))
        out = with_groups(out, first, by).withColumn(rank, F.col(rank) - F.col("_first")).drop("_first")
    return out


def counted(df: DataFrame, value: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """by, value, n (rows with that value, or the sum of their weights), before (those of lesser values) and total (of the
    group): enough to read any order statistic off. Equal values are summed before any exchange; distinct ones are spread
    by range, summed up within a partition, and the sums of the partitions (one row for each and group) are carried on."""
    by = by or []
    own = df.groupBy(*by, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    kept = written(own.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    sums = kept.groupBy("_part", *by).agg(F.sum("n").alias("_sum"))
    w = Window.partitionBy(*by)
    sums = sums.withColumns({"_start": F.sum("_sum").over(w.orderBy("_part")) - F.col("_sum"), "total": F.sum("_sum").over(w)}).drop("_sum")
    here = F.sum("n").over(Window.partitionBy("_part", *by).orderBy(value)) - F.col("n")
    return same_keys(kept.withColumn("_here", here), sums, ["_part", *by], "inner").select(*by, value, "n", (F.col("_start") + F.col("_here")).alias("before"), "total")


def at_rank(value: str | Column, rank: Column) -> Column:
    """Of a group of counted(): the value at a 0-based rank."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), v))
