"""Growth histories of tracks, kept up to date as files of new snapshots arrive.

    python -m jobs.track_histories --input /data/events.parquet --output /data/histories

A file stream with a checkpoint takes each file of `input` once. Every batch is summed by track and day and written as
`increments`, a partition for each batch; a batch that is run again after a failure overwrites its own partition. Late
rows of past days are an increment like any other. Histories are then made from all increments (rows of track and day, not
of snapshots) and overwrite `histories`, partitioned by month. `marks` has the last batch that histories hold: a run that
finds nothing new leaves them as they are, and one that died between stream and histories makes them. The checkpoint
(by default in `output`) belongs to the output: delete both or neither.

histories has for each track and day with rows: n, mass (their sum), total (mass up to that day), rate (growth of total a
day until the track's next day), peak (greatest daily mass so far), peak_day and since_peak_min (least mass over the peak
since then). Rows without track or time, or without a finite mass, are left out; masses are summed to six decimals.
"""

from __future__ import annotations

import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.shared import finite
from cosmolith.operators import tracks
from jobs.common import entry, exists

NAME = "track_histories"
log = logging.getLogger(NAME)


def increment(rows: DataFrame, config: dict) -> DataFrame:
    """track, day, n, mass of new rows."""
    track, time, mass = F.col(config["track"]), F.col(config["time"]), F.col(config["mass"])
    own = rows.select(track.alias("track"), F.to_date(time).alias("day"), mass.cast("double").alias("mass"))
    own = own.where(F.col("track").isNotNull() & F.col("day").isNotNull() & finite("mass"))
    return own.groupBy("track", "day").agg(F.count("*").alias("n"), F.sum(F.col("mass").cast("decimal(24,6)")).alias("mass"))


def histories(increments: DataFrame) -> DataFrame:
    """The histories that increments add up to."""
    days = increments.groupBy("track", "day").agg(F.sum("n").alias("n"), F.sum("mass").alias("_mass"))
    days = days.withColumn("_t", F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double"))
    so_far = Window.partitionBy("track").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({"mass": F.col("_mass").cast("double"), "total": F.sum("_mass").over(so_far).cast("double")})
    grown = tracks.differences(days, "track", "_t", "total")
    grown = tracks.running_peak(grown, "track", "_t", "mass").withColumn("peak_day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("peak_time").cast("int")))
    return grown.select("track", "day", "n", "mass", "total", "rate", "peak", "peak_day", "since_peak_min", F.date_format("day", "yyyy-MM").alias("month"))


def run(spark: SparkSession, config: dict) -> dict:
    """One pass over what is new in config["input"]; says what it read and wrote."""
    out = config["output"].rstrip("/")
    source = config["input"].rstrip("/")
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rpartition("/")
    pattern = f"{folder}/{{{name}}}" if folder else f"{{{name}}}"  # a pattern of this one name: a stream takes a folder or, so, a single file
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern)

    read: dict[int, int] = {}

    def add(rows: DataFrame, batch: int) -> None:
        if rows.isEmpty():  # nothing is observed of an empty table
            read[batch] = 0
            return
        seen = Observation()
        to = increment(rows.observe(seen, F.count(F.lit(1)).alias("n")), config).withColumn("batch", F.lit(batch).cast("long"))
        to.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/increments")
        read[batch] = seen.get["n"]
        log.info("batch %d: %d rows", batch, read[batch])

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", config["checkpoint"] or f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d rows in %d batches from %s", sum(read.values()), len(read), source)
    increments, marks = exists(spark, f"{out}/increments"), exists(spark, f"{out}/marks")
    said = {"rows_read": sum(read.values()), "batches": sorted(read), "rows_written": 0}
    last = increments.agg(F.max("batch")).first()[0] if increments is not None else None
    done = marks.agg(F.max("batch")).first()[0] if marks is not None else None
    if last is None or last == done:
        log.info("nothing new: %s stands", out)
        return said
    made = histories(increments)
    made.repartition("month", F.pmod(F.xxhash64("track"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{out}/histories")
    spark.range(1).select(F.lit(last).alias("batch"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{out}/marks")
    said["rows_written"] = spark.read.parquet(f"{out}/histories").count()
    log.info("wrote %d rows to %s/histories", said["rows_written"], out)
    return said


if __name__ == "__main__":
    entry(NAME, run, __doc__)
