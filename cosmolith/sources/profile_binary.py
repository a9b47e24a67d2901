"""The ragged binary profile file, as a Spark data source and a writer.

The file holds an int64 n; n fixed records; then, for each radial bin, an int64 k and the k radii of the profiles that
have that bin (profiles come with the most bins first, so those are the first k); a k of 0 ends it. A task reads a range
of profiles: its records, and its stretch of every block that reaches it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cosmolith.functions.shared import written
from cosmolith.sources.legacy import PROFILE_FIELDS, created, opened

# Fixed values of the format: two int64, nine doubles, three int32, and padding to a multiple of eight bytes.
RECORD = np.dtype([("id", "<i8"), ("parent_id", "<i8"), *((c, "<f8") for c in PROFILE_FIELDS[2:11]), ("np", "<i4"), ("n_rbins", "<i4"), ("ppbin", "<i4"), ("pad", "<i4")])
KINDS = ["long", "long", *["double"] * 9, "int", "int", "int"]
SCHEMA = ", ".join(f"{c} {k}" for c, k in zip(PROFILE_FIELDS, KINDS, strict=True)) + ", radii array<double>"


class _Profiles(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("rowsPerPartition", 1 << 16))

    def partitions(self) -> list[InputPartition]:
        with opened(self.path) as f:
            (n,) = struct.unpack("<q", f.read(8))
        return [_Profiles(lo, min(n, lo + self.size)) for lo in range(0, n, self.size)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        with opened(self.path) as f:
            (n,) = struct.unpack("<q", f.read(8))
            f.seek(8 + part.lo * RECORD.itemsize)
            records = np.frombuffer(f.read((part.hi - part.lo) * RECORD.itemsize), RECORD)
            at, radii = 8 + n * RECORD.itemsize, [[] for _ in records]
            while True:
                f.seek(at)
                head = f.read(8)
                k = struct.unpack("<q", head)[0] if len(head) == 8 else 0
                if k <= part.lo:  # later blocks are no longer than this one
                    break
                f.seek(at + 8 + 8 * part.lo)
                for own, r in zip(radii, np.frombuffer(f.read(8 * (min(k, part.hi) - part.lo)), "<f8").tolist()):
                    own.append(r)
                at += 8 + 8 * k
        for record, own in zip(records, radii, strict=True):
            yield (*(v.item() for v in list(record)[:-1]), own)


class ProfileSource(DataSource):
    """format("profile_bin"): a profile file on a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "profile_bin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_profile_binary(spark: SparkSession, path: str, rows_per_partition: int = 1 << 16) -> DataFrame:
    spark.dataSource.register(ProfileSource)
    return spark.read.format("profile_bin").option("path", path).option("rowsPerPartition", rows_per_partition).load()


def write_profile_binary(profiles: DataFrame, path: str) -> None:
    """One file at a local path, for hand-over to other programs; rows stream through the driver. n_rbins follows radii."""
    kept = written(profiles.withColumn("n_rbins", F.size("radii")).select(*(F.col(c).cast(k) for c, k in zip(PROFILE_FIELDS, KINDS, strict=True)), "radii"))
    with created(path) as f:
        f.write(struct.pack("<q", kept.count()))
        for r in kept.select(*PROFILE_FIELDS).orderBy(F.desc("n_rbins"), "id").toLocalIterator():
            f.write(np.array([(*r, 0)], RECORD).tobytes())
        cells = kept.select("id", "n_rbins", F.posexplode("radii").alias("bin", "r")).orderBy("bin", F.desc("n_rbins"), "id")
        now, block = 0, []
        for r in cells.select("bin", "r").toLocalIterator():
            if r.bin != now:
                f.write(struct.pack(f"<q{len(block)}d", len(block), *block))
                now, block = r.bin, []
            block.append(r.r)
        if block:
            f.write(struct.pack(f"<q{len(block)}d", len(block), *block))
        f.write(struct.pack("<q", 0))


def with_masses(profiles: DataFrame) -> DataFrame:
    """Every bin holds ppbin particles, so the mass within bin i is i times that; in the units of a particle."""
    return profiles.withColumn("masses", F.transform("radii", lambda r, i: i.cast("double") * F.col("ppbin")))
