"""Text tables and the binary formats: column blocks (.bin), rows (.bin2) and voxel cubes, as Spark data sources.

A text table is lines of numbers; `#` starts a comment. A .bin file has the header lines `# NUM_LINES n` and
`# NUM_FIELDS m`, then m blocks of n little-endian doubles; a .bin2 file two int64 (n, m), then n rows of m doubles; a
cube dim**3 values, z fastest, after a header of given size. Files are read by ranges, one task each, through readers that seek.
"""

from __future__ import annotations

import functools
import io
import itertools
import math
import operator
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from cosmolith.functions.shared import ranked, written

BATCH = 1 << 16


_PLAIN = r"[+-]?+[0-9]++\.?+[0-9]*+(?:[eE][+-]?+[0-9]++)?+"  # a number as most are written
_NAMED = rf"(?:{_PLAIN}|\.[0-9]++(?:[eE][+-]?+[0-9]++)?+|(?i:[+-]?+inf(?:inity)?+|nan))"


def _fields(line: str, delimiter: str, n: int) -> tuple[Column, Column]:
    """(the fields of a line, whether the line is malformed): n fields, each of which is read as a number. `nan`, `inf` and
    `-inf` are numbers; Java's own notations (a type letter behind, hexadecimal) are not. Fields between white space are
    told by a pattern of the line; only lines that it doesn't match are looked at field by field."""
    line = F.trim(line)
    parts = F.split(line, delimiter)
    number = lambda p: F.when(~p.rlike("(?i)[0-9.][df]$|x"), p.try_cast("double"))
    good = (F.size(parts) == n) & ~F.exists(parts, lambda p: number(p).isNull())
    if delimiter == r"\s+" and n:
        wide = functools.reduce(operator.or_, (F.contains(line, F.lit(x)) for x in ("  ", "\t", "\v", "\f", "\r")))
        parts = F.when(wide, parts).otherwise(F.split(line, " "))  # without a pattern
        plain, named = (line.rlike(rf"\A{x}(?:\s++{x}){{{n - 1}}}\z") for x in (_PLAIN, _NAMED))
        good = plain | named | good
    return parts, ~good


def _number(fields: str, i: int) -> Column:
    """The i-th field of a line that is not malformed."""
    return F.get(fields, i).try_cast("double")


def read_text(spark: SparkSession, path: str, names: list[str], delimiter: str = r"\s+", mode: str = "DROPMALFORMED") -> DataFrame:
    """Rows of doubles. Lines with a field that is no number, or too few or too many fields, are dropped (DROPMALFORMED), kept
    with nulls and the line in _corrupt (PERMISSIVE), or stop the read (FAILFAST). What isn't finite is read as it is."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts, bad = _fields("value", delimiter, len(names))
    if mode == "DROPMALFORMED":
        return lines.where(~bad).select(parts.alias("_v")).select(*(_number("_v", i).alias(n) for i, n in enumerate(names)))
    lines = lines.withColumns({"_v": parts, "_bad": bad})
    if mode == "FAILFAST":
        lines = lines.withColumn("_v", F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("array<string>")).otherwise(F.col("_v")))
    cols = [F.when(~F.col("_bad"), _number("_v", i)).alias(n) for i, n in enumerate(names)]
    return lines.select(*cols, *([F.when(F.col("_bad"), F.col("value")).alias("_corrupt")] if mode == "PERMISSIVE" else []))


PACKED_ROWS = 1_000_000  # of a compressed text file


def write_text(df: DataFrame, path: str, digits: int = 10, delimiter: str = " ", compression: str | None = None) -> None:
    """One line per row; doubles with `digits` significant digits (17 or more: as few as give the same double again), `nan`,
    `inf` and `-inf` by name, null as `nan`, so that every row has all its fields and is read again. compression: a codec of
    Spark's text writer; as such files aren't split by a reader, a file then has at most PACKED_ROWS rows."""

    def field(c: str, kind: str) -> Column:
        v = F.col(c)
        if kind not in ("double", "float"):
            return F.coalesce(v.cast("string"), F.lit("nan"))
        number = v.cast("double").cast("string") if digits >= 17 else F.format_string(f"%.{digits}g", v)
        return F.when(v.isNull() | F.isnan(v), F.lit("nan")).when(F.abs(v) == float("inf"), F.when(v > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(number)

    df.select(F.concat_ws(delimiter, *(field(c, t) for c, t in df.dtypes)).alias("value")).write.option("maxRecordsPerFile", PACKED_ROWS if compression else 0).text(path, compression=compression)


def _located(path: str):
    """The file system and the place in it: of a local path, or of the address of a store that pyarrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def opened(path: str):
    """A file for reading at any place."""
    fs, at = _located(path)
    return fs.open_input_file(at)


def created(path: str):
    """A new file, with the folders on the way to it."""
    fs, at = _located(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(at)


def header(path: str) -> tuple[str, int, int, int]:
    """(kind, rows, fields, bytes before the data) without reading the data."""
    with opened(path) as f:
        head = f.read(256)
    if found := re.match(rb"#\s*NUM_LINES\s+(\d+)\s*\n#\s*NUM_FIELDS\s+(\d+)\s*\n", head):
        return "bin", int(found[1]), int(found[2]), found.end()
    n, m = struct.unpack("<qq", head[:16])
    return "bin2", n, m, 16


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: dict[str, int]) -> None:
        self.path, self.columns = options["path"], columns
        self.kind, self.n, self.m, self.skip = header(self.path)
        self.size = int(options.get("rowsPerPartition", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        return [_Range(lo, min(self.n, lo + self.size)) for lo in range(0, self.n, self.size)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        """Arrow batches of the asked columns. Of a .bin file only their blocks are read; rows of a .bin2 file come whole."""
        names = ["row_idx", *self.columns]
        with opened(self.path) as f:
            for lo in range(part.lo, part.hi, BATCH):
                hi = min(lo + BATCH, part.hi)
                if self.kind == "bin":
                    found = []
                    for k in self.columns.values():
                        f.seek(self.skip + 8 * (k * self.n + lo))
                        found.append(np.frombuffer(f.read(8 * (hi - lo)), "<f8"))
                else:
                    f.seek(self.skip + 8 * self.m * lo)
                    rows = np.frombuffer(f.read(8 * self.m * (hi - lo)), "<f8").reshape(-1, self.m)
                    found = [np.ascontiguousarray(rows[:, k]) for k in self.columns.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), *map(pa.array, found)], names=names)


class CatalogueSource(DataSource):
    """format("catalogue_bin"): .bin and .bin2 files on a path that all executors see, as row_idx and named doubles."""

    @classmethod
    def name(cls) -> str:
        return "catalogue_bin"

    def _columns(self) -> dict[str, int]:
        """The asked columns with their places in the file."""
        given = self.options.get("names")
        names = given.split(",") if given else [f"c{i}" for i in range(header(self.options["path"])[2])]
        asked = self.options.get("columns")
        return {c: names.index(c) for c in (asked.split(",") if asked else names)}

    def schema(self) -> StructType:
        return StructType([StructField("row_idx", LongType()), *(StructField(n, DoubleType()) for n in self._columns())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, self._columns())


def sniffed(path: str) -> str:
    """bin, bin2, parquet or text: by extension, and without one by how the file begins."""
    end = path.rsplit(".", 1)[-1]
    if end in ("bin", "bin2", "parquet"):
        return end
    with opened(path) as f:
        return "bin" if f.read(11) == b"# NUM_LINES" else "text"


def read_catalogue(spark: SparkSession, path: str, names: list[str] | None = None, kind: str | None = None, columns: list[str] | None = None, rows_per_partition: int = 1 << 20) -> DataFrame:
    """By extension or header: .bin and .bin2 through the source above, .parquet, else text. Of a binary table only
    `columns` are read, where they are given."""
    kind = kind or sniffed(path)
    if kind in ("bin", "bin2"):
        spark.dataSource.register(CatalogueSource)
        r = spark.read.format("catalogue_bin").option("path", path).option("rowsPerPartition", rows_per_partition)
        for k, v in (("names", names), ("columns", columns)):
            r = r.option(k, ",".join(v)) if v else r
        return r.load()
    found = spark.read.parquet(path) if kind == "parquet" else read_text(spark, path, names or [])
    return found.select(*columns) if columns else found


def _streamed(kept: DataFrame, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The asked columns of a written table on the driver, a batch at a time, in the order of its files."""
    for uri in sorted(kept.inputFiles()):
        with opened(uri) as f:
            yield from pq.ParquetFile(f).iter_batches(1 << 16, columns=columns)


def write_bin(df: DataFrame, path: str, rows: bool = False) -> None:
    """A .bin (or, with rows, .bin2) file. df is worked out once, into the shared folder; its columns are then streamed
    into the one file as Arrow batches, a column's at a time for .bin.

    The format is one file in column order, for hand-over to other programs; large results belong in Parquet.
    """
    kept = written(df.select(*(F.col(c).cast("double").alias(c) for c in df.columns)))
    n, names = kept.count(), df.columns
    flat = lambda a: a.fill_null(math.nan).to_numpy(zero_copy_only=False).astype("<f8")
    with created(path) as f:
        if rows:
            f.write(struct.pack("<qq", n, len(names)))
            for b in _streamed(kept, names):
                f.write(np.stack([flat(b.column(c)) for c in names], axis=1).tobytes())
        else:
            f.write(f"# NUM_LINES {n}\n# NUM_FIELDS {len(names)}\n".encode())
            for c in names:
                for b in _streamed(kept, [c]):
                    f.write(flat(b.column(0)).tobytes())


def read_cube(spark: SparkSession, path: str, dim: int, skip: int = 0, dtype: str = "<f8") -> DataFrame:
    """(ix, iy, iz, v) of a cube; one task per x plane range, by fixed-length records of one plane."""
    width = np.dtype(dtype).itemsize
    planes = spark.range(dim).repartition(min(dim, 64))

    def run(batches):
        import pandas as pd

        for rows in batches:
            for x in rows["id"]:
                with opened(path) as f:
                    f.seek(skip + int(x) * dim * dim * width)
                    v = np.frombuffer(f.read(dim * dim * width), dtype)
                iy, iz = np.divmod(np.arange(dim * dim, dtype=np.int32), np.int32(dim))
                yield pd.DataFrame({"ix": np.int32(x), "iy": iy, "iz": iz, "v": v.astype(float)})

    return planes.mapInPandas(run, "ix int, iy int, iz int, v double")


def write_cube(cube: DataFrame, path: str, dim: int, dtype: str = "<f8") -> None:
    """A cube file from (ix, iy, iz, v), absent voxels 0: sorted in parallel, then streamed, a plane in memory at a time."""
    kept = written(cube.select("ix", "iy", "iz", "v").repartitionByRange("ix", "iy", "iz").sortWithinPartitions("ix", "iy", "iz"))
    now, plane = 0, np.zeros(dim * dim, dtype)
    with created(path) as f:
        for b in _streamed(kept, ["ix", "iy", "iz", "v"]):
            x, y, z, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            while len(x):
                same = int(np.searchsorted(x, now, "right"))
                plane[y[:same].astype(np.int64) * dim + z[:same]] = v[:same]
                x, y, z, v = x[same:], y[same:], z[same:], v[same:]
                if len(x):
                    f.write(plane.tobytes())
                    now, plane = now + 1, np.zeros(dim * dim, dtype)
        for _ in range(now, dim):
            f.write(plane.tobytes())
            plane = np.zeros(dim * dim, dtype)


def read_many(spark: SparkSession, template: str, values: list, names: list[str], delimiter: str = r"\s+") -> DataFrame:
    """The text tables at the template's paths (%d or %s stands for a value), in one scan, with file_name and value."""
    paths = {template % v: str(v) for v in values}
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("_path"))
    parts, bad = _fields("value", delimiter, len(names))
    good = lines.where(~F.col("value").startswith("#") & ~bad).withColumn("_v", parts)
    which = F.lit(None).cast("string")
    for p, v in paths.items():
        which = F.when(F.endswith("_path", F.lit(p.rsplit(":", 1)[-1].lstrip("/"))) | F.contains("_path", F.lit(p.rsplit(":", 1)[-1].lstrip("/") + "/")), v).otherwise(which)
    return good.select(which.alias("value"), F.element_at(F.split("_path", "/"), -1).alias("file_name"), *(_number("_v", i).alias(n) for i, n in enumerate(names)))


# The number of fields of the three files of a galaxy catalogue, and the positions of those that are named.
GALAXIES = {
    "galprop": (39, {"halo_id": 0, "gal_id": 1, "mhalo": 6, "mstar": 9, "mbh": 15, "sfr_ave": 24, "x": 32, "y": 33, "z": 34}),
    "halos": (25, {"halo_id": 0, "halo_id_nbody": 1, "m_vir": 3, "c_NFW": 7, "spin": 9, "mstar": 11, "sfr": 14}),
    "mock": (13, {"halo_id_nbody": 0, "x": 1, "y": 2, "z": 3, "mvir": 7, "m_star": 9, "ssfr": 10, "mhost": 11}),
}


def galaxy_names(kind: str) -> list[str]:
    n, named = GALAXIES[kind]
    at = {i: c for c, i in named.items()}
    return [at.get(i, f"c{i}") for i in range(n)]


def read_galaxies(spark: SparkSession, **paths: str) -> dict[str, DataFrame]:
    """The files of a galaxy catalogue, each as a table with its named fields (others are c0, c1, ...)."""
    return {k: read_text(spark, p, galaxy_names(k)) for k, p in paths.items()}


def tree_file(folder: str, k: int) -> str:
    """The name of the k-th file of a forest: the digits of k to the base 5."""
    return f"{folder}/tree_{k // 25}_{k % 25 // 5}_{k % 5}.dat"


def write_trees(nodes: DataFrame, folder: str, tree: str, order: str, columns: list[str], files: int) -> DataFrame:
    """Forest files, a line `#tree id` and the tree's lines by `order`, and their location table (id, file_no, byte_offset).

    A tree goes to one file, whole; files are written in parallel, one task each, as streams, and are the same on every try.
    """
    rows = nodes.select(F.pmod(F.xxhash64(tree), F.lit(files)).cast("int").alias("file_no"), F.col(tree).cast("long").alias("_tree"), F.col(order).alias("_order"), F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("_line"))
    rows = rows.repartitionById(files, "file_no").sortWithinPartitions("file_no", "_tree", "_order", "_line").select("file_no", "_tree", "_line")

    def run(batches):
        f, last, at = None, None, 0
        for b in batches:  # of one file
            if not len(b):
                continue
            k, t = b.column(0)[0].as_py(), b.column(1).to_numpy(zero_copy_only=False)
            f = f or created(tree_file(folder, k))
            lines, sizes = b.column(2).to_pylist(), pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            starts = np.flatnonzero(np.append(t[0] != last, t[1:] != t[:-1]))
            heads = [f"#tree {x}\n" for x in t[starts]]
            for i, head in zip(starts.tolist(), heads, strict=True):
                lines[i] = head + lines[i]
            above = np.array([len(x) for x in heads], np.int64)
            sizes[starts] += above
            ends = at + np.cumsum(sizes)
            f.write("\n".join([*lines, ""]).encode())
            yield pa.RecordBatch.from_arrays([pa.array(t[starts], pa.int64()), pa.array(np.full(len(starts), k), pa.int32()), pa.array((ends - sizes)[starts] + above)], names=["id", "file_no", "byte_offset"])
            at, last = int(ends[-1]), t[-1]
        if f:
            f.close()

    return written(rows.mapInArrow(run, "id long, file_no int, byte_offset long"))


TREES_A_TASK = 1000
LINES = 20_000  # of trees that are handed on at once


def read_trees(spark: SparkSession, folder: str, locations: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """tree_id and the lines, as named doubles, of the wanted(id) trees only: a task seeks each by the location table and
    reads up to the next line that starts with #. A task has TREES_A_TASK trees that lie one after another, and opens a file once."""
    found = written(locations.join(wanted.select("id").distinct(), "id"))
    found = found.repartitionByRange(max(1, math.ceil(found.count() / TREES_A_TASK)), "file_no", "byte_offset").sortWithinPartitions("file_no", "byte_offset")

    def run(batches):
        import pandas as pd

        def table():
            return pd.DataFrame(np.array([x.split() for x in lines], float).reshape(-1, len(names)), columns=names).assign(tree_id=np.array(of, np.int64))[["tree_id", *names]]

        now, f, lines, of = None, None, [], []
        for b in batches:
            for t, k, at in zip(b["id"].tolist(), b["file_no"].tolist(), b["byte_offset"].tolist(), strict=True):
                if now != k:
                    if f:
                        f.close()
                    now, f = k, io.BufferedReader(opened(tree_file(folder, k)), 1 << 18)
                f.seek(at)
                for line in itertools.takewhile(lambda x: not x.startswith(b"#"), f):
                    lines.append(line)
                    of.append(t)
                    if len(lines) >= LINES:
                        yield table()
                        lines, of = [], []
        if f:
            f.close()
        yield table()

    return found.mapInPandas(run, "tree_id long, " + ", ".join(f"`{n}` double" for n in names))


PROFILE_FIELDS = ["id", "parent_id", "mass", "radius", "vmax", "x", "y", "z", "vx", "vy", "vz", "np", "n_rbins", "ppbin"]


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile text: 14 numbers, then n_rbins radii; lines that start with # or M are headers."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^[#M]") & (F.trim("value") != ""))
    p = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    out = lines.select(*(F.get(p, i).cast("long" if n in ("id", "parent_id", "np", "n_rbins") else "double").alias(n) for i, n in enumerate(PROFILE_FIELDS)), p.alias("_p"))
    return out.select(*PROFILE_FIELDS, F.slice("_p", 15, F.col("n_rbins").cast("int")).alias("radii")).where(F.size("radii") == F.col("n_rbins"))


def write_by(df: DataFrame, path: str, column: str, limit: int | None = None) -> None:
    """One folder per value of column; with a limit, of the least `limit` values only."""
    if limit is not None:
        first = df.select(column).distinct().orderBy(column).limit(limit)
        df = df.join(F.broadcast(first), column, "left_semi") if limit <= 100_000 else df.join(first, column, "left_semi")
    df.write.partitionBy(column).parquet(path)


def number_trees(lines: DataFrame, order: str, scale: str, root_scale: float) -> DataFrame:
    """tree_id of consecutive trees in a file: the running count of root rows, in parallel by range partitions."""
    is_root = F.abs(F.col(scale) - root_scale) < 1e-6
    roots = ranked(lines.where(is_root).select(order), [order], "tree_id").select(F.col(order).alias("_from"), "tree_id")
    # each row's last root: roots and rows in one order, the root's number carried forward within range partitions
    both = lines.join(roots, F.col(order) == F.col("_from"), "left").drop("_from")
    sorted_ = both.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    kept = written(sorted_)
    last = {r["_part"]: r["m"] for r in kept.groupBy("_part").agg(F.max("tree_id").alias("m")).collect()}
    run, start = None, []
    for part in sorted(last):
        start.append((part, run))
        run = last[part] if last[part] is not None else run
    starts = lines.sparkSession.createDataFrame(start, "_part int, _start long")
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.join(F.broadcast(starts), "_part").withColumn("tree_id", F.coalesce(F.max("tree_id").over(w), F.col("_start"))).drop("_part", "_start")
