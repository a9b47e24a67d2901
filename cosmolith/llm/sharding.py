"""Operator 1: a table kept as immutable shards, compacted by size tiers under a versioned manifest.

Arrivals are appended as they come, a small Parquet shard for each task. Compaction groups the shards of a size tier
(a power of FANOUT times the smallest size) into runs of about the target size, and writes each run as one shard,
without a shuffle. Every change is a new manifest, which lists files of at most PART shards each; a change writes the
files it touches anew and shares the others with the version before. It is committed by the creation of its numbered
file, which can succeed once, so a writer that loses the race starts over from the newer version. Readers see one version
whole. Shards that no kept version lists are removed by vacuum. The driver holds a path and a size for each shard.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cosmolith.llm.common import create_once, file_system, new_path, table

TARGET = 128 << 20
FANOUT = 4
RUNS_A_JOB = 64
PART = 10_000  # shards that a file of a manifest lists


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: str


def tier(size: int, smallest: int, fanout: int = FANOUT) -> int:
    return max(0, math.floor(math.log(max(size, 1) / smallest, fanout) + 1e-9)) if size > smallest else 0


def plan_runs(shards: list[Shard], target: int, fanout: int = FANOUT) -> list[list[Shard]]:
    """Runs of similarly sized shards to merge. A tier's shards go, in the order of their paths, into runs of at most
    the target size; a run under it is merged once it holds `fanout` shards, which lifts it to the next tier."""
    small = [s for s in shards if s.bytes * 2 <= target]
    if not small:
        return []
    least = max(1, target // fanout**4)
    out: list[list[Shard]] = []
    for t in sorted({tier(s.bytes, least, fanout) for s in small}):
        run: list[Shard] = []
        for s in sorted((s for s in small if tier(s.bytes, least, fanout) == t), key=lambda s: s.path):
            if run and sum(x.bytes for x in run) + s.bytes > target:
                out.append(run)
                run = []
            run.append(s)
        if len(run) >= fanout:
            out.append(run)
    return [r for r in out if len(r) > 1]


class ShardStore:
    """A versioned table at a path in the shared storage."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT, part: int = PART) -> None:
        self.spark, self.path, self.target, self.fanout, self.part = spark, path.rstrip("/"), target, fanout, part
        self._jvm = spark._jvm
        self._fs = file_system(spark, self.path)
        self._fs.mkdirs(self._at(f"{self.path}/manifests"))

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        return sorted(int(x.getPath().getName().split(".")[0]) for x in self._fs.listStatus(self._at(f"{self.path}/manifests")) if x.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict]:
        """(version, {schema, parts}); version 0, without a schema, is the table before its first change."""
        found = self.versions()
        if not found:
            return 0, {"schema": None, "parts": []}
        version = found[-1] if version is None else version
        lines = self.spark.read.text(f"{self.path}/manifests/{version:010d}.json").collect()
        return version, json.loads("".join(r[0] for r in lines))

    def _listed(self, parts: list[str]) -> dict[str, list[Shard]]:
        """The shards that each part lists."""
        out: dict[str, list[Shard]] = {p: [] for p in parts}
        if parts:
            rows = self.spark.read.text([f"{self.path}/{p}" for p in parts]).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")
            names = {p.rsplit("/", 1)[-1]: p for p in parts}
            for r in rows.collect():
                out[names[r.name]].append(Shard(**json.loads(r.value)))
        return out

    def shards(self, version: int | None = None) -> list[Shard]:
        return [s for own in self._listed(self.manifest(version)[1]["parts"]).values() for s in own]

    def _commit(self, version: int, schema: str, parts: list[str]) -> bool:
        """The manifest of a version, which only one writer can create."""
        return create_once(self.spark, f"{self.path}/manifests/{version:010d}.json", json.dumps({"schema": schema, "parts": parts}))

    def _write_parts(self, shards: list[Shard]) -> list[str]:
        out = []
        for lo in range(0, len(shards), self.part):
            out.append(f"parts/{uuid.uuid4().hex}.jsonl")
            if not create_once(self.spark, f"{self.path}/{out[-1]}", "\n".join(json.dumps(asdict(s)) for s in shards[lo : lo + self.part])):
                raise RuntimeError("a new name was taken")
        return out

    def _change(self, schema: str, gone: set[str], new: list[Shard]) -> int:
        """A version without the shards `gone` and with `new`; only the parts that list a shard that goes are read."""
        self._fs.mkdirs(self._at(f"{self.path}/parts"))
        added = self._write_parts(new)
        while True:
            version, now = self.manifest()
            parts, missing = now["parts"] + added, set(gone)
            if gone:
                kept, left = [], []
                for part, own in self._listed(now["parts"]).items():
                    hit = {s.path for s in own} & missing
                    missing -= hit
                    left += [s for s in own if s.path not in hit] if hit else []
                    kept += [] if hit else [part]
                if missing:
                    raise RuntimeError("another writer has replaced these shards; plan again")
                parts = kept + self._write_parts(left) + added
            if self._commit(version + 1, now["schema"] or schema, parts):
                return version + 1

    def _files(self, folder: str, arrival: str) -> list[Shard]:
        files = [(x.getPath().getName(), x.getLen()) for x in self._fs.listStatus(self._at(folder))]
        return [Shard(f"{folder.removeprefix(self.path + '/')}/{n}", int(size), arrival) for n, size in sorted(files) if n.startswith("part-")]

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """rows as small shards and a new version of the table. An empty frame adds a version with the same rows."""
        name = arrival or uuid.uuid4().hex
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self._change(rows.schema.json(), set(), self._files(folder, name))

    def append_arrivals(self, rows: DataFrame, arrival: str) -> int:
        """Several arrivals, told apart by the column `arrival`, in one pass over rows; a version for each, or one if there is no row."""
        folder = f"{self.path}/shards/{uuid.uuid4().hex}"
        rows.write.partitionBy(arrival).parquet(folder)
        schema = rows.drop(arrival).schema.json()
        names = sorted(p.getPath().getName() for p in self._fs.listStatus(self._at(folder)) if p.getPath().getName().startswith(f"{arrival}="))
        for x in names:
            version = self._change(schema, set(), self._files(f"{folder}/{x}", x))
        return version if names else self._change(schema, set(), [])

    def _read(self, schema: str, shards: list[Shard]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(f"{self.path}/{s.path}" for s in shards)) if shards else self.spark.createDataFrame([], kind)

    def compact(self) -> int:
        """Merges runs until none is left; returns the version. Each merge reads its shards in one task and writes one."""
        schema = self.manifest()[1]["schema"]
        while runs := plan_runs(self.shards(), self.target, self.fanout):
            for lo in range(0, len(runs), RUNS_A_JOB):
                job = runs[lo : lo + RUNS_A_JOB]
                merged = None
                for run in job:
                    one = self._read(schema, run).coalesce(1)
                    merged = one if merged is None else merged.union(one)
                folder = f"{self.path}/shards/{uuid.uuid4().hex}"
                merged.write.parquet(folder)
                self._change(schema, {s.path for run in job for s in run}, self._files(folder, "merged"))
        return self.manifest()[0]

    def vacuum(self, keep: int = 1) -> None:
        """Forgets all but the newest `keep` versions and removes the shards and parts that none of them lists."""
        versions = self.versions()
        parts = {v: set(self.manifest(v)[1]["parts"]) for v in versions}
        stay = set().union(*(parts[v] for v in versions[-keep:]))
        go = set().union(*(parts[v] for v in versions[:-keep])) - stay
        live = {s.path for own in self._listed(sorted(stay)).values() for s in own}
        dead = {s.path for own in self._listed(sorted(go)).values() for s in own} - live
        for p in [f"manifests/{v:010d}.json" for v in versions[:-keep]] + sorted(go | dead):
            self._fs.delete(self._at(f"{self.path}/{p}"), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows, whatever their columns are called."""
        version, now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was ever appended to the table")
        return self._read(now["schema"], self.shards(version))

    def located(self, version: int | None = None) -> DataFrame:
        """Each row as the struct `row`, with shard (the name of its file) and shard_bytes."""
        rows = self.read(version)
        whole = F.struct(*(rows[f"`{c.replace('`', '``')}`"] for c in rows.columns)).alias("row")
        if rows.isEmpty():
            return rows.select(whole, F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
        file = rows.metadataColumn("_metadata")
        return rows.select(whole, file["file_name"].alias("shard"), file["file_size"].alias("shard_bytes"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four lots, are appended, and compacted. Per document: the shard that holds it, the
    shard's bytes and tier, and the manifest's version. Nulls, empty texts, repeated rows and columns of any name are
    stored as they are; an empty table gives a version without shards and no rows."""
    docs = table(spark, sf_dir, "documents")
    lot = "_arrival"
    while lot in (c.lower() for c in docs.columns):
        lot += "_"
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append_arrivals(docs.withColumn(lot, F.pmod(F.xxhash64("doc_id"), F.lit(4))), lot)
    version = store.compact()
    store.vacuum()
    least = max(1, store.target // store.fanout**4)
    level = F.greatest(F.floor(F.log(float(store.fanout), F.col("shard_bytes") / least) + 1e-9), F.lit(0)).cast("int")
    of = lambda c: F.col("row")[c]
    return store.located().select(of("doc_id").alias("doc_id"), "shard", "shard_bytes", level.alias("tier"), F.lit(version).cast("long").alias("version"), F.xxhash64(of("text"), of("lang"), of("source")).alias("row_hash"))
