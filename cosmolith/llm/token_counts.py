"""Operator 4: token counts by source, language and tokenizer version, as rollups maintained by signed deltas.

A batch of deltas (inserts +1, deletes -1, revised counts as -old and +new) is aggregated before it is stored, so a
batch is a few rows. It commits by the creation of a marker that has its id as name, which happens once: a batch that is
sent again, or by two drivers, changes nothing. Totals are the sum over committed batches; `compact` folds them into a
snapshot that remembers their ids, and `vacuum` deletes what a snapshot has replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolith.llm.common import create_once, delete, file_system, new_path, table, written
from cosmolith.llm.tokens import VOCABULARY, encoder

KEYS = ["source", "lang", "tokenizer_version"]
_STORED = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class Rollup:
    """Totals kept in a folder that all executors and drivers share: data, a marker for each batch, snapshots."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = file_system(spark, self.path)
        for kind in ("data", "commits", "snapshots"):
            self._fs.mkdirs(self._at(f"{self.path}/{kind}"))

    def _names(self, kind: str) -> list[str]:
        names = (x.getPath().getName() for x in self._fs.listStatus(self._at(f"{self.path}/{kind}")))
        return sorted(n for n in names if not n.startswith((".", "_")))

    def _bodies(self, kind: str, names: list[str]) -> list[dict]:
        rows = self.spark.read.option("wholetext", True).text([f"{self.path}/{kind}/{n}" for n in names]).collect() if names else []
        return [json.loads(r[0]) for r in rows]

    def _state(self) -> tuple[dict, list[str]]:
        """The newest snapshot, and the batches committed since; markers are listed first, so none is missed or counted twice."""
        marked = self._names("commits")
        found = self._names("snapshots")
        snapshot = self._bodies("snapshots", found[-1:])[0] if found else {"data": None, "batches": []}
        return snapshot, sorted(set(marked) - set(snapshot["batches"]))

    def committed(self) -> list[str]:
        snapshot, since = self._state()
        return sorted([*snapshot["batches"], *since])

    def _stored(self, rows: DataFrame) -> str:
        """The sums in one file. They are worked out in parallel and written first; only their few rows meet in one task."""
        name = f"data/{uuid.uuid4().hex}"
        sums, at = written(rows, "sums")
        sums.coalesce(1).write.parquet(f"{self.path}/{name}")
        delete(self.spark, at)
        return name

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """deltas: KEYS, sign (+1 or -1), n_tokens. True if this call committed the batch, False if it was there already."""
        if not batch or batch[0] in "._" or any(c in batch for c in "/:= *?[]{}\\"):
            raise ValueError(f"a batch id is a plain name, not {batch!r}")
        if batch in self.committed():
            return False
        data = self._stored(deltas.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens")))
        if create_once(self.spark, f"{self.path}/commits/{batch}", json.dumps({"data": data})):
            return True
        delete(self.spark, f"{self.path}/{data}")
        return False

    def _sums(self, snapshot: dict, since: list[str]) -> DataFrame:
        paths = [f"{self.path}/{x['data']}" for x in [snapshot, *self._bodies("commits", since)] if x["data"]]
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        stored = self.spark.read.schema(_STORED).parquet(*paths)
        return stored.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all committed batches; groups that came to nothing are left out."""
        return self._sums(*self._state())

    def compact(self) -> bool:
        """Folds the batches since the last snapshot into a new one, which remembers all their ids; False if there are none
        or another writer was faster."""
        snapshot, since = self._state()
        if not since:
            return False
        data, number = self._stored(self._sums(snapshot, since)), len(self._names("snapshots"))
        if create_once(self.spark, f"{self.path}/snapshots/{number:010d}.json", json.dumps({"data": data, "batches": sorted([*snapshot["batches"], *since])})):
            return True
        delete(self.spark, f"{self.path}/{data}")
        return False

    def vacuum(self) -> None:
        """Deletes the markers and the data that the newest snapshot has replaced; not while older totals are being read."""
        snapshot, since = self._state()
        old = [n for n in self._names("commits") if n not in since]
        keep = {x["data"] for x in [snapshot, *self._bodies("commits", since)]}
        gone = {x["data"] for x in [*self._bodies("commits", old), *self._bodies("snapshots", self._names("snapshots")[:-1])]} - keep - {None}
        delete(self.spark, *(f"{self.path}/{x}" for x in [*sorted(gone), *(f"commits/{n}" for n in old)]))


def with_counts(docs: DataFrame, keep: list[str], folder: str | None = None) -> DataFrame:
    """`keep` and n_tokens of each whole text; a null text has none."""
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes if n != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder).encode
        for batch in batches:
            at = batch.schema.get_field_index("text")
            n = pa.array([len(encode(x.as_py())) for x in batch.column(at)], pa.int64())
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), n], [*(batch.schema.names[i] for i in rest), "n_tokens"])

    return kept.mapInArrow(run, schema + ", n_tokens long")


def inserts(counted: DataFrame, version: str) -> DataFrame:
    return counted.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(1).alias("sign"), "n_tokens")


def deletes(counted: DataFrame, version: str) -> DataFrame:
    return inserts(counted, version).withColumn("sign", F.lit(-1))


def revisions(counted: DataFrame, old: str, new: str, n_new: Column) -> DataFrame:
    """The old count leaves under the old version, and the new one comes in under the new version."""
    return deletes(counted, old).unionByName(inserts(counted.withColumn("n_tokens", n_new), new))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; then toxic ones are deleted; then those whose language is not English are revised to a
    version that counts the end id too. Each batch is sent twice, as after a lost answer, and folded into a snapshot in
    between. Null sources and languages are groups of their own, a null text has no tokens, documents without an id are in
    no label; repeated rows count each; an empty table gives no groups; other columns are not read."""
    plain, closed = VOCABULARY, f"{VOCABULARY}+end"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted, _ = written(with_counts(docs, ["doc_id", "source", "lang"]), "counts")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone, left = counted.join(toxic, "doc_id", "left_semi"), counted.join(toxic, "doc_id", "left_anti")
    rollup = Rollup(spark, new_path(spark, "rollup"))
    for _ in range(2):
        rollup.commit("insert-1", inserts(counted, plain))
        rollup.commit("delete-1", deletes(gone, plain))
        rollup.commit("revise-1", revisions(left.where("lang <> 'en' or lang is null"), plain, closed, F.col("n_tokens") + 1))
        rollup.compact()
    return rollup.totals()
