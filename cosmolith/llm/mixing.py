"""Operator 9: mixing sources to target weights by subset-sum budget fitting.

Sizes are words. A source gives all its documents as often as its target holds whole times; what is left of the target
is filled from a histogram of its documents by exact size. Every size first gives its share of the budget, rounded down.
The words that the rounding leaves are fitted by a bounded-knapsack dynamic programme over the sizes' spare counts, in
blocks of sizes from the longest down: a block holds sizes of BLOCK words in all, fits its own remainder and hands on
what it cannot reach. Where the budget is missed even so, documents of all sizes are given back, more each time, and what
they leave is fitted anew, until it is met or all that memory allows (LIMIT, in units of the sizes' common divisor) is
open to choice: so a budget up to LIMIT is met as nearly as any choice can. Which documents of a size are taken follows a seeded
hash of id and text, so reruns agree; rows alike in both are told apart by their place. Only histograms meet in one
task: a source of T words has at most sqrt(2 T) sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.llm.common import NO_ID, WORD_GAP, delete, table, written

SEED = 20240
MOST_COPIES = 3
BLOCK = 1 << 16  # words that the sizes of a block have in all
LIMIT = 1 << 24  # of the dynamic programme's state: 2 MB of bits and 64 MB of steps in a task
SLOTS = 4096


def n_words(text: str) -> Column:
    return F.coalesce(F.size(F.filter(F.split(F.col(text), WORD_GAP), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: dict, weights=(1, 2, 3), most: int = MOST_COPIES) -> dict:
    """Words wanted of each source: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words;
    a target stops at `most` times its source's words, and the excess is shared anew by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in order if s in free and left * weight[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            free.discard(s)
        left -= sum(out[s] for s in over)
    return out


def knapsack(sizes: list[int], spare: list[int], left: int) -> list[int]:
    """How many of each size to take (at most spare) for the most words up to left, by bounded knapsack.

    Sizes are divided by their greatest common divisor first. Bit s of `reached` tells that s words can be had, and
    `first[s]` with which of the steps (binary multiples of a size) that was so first: the rest of s was there before it.
    """
    take = [0] * len(sizes)
    by = math.gcd(*(s for s, n in zip(sizes, spare, strict=True) if s and n)) or 1
    left //= by
    reached, mask, steps = 1, (1 << left + 1) - 1, []
    first = np.zeros(left + 1, np.uint32)
    for i in sorted((i for i in range(len(sizes)) if sizes[i] and spare[i]), key=lambda i: -sizes[i]):
        size = sizes[i] // by
        n, m = min(spare[i], left // size), 1
        while n > 0 and not reached >> left & 1:
            m = min(m, n)
            new = reached << m * size & mask & ~reached
            if new:
                steps.append((i, m, size))
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                reached |= new
            n -= m
            m *= 2
    at = reached.bit_length() - 1
    while at:
        i, m, size = steps[first[at] - 1]
        take[i] += m
        at -= m * size
    return take


def _fit_block(sizes: list[int], spare: list[int], left: int) -> list[int]:
    """The share of left of each size, rounded down, and the knapsack of what that leaves, which is less than the sizes' sum."""
    words = lambda take: sum(s * t for s, t in zip(sizes, take, strict=True))
    total = words(spare)
    if left >= total:
        return list(spare)
    take = [n * left // total for n in spare]
    rest = left - words(take)
    if len(sizes) == 1:
        return [take[0] + min(spare[0] - take[0], rest // sizes[0])]
    return [t + m for t, m in zip(take, knapsack(sizes, [n - t for n, t in zip(spare, take, strict=True)], rest), strict=True)]


def fit(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take (at most counts) so that they hold budget words, or as near below it as any
    choice can (beyond LIMIT: as the dynamic programme finds)."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    take, blocks, held = [0] * len(sizes), [], BLOCK
    for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: -sizes[i]):
        if held + sizes[i] > BLOCK:
            blocks.append([])
            held = 0
        blocks[-1].append(i)
        held += sizes[i]
    seen = taken = 0
    for k, block in enumerate(blocks):
        own, n = [sizes[i] for i in block], [counts[i] for i in block]
        seen += sum(s * c for s, c in zip(own, n, strict=True))
        left = (budget * seen // total if k + 1 < len(blocks) else budget) - taken
        got = _fit_block(own, n, left)
        for i, t in zip(block, got, strict=True):
            take[i] = t
        taken += sum(s * t for s, t in zip(own, got, strict=True))
    by = math.gcd(*(s for s, c in zip(sizes, counts, strict=True) if s and c))
    back, held = 1, -1
    while taken < budget // by * by:  # documents are given back, of all sizes from the shortest up, and all that leaves is fitted anew
        given, rest = list(take), budget - taken
        for i in sorted((i for i in range(len(sizes)) if sizes[i] and take[i]), key=lambda i: sizes[i]):
            n = max(0, min(take[i], back, (LIMIT * by - rest) // sizes[i]))
            given[i] -= n
            rest += n * sizes[i]
        if rest == held or rest > LIMIT * by:
            break
        new = [g + m for g, m in zip(given, knapsack(sizes, [c - g for c, g in zip(counts, given, strict=True)], rest), strict=True)]
        if (words := sum(s * t for s, t in zip(sizes, new, strict=True))) > taken:
            take, taken = new, words
        back, held = 2 * back, rest
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's histogram: copies that every document gets, and how many documents of each size get one more."""
    rows = rows.sort_values("size", kind="stable")
    sizes, counts = [int(x) for x in rows["size"]], [int(x) for x in rows["n"]]
    total, want = sum(s * c for s, c in zip(sizes, counts, strict=True)), int(rows["target"].iloc[0] + 0.5)
    whole = min(want // total, MOST_COPIES) if total else 0
    extra = fit(sizes, counts, want - whole * total) if whole < MOST_COPIES else [0] * len(sizes)
    return pd.DataFrame({"_ps": rows["source"], "_pz": rows["size"], "whole": whole, "extra": extra, "_pn": counts})


def _sized(docs: DataFrame, keep: list[str], seed: int, place: Column) -> DataFrame:
    need = [c for c in ("source",) if c not in keep]
    return docs.select(*keep, *need, n_words("text").alias("size"), F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)).alias("_h"), place.alias("_place"))


def _of(left: tuple[str, str], right: tuple[str, str] = ("_ps", "_pz")) -> Column:
    return F.col(left[0]).eqNullSafe(F.col(right[0])) & (F.col(left[1]) == F.col(right[1]))


def _last_places(slim: DataFrame, cells: DataFrame, plan: DataFrame) -> tuple[DataFrame, bool]:
    """(_ls, _lz, _last, _last_place) of each size of which some documents, not all, are taken: the last one in the order of
    hash and place; and whether places are needed, as a choice falls among rows alike in id and text."""
    size, top = ("source", "size"), F.lit(NO_ID)
    before = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("extra") - F.col("_before")
    some = plan.where("extra > 0 and extra < _pn").select("_ps", "_pz", "extra")
    cut = cells.join(some, _of(size)).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = cut.where((room > 0) & (room <= F.col("n"))).select("_ps", "_pz", F.col("slot").alias("_cl"), room.alias("_room"))
    # In the cell where the cut falls, rows with one hash are counted before they meet.
    own = slim.join(cut, _of(size) & (F.col("slot") == F.col("_cl"))).groupBy("_ps", "_pz", "_room", "_h").agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy("_ps", "_pz").orderBy("_h"))
    last = own.withColumn("_run", run).where("_run >= _room and _run - _n < _room")
    last, _ = written(last.select("_ps", "_pz", F.col("_h").alias("_last"), (F.col("_room") - F.col("_run") + F.col("_n")).alias("_take"), "_n"), "last")
    names = [F.col("_ps").alias("_ls"), F.col("_pz").alias("_lz"), "_last"]
    alike = last.where("_take < _n")
    if alike.isEmpty():
        return last.select(*names, top.alias("_last_place")), False
    # A place is a partition and a row in it: rows are counted by partition, and ranked in the one where the cut falls.
    tied, _ = written(slim.join(alike, _of(size) & (F.col("_h") == F.col("_last"))).select("_ps", "_pz", "_last", "_take", "_place", F.shiftright("_place", 33).alias("_part")), "tied")
    parts = tied.groupBy("_ps", "_pz", "_take", "_part").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_run", F.sum("_n").over(Window.partitionBy("_ps", "_pz").orderBy("_part"))).where("_run >= _take and _run - _n < _take")
    parts = parts.select(F.col("_ps").alias("_qs"), F.col("_pz").alias("_qz"), F.col("_part").alias("_qp"), (F.col("_take") - F.col("_run") + F.col("_n")).alias("_at"))
    ranked = tied.join(parts, _of(("_ps", "_pz"), ("_qs", "_qz")) & (F.col("_part") == F.col("_qp")))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_ps", "_pz").orderBy("_place"))).where("_rank = _at")
    return last.where("_take = _n").select(*names, top.alias("_last_place")).union(ranked.select(*names, F.col("_place").alias("_last_place"))), True


def mix(docs: DataFrame, keep: list[str], weights=(1, 2, 3), seed: int = SEED, placed: bool = False) -> DataFrame:
    """docs' columns `keep` (which may hold the text) with size, source_size, target, copies and taken = copies * size.

    A null text has size 0; a null source is a source of its own, the last. Documents without words are never taken.
    Of a size, the documents with the least hash of their id and text get one copy more; of rows alike in both, those
    that come first (placed: docs has their places as `_place`). Clashing columns (size, target ...) among `keep` are
    replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in {"size", "source_size", "target", "copies", "taken"}]
    place = F.col("_place") if placed else F.monotonically_increasing_id()
    width = (1 << 52) // SLOTS
    slot = F.floor(F.col("_h") / F.lit(width)).cast("int").alias("slot")
    light = set(keep) <= {"doc_id", "source"}
    slim, slim_at = written(_sized(docs, keep if light else [], seed, place).withColumn("slot", slot), "sized")
    cells, cells_at = written(slim.groupBy("source", "size", "slot").agg(F.count("*").alias("n")), "cells")
    hist = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = {r.source: int(r.t) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("t")).collect()}
    goal = targets(totals, weights)  # a few numbers for each source, as each has a weight
    wanted = spark.createDataFrame([(s, totals[s], float(goal[s])) for s in totals], "_source string, source_size long, target double")
    # Sources have a weight each, so they are few; beyond Spark's own limit of size the joins with them are no broadcasts.
    plan = hist.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).select("source", "size", "n", "target").groupBy("source").applyInPandas(_plan, "_ps string, _pz long, whole int, extra long, _pn long")
    plan, plan_at = written(plan, "plan")
    last, alike = _last_places(slim, cells, plan)
    if alike and not light and not placed:  # the rows are written with their places, so that these hold for both reads
        whole, _ = written(docs.withColumn("_place", place), "placed")
        delete(spark, slim_at, cells_at, plan_at)
        return mix(whole, keep, weights, seed, True)
    least = F.when(F.col("extra") == F.col("_pn"), NO_ID).otherwise(F.coalesce("_last", F.lit(-1)))
    cuts = plan.join(last, _of(("_ps", "_pz"), ("_ls", "_lz")), "left").select("_ps", "_pz", "whole", least.alias("_last"), F.coalesce("_last_place", F.lit(NO_ID)).alias("_last_place"))
    cuts, _ = written(cuts, "cuts")
    delete(spark, cells_at, plan_at, *([] if light else [slim_at]))
    sized = slim if light else _sized(docs, keep, seed, place)
    out = sized.join(cuts, _of(("source", "size"))).join(wanted, F.col("source").eqNullSafe(F.col("_source")))
    chosen = (F.col("_h") < F.col("_last")) | ((F.col("_h") == F.col("_last")) & (F.col("_place") <= F.col("_last_place")))
    copies = F.when(F.col("size") > 0, F.col("whole") + chosen.cast("int")).otherwise(0)
    return out.select(*keep, "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of docs, whatever their names.

    A null text or one without words is never taken, a null source is one of its own. Of rows alike in id and text the
    first ones are taken; repeated rows count each. Texts may be of any length; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    out = mix(rows, ["_row"]).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
