"""Thresholds and membership: equal counts, quartiles, values, percents and ranges; rows join every bin they lie in."""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmolith.functions.ranks import FEW_ROWS, values_at
from cosmolith.functions.segments import under
from cosmolith.functions.shared import finite, written

INF = float("inf")


def parse_range(text: str) -> tuple[float, float]:
    """lo:hi, where a missing side is infinite."""
    lo, sep, hi = text.partition(":")
    if not sep:
        raise ValueError(f"a range is lo:hi, not {text!r}")
    return float(lo) if lo.strip() else -INF, float(hi) if hi.strip() else INF


def parse_thresholds(text: str) -> tuple[str, list]:
    """N | 3Q | [a,b] | %[a,b] | r[lo:hi,...] | %r[lo:hi,...] as (kind, values)."""
    s = text.replace(" ", "")
    if s == "3Q":
        return "quartiles", []
    if s.isdigit():
        return "count", [int(s)]
    head, _, rest = s.partition("[")
    if not rest.endswith("]") or head not in ("", "%", "r", "%r"):
        raise ValueError(f"not a threshold: {text!r}")
    items = rest[:-1].split(",")
    kind = "percent " * ("%" in head) + ("ranges" if "r" in head else "values")
    return kind, [parse_range(x) for x in items] if "r" in head else [float(x) for x in items]


def order_values(df: DataFrame, x: str, at, few: int = FEW_ROWS) -> list[float]:
    """The finite values of x at the 0-based ranks that at(n) gives, clamped to the table."""
    values = written(df.where(finite(x)).select(F.col(x).cast("double").alias("v")))
    n = values.count()
    if not n:
        return []
    want = [min(max(int(i), 0), n - 1) for i in at(n)]
    ranks = sorted(set(want))
    found = values_at(values, "v", [], {f"v{i}": F.lit(i) for i in ranks}, n, few).first()
    return [found[f"v{i}"] for i in want]


def bin_edges(df: DataFrame, x: str, thresholds: str) -> list[tuple[float, float]]:
    """(lo, hi) of each bin. Percent ranks past the end are clamped; infinite sides of percent ranges become min and max."""
    kind, v = parse_thresholds(thresholds)
    if kind == "ranges":
        return v
    if kind == "count":
        e = order_values(df, x, lambda n: [i * (n // v[0]) for i in range(v[0])] + [n - 1])
    elif kind == "quartiles":
        e = order_values(df, x, lambda n: [0, n // 4, n * 3 // 4, n - 1])
    elif kind == "percent values":
        e = order_values(df, x, lambda n: [0, *(n * p / 100 for p in v), n - 1])
    elif kind == "percent ranges":
        flat = order_values(df, x, lambda n: [y for lo, hi in v for y in (0 if lo == -INF else n * lo / 100, n - 1 if hi == INF else n * hi / 100)])
        return list(zip(flat[::2], flat[1::2], strict=True))
    else:
        ends = order_values(df, x, lambda n: [0, n - 1])
        e = [ends[0], *v, ends[1]] if ends else []
    return list(zip(e[:-1], e[1:], strict=True))


def interval_index(edges: list[tuple[float, float]]) -> tuple[list[float], list[list[int]]]:
    """(ends, nodes) of ranges lo < x <= hi that may overlap: the ends in order cut the axis into elementary intervals, the
    leaves of a binary tree. Each range is entered at the nodes that make it up, two a level at most, so the index grows
    as n log n however ranges overlap; the ranges that hold x are those at its leaf's ancestors. Node 1 is the root."""
    real = [(float(a), float(b), i) for i, (a, b) in enumerate(edges) if a < b]
    ends = sorted({v for a, b, _ in real for v in (a, b)})
    leaves = 1 << len(ends).bit_length()  # more than there are elementary intervals, len(ends) + 1
    nodes: list[list[int]] = [[] for _ in range(2 * leaves)]
    for a, b, i in real:
        lo, hi = leaves + bisect.bisect_left(ends, a) + 1, leaves + bisect.bisect_left(ends, b) + 1  # leaf k holds ends[k - 1] < x <= ends[k]
        while lo < hi:
            if lo & 1:
                nodes[lo].append(i)
                lo += 1
            if hi & 1:
                hi -= 1
                nodes[hi].append(i)
            lo, hi = lo >> 1, hi >> 1
    return ends, nodes


def _constant(value, kind: str) -> Column:
    """A nested list as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


LISTED = 1 << 16  # bins of all elementary intervals together, up to which each interval has a list of its bins


def _intervals(x: str, edges: list[tuple[float, float]]) -> tuple[Column, Callable[[Column], Column]] | None:
    """(the elementary interval of x, the bins that hold an interval), or None where no bin can hold anything.

    The interval is found in a grid of equal cells and among the few ends in its cell. Its bins are listed; if these lists
    were too long, as with thousands of wide ranges, they are what its ancestors in interval_index() hold.
    """
    ends, nodes = interval_index(edges)
    if not ends:
        return None
    levels, leaves = (len(nodes) // 2).bit_length(), len(nodes) // 2
    # The axis in equal cells: a row's cell tells between which ends it lies, but for the few in that cell.
    real = [e for e in ends if math.isfinite(e)] or [0.0]
    cells, first = min(1 << 16, 4 * len(ends)), real[0]
    scale = cells / ((real[-1] - first) or 1.0)
    if not math.isfinite(scale):
        scale = 0.0
    at = [0 if e == -INF else cells - 1 if e == INF else min(max(math.floor((e - first) * scale), 0), cells - 1) for e in ends]
    starts = [bisect.bisect_left(at, c) for c in range(cells + 1)]
    v = F.col(x).cast("double")
    cell = F.greatest(F.least(F.floor((v - first) * scale), F.lit(cells - 1)), F.lit(0)).cast("int")
    known, values = _constant(starts, "array<int>"), _constant(ends, "array<double>")
    lo, hi, most = F.get(known, cell), F.get(known, cell + 1), max(b - a for a, b in zip(starts, starts[1:]))
    if most <= 4:  # compared one by one, which is compiled; a bisection is not
        leaf = lo
        for j in range(most):
            leaf = leaf + F.when((lo + j < hi) & (F.get(values, lo + j) < v), 1).otherwise(0)
    else:
        leaf = under(values, v, most, (lo, hi))
    spans = [(bisect.bisect_left(ends, float(p)) + 1, bisect.bisect_left(ends, float(q)) + 1, i) for i, (p, q) in enumerate(edges) if p < q]
    if sum(q - p for p, q, _ in spans) <= LISTED:
        lists: list[list[int]] = [[] for _ in range(len(ends) + 1)]
        for p, q, i in spans:
            for k in range(p, q):
                lists[k].append(i)
        return leaf, lambda k: F.get(_constant(lists, "array<array<int>>"), k)
    above = lambda k: F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda n: F.call_function("shiftright", k + leaves, n))
    return leaf, lambda k: F.flatten(F.transform(above(k), lambda n: F.get(_constant(nodes, "array<array<int>>"), n)))


def _numbers(df: DataFrame, x: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))


def assign_bins(df: DataFrame, x: str, edges: list[tuple[float, float]]) -> DataFrame:
    """df with bin_id, lo, hi: a row joins every bin with lo < x <= hi, so the global minimum lies in none.

    No join: a row's elementary interval is looked up, and the bins that hold it are put out. So thousands of overlapping bins
    cost a row a few steps and no other row.
    """
    found = _intervals(x, edges)
    if not found:
        return df.withColumns({"bin_id": F.lit(0), "lo": F.lit(0.0), "hi": F.lit(0.0)}).where("false")
    leaf, held = found
    rows = _numbers(df, x).withColumn("bin_id", F.explode(held(leaf)))
    side = lambda k: F.get(_constant([float(e[k]) for e in edges], "array<double>"), F.col("bin_id"))
    return rows.withColumns({"lo": side(0), "hi": side(1)})


def bin_counts(df: DataFrame, x: str, edges: list[tuple[float, float]]) -> DataFrame:
    """bin_id, n, x_min and x_max of the rows that assign_bins() gives each bin that has any. Rows are summed up by elementary
    interval before these go to their bins, so a row is counted once, however many bins it lies in."""
    found = _intervals(x, edges)
    if not found:
        return df.select(F.lit(0).alias("bin_id"), F.lit(0).cast("long").alias("n"), F.col(x).alias("x_min"), F.col(x).alias("x_max")).where("false")
    leaf, held = found
    own = _numbers(df, x).groupBy(leaf.alias("_leaf")).agg(F.count("*").alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    return own.withColumn("bin_id", F.explode(held(F.col("_leaf")))).groupBy("bin_id").agg(F.sum("n").alias("n"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"))


def bucket(df: DataFrame, x: str, n_bins: int, lo: float, hi: float, name: str = "bin_id") -> DataFrame:
    """Equal-width bins over [lo, hi]; the last holds its upper edge. Rows that aren't finite are left out."""
    width = (hi - lo) / n_bins or 1.0
    return df.where(finite(x)).withColumn(name, F.least(F.floor((F.col(x) - F.lit(lo)) / F.lit(width)), F.lit(n_bins - 1)).cast("int"))


def span(df: DataFrame, x: str) -> tuple[float, float]:
    r = df.where(finite(x)).agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    return (0.0, 0.0) if r[0] is None else (r[0], r[1])
