"""Exact order statistics without an exchange of the values: a sketch brackets each wanted rank, one pass counts the rest.

A quantile sketch with a bounded rank error gives, for each group and wanted rank, two values between which the value of
that rank must lie. In a second pass all values between two brackets count as one, at the upper end of the lower bracket; only
the values within brackets, a few thousandths of all, and one sum for each gap leave the tasks. What is then found is
checked: a rank that fell into a gap, which the sketch's bound rules out, would be looked for among all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions.segments import small
from cosmolith.functions.shared import at_rank, counted, same_keys, written

GRID = 500  # steps of the sketch; a bracket spans four of them
FEW_ROWS = 1 << 21  # of a table, counted, that is sorted without a sketch: a task could hold them all
ACCURACY = 10_000  # the sketch's rank error is at most a row in so many


def values_at(df: DataFrame, y: str, by: list[str], ranks: dict[str, Column], rows: int, few: int = FEW_ROWS) -> DataFrame:
    """by, n (the group's rows) and the value of y at each 0-based rank, a column of `ranks` in terms of the column n.

    df is a written table of `rows` rows whose y are finite doubles; ranks lie within the group. Up to `few` rows, whatever
    their groups, are sorted as they are: a sketch would cost more than it saves.
    """
    if rows <= few:
        placed = df.select(*by, y, (F.row_number().over(Window.partitionBy(*by).orderBy(y)) - 1).alias("_i"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
        return placed.groupBy(*by, "n").agg(*(F.max(F.when(F.col("_i") == r.cast("long"), F.col(y))).alias(k) for k, r in ranks.items()))
    at = ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))
    sketch = df.groupBy(*by).agg(F.count("*").alias("n"), F.expr(f"percentile_approx(`{y}`, array({at}), {ACCURACY})").alias("_q")).where("n > 0")
    wanted = {k: r.cast("long").alias(f"_r{i}") for i, (k, r) in enumerate(ranks.items())}
    places = range(len(wanted))
    step = lambda i: F.floor(F.col(f"_r{i}") * F.lit(float(GRID)) / F.col("n"))
    low = lambda i: F.when(step(i) >= 2, F.get("_q", (step(i) - 2).cast("int"))).otherwise(F.lit(float("-inf")))
    high = lambda i: F.when(step(i) <= GRID - 3, F.get("_q", (step(i) + 3).cast("int"))).otherwise(F.lit(float("inf")))
    sketch = sketch.select(*by, "n", "_q", *wanted.values())
    ranked = [f"_r{i}" for i in places]
    brackets = written(sketch.select(*by, "n", *ranked, *(low(i).alias(f"_lo{i}") for i in places), *(high(i).alias(f"_hi{i}") for i in places)))
    rows = same_keys(df, small(brackets), by, "inner")
    inside, below = F.lit(False), F.lit(float("-inf"))
    for i in places:
        inside = inside | F.col(y).between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        below = F.greatest(below, F.when(F.col(y) > F.col(f"_hi{i}"), F.col(f"_hi{i}")).otherwise(F.lit(float("-inf"))))
    value = F.struct(F.when(inside, F.col(y)).otherwise(below).alias("v"), (~inside).alias("gap"))
    counts = counted(rows.select(*by, value.alias("_v")), "_v", by)
    pick = [at_rank("_v", F.col(f"_r{i}")).alias(f"_v{i}") for i in places]
    found = written(same_keys(counts, small(brackets.drop("n")), by, "inner").groupBy(*by).agg(*pick))
    lost = F.lit(False)
    for i in places:
        lost = lost | F.col(f"_v{i}").isNull() | F.col(f"_v{i}.gap")
    if not found.where(lost).isEmpty():
        plain = same_keys(counted(df.select(*by, y), y, by), small(brackets.drop("n")), by, "inner")
        found = plain.groupBy(*by).agg(*(F.struct(at_rank(y, F.col(f"_r{i}")).alias("v")).alias(f"_v{i}") for i in places))
    return same_keys(brackets.select(*by, F.col("n")), found, by).select(*by, "n", *(F.col(f"_v{i}.v").alias(k) for i, k in enumerate(ranks)))
