"""Whole-catalogue operators: merge, stack, reorder, select, derive, and the galaxy join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cosmolith.functions import astro

# The positions that the public halo list takes from an augmented one, in its order.
HLIST = [*range(34), 89, 90, 91, *range(34, 72), 92, *range(72, 79)]


def merge(target: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """target with other's columns by key, one to one; a row without a partner gets nulls."""
    clash = {c: f"{c}_2" for c in other.columns if c in target.columns and c != key}
    return target.join(other.withColumnsRenamed(clash), key, "left")


def zipped(df: DataFrame, others: list[DataFrame], row: str = "row_idx") -> DataFrame:
    """df with the columns of tables that hold a value for each of its rows, by the row's number in the file."""
    for o in others:
        df = merge(df, o, row)
    return df


def not_one_to_one(target: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """The keys that merge() can't pair one to one, with their counts on both sides."""
    a, b = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((target, "n_target"), (other, "n_other")))
    return a.join(b, key, "full").na.fill(0, ["n_target", "n_other"]).where("n_target <> 1 or n_other <> 1")


def unmatched(df: DataFrame, other: DataFrame, key: str, other_key: str, keep: Column | None = None) -> DataFrame:
    rows = df if keep is None else df.where(keep)
    return rows.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def stack(frames: dict[float, DataFrame], scales: dict[str, float]) -> DataFrame:
    """Union of catalogues by name; column c of the one at redshift z is multiplied by (1 + z) ** scales[c]."""
    out = None
    for z, df in frames.items():
        df = df.withColumns({c: F.col(c) * (1 + z) ** p for c, p in scales.items()}).withColumn("z", F.lit(float(z)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def move_last(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in columns), *columns)


def insert_columns(df: DataFrame, columns: dict[str, Column], at: dict[str, int]) -> DataFrame:
    """New columns at the given places, the others of `columns` at the end."""
    names = list(df.columns)
    for c, i in sorted(at.items(), key=lambda x: x[1]):
        names.insert(i, c)
    return df.withColumns(columns).select(*names, *(c for c in columns if c not in at))


def select_epoch(df: DataFrame, a: str, value: float, within: float = 1e-6) -> DataFrame:
    return df.where(F.abs(F.col(a) - value) < within)


def limited(df: DataFrame, ranges: dict[str, tuple[float, float]], central: Column | None = None) -> DataFrame:
    """Inclusive ranges; a negative bound is no bound."""
    for c, (lo, hi) in ranges.items():
        df = df.where(F.col(c) >= lo) if lo >= 0 else df
        df = df.where(F.col(c) <= hi) if hi >= 0 else df
    return df if central is None else df.where(central)


def derived_epochs(df: DataFrame, epoch: str, peak: str, merger: str) -> DataFrame:
    """da and dt (Gyr) between an epoch and the peak, and the epoch and the last major merger."""
    d = lambda x: F.col(epoch) - F.col(x)
    t = lambda x: astro.cosmic_time(epoch) - astro.cosmic_time(x)
    return df.withColumns({"da_peak": d(peak), "dt_peak": t(peak), "da_merger": d(merger), "dt_merger": t(merger)})


def hlist_layout(df: DataFrame) -> DataFrame:
    """The columns of an augmented halo list in the order of the public one, by their positions."""
    c = df.columns
    return df.select(*(c[i] for i in HLIST))


def scale_columns(df: DataFrame, columns: list[str], by: float) -> DataFrame:
    return df.withColumns({c: F.col(c) / by for c in columns})


def central_join(galaxies: DataFrame, halos: DataFrame, mock: DataFrame, gal_halo: str, halo_id: str, halo_body: str, mock_body: str, central: Column, latest: str) -> DataFrame:
    """Central galaxies with the mock row of their halo's body; of several halo rows for an id, the last by `latest`."""
    last = F.row_number().over(Window.partitionBy(halo_id).orderBy(F.desc(latest)))
    one = halos.withColumn("_r", last).where("_r = 1").select(F.col(halo_id).alias(gal_halo), F.col(halo_body).alias(mock_body))
    return galaxies.where(central).join(one, gal_halo).join(mock, mock_body)


def spine_slab(df: DataFrame, index: DataFrame, row: str, z_below: float = 10) -> DataFrame:
    """The (x, y) cells of the rows that an index lists, where z is under z_below."""
    cut = df.join(index.select(row).distinct(), row).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("z").cast("int").alias("z"))
    return cut.where(F.col("z") < z_below).select("x", "y")


def mass_window(df: DataFrame, mass: str, reference: DataFrame, ref_mass: str, id_: str) -> DataFrame:
    """Rows with a mass strictly between the 5 % and 95 % order statistics of a reference, by id; none if that has no mass."""
    import math

    from cosmolith.operators.binning import order_values

    ends = order_values(reference, ref_mass, lambda n: [math.floor(0.05 * n), math.ceil(0.95 * n)])
    lo, hi = ends or (math.inf, -math.inf)
    return df.where((F.col(mass) > lo) & (F.col(mass) < hi)).orderBy(id_)
