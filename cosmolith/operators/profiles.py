"""Radial profiles: spline, stacking, and bounded fits of one to three parameters. A profile is a row with arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORCE_RESOLUTION = 1.0


def natural_spline(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, c, d) of each segment: y = a + b t + c t**2 + d t**3 with t = X - x_i; second derivatives are 0 at the ends."""
    n, h = len(x), np.diff(x)
    m = np.zeros(n)
    if n > 2:
        diag, rhs = 2 * (h[:-1] + h[1:]), 6 * np.diff(np.diff(y) / h)
        up, right = np.zeros(n - 2), np.zeros(n - 2)
        for i in range(n - 2):
            low = h[i] if i else 0.0
            p = diag[i] - low * (up[i - 1] if i else 0.0)
            up[i], right[i] = h[i + 1] / p, (rhs[i] - low * (right[i - 1] if i else 0.0)) / p
        for i in range(n - 3, -1, -1):
            m[i + 1] = right[i] - up[i] * m[i + 2]
    return y[:-1], np.diff(y) / h - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)


def spline_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b, c, d = natural_spline(x, y)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t = at - x[i]
    return a[i] + t * (b[i] + t * (c[i] + t * d[i]))


def enclosed(r: np.ndarray, rs: float | np.ndarray, outer: float | np.ndarray = 2.0) -> np.ndarray:
    """Shape of the mass within r for a density (r / rs)**-1 (1 + r / rs)**-outer; 2 is the Navarro-Frenk-White profile.

    The whole mass is c0 rs**3 times this. The integral is closed, with limits of its own at outer = 1 and 2.
    """
    x, outer = r / rs, np.asarray(outer, float)
    one, two = np.abs(outer - 1) < 1e-6, np.abs(outer - 2) < 1e-6
    if two.all():
        return np.log1p(x) - x / (1 + x)
    with np.errstate(all="ignore"):
        out = (1 - (1 + x) ** (1 - outer) * (1 + (outer - 1) * x)) / ((outer - 1) * (outer - 2))
    if one.any() or two.any():
        out = np.where(two, np.log1p(x) - x / (1 + x), np.where(one, x - np.log1p(x), out))
    return out


# Optimisers work on many profiles at once: a row of parameters each, with a state of its own, so a fit does not depend on
# which others it is made with. Rows that have ended leave the rounds.

Residuals = Callable[[np.ndarray, np.ndarray], np.ndarray]  # numbers of profiles and their parameters -> a row of residuals each
Found = tuple[np.ndarray, np.ndarray]  # parameters and cost of each


def _cost(v: np.ndarray) -> np.ndarray:
    c = (v * v).sum(axis=1)
    return np.where(np.isfinite(c), c, np.inf)


def _jacobian(f: Residuals, rows: np.ndarray, p: np.ndarray, v: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Forward differences from the residuals v at p, backward at an upper bound."""
    columns = []
    for k in range(p.shape[1]):
        h = 1e-6 * np.maximum(np.abs(p[:, k]), 1e-3)
        h = np.where(p[:, k] + h <= hi[rows, k], h, -h)
        q = p.copy()
        q[:, k] += h
        columns.append((f(rows, q) - v) / h[:, None])
    return np.stack(columns, axis=2)


def descend(f: Residuals, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 400) -> Found:
    """Bounded descent, each parameter with a rate of its own that doubles after a gain and falls to a fifth after a loss."""
    p, rows = np.array(start, float), np.arange(len(start))
    step, best, still = np.abs(p) * 0.1 + 1e-3, _cost(f(rows, p)), np.zeros(len(p), int)
    for _ in range(rounds):
        if not len(rows):
            break
        before = best[rows]
        for k in range(p.shape[1]):
            left = rows
            for sign in (1, -1):
                q = p[left]
                q[:, k] = np.clip(q[:, k] + sign * step[left, k], lo[left, k], hi[left, k])
                value = _cost(f(left, q))
                better = value < best[left]
                won = left[better]
                p[won], best[won] = q[better], value[better]
                step[won, k] *= 2
                left = left[~better]
                if not len(left):
                    break
            step[left, k] /= 5
        still[rows] = np.where(before - best[rows] <= 1e-9 * np.maximum(np.abs(best[rows]), 1e-300), still[rows] + 1, 0)
        rows = rows[still[rows] < 5]
    return p, best


def levenberg_marquardt(f: Residuals, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 200) -> Found:
    """Damped least squares; the damping falls after a gain and rises after a loss."""
    p, rows = np.array(start, float), np.arange(len(start))
    damping, best, eps = np.full(len(p), 1e-3), _cost(f(rows, p)), np.finfo(float).eps * p.shape[1]
    for _ in range(rounds):
        v = f(rows, p[rows])
        j = _jacobian(f, rows, p[rows], v, hi)
        g, h = np.einsum("nbk,nb->nk", j, v), np.einsum("nbk,nbl->nkl", j, j)
        ok = np.isfinite(g).all(axis=1) & np.isfinite(h).all(axis=(1, 2))
        rows, g, h = rows[ok], g[ok], h[ok]
        eye, going, left = np.eye(p.shape[1]), np.zeros(len(p), bool), np.arange(len(rows))
        while len(left):
            at = rows[left]
            held = h[left] + damping[at, None, None] * eye * (np.einsum("nkk->nk", h[left]) + 1e-12)[:, None, :]
            q = np.clip(p[at] - np.einsum("nkl,nl->nk", np.linalg.pinv(held, rcond=eps), g[left]), lo[at], hi[at])
            value = _cost(f(at, q))
            better = value < best[at]
            won = at[better]
            going[won] = best[won] - value[better] > 1e-12 * np.maximum(value[better], 1e-300)
            p[won], best[won], damping[won] = q[better], value[better], np.maximum(damping[won] / 9, 1e-12)
            lost = at[~better]
            damping[lost] *= 4
            left = left[~better][damping[lost] < 1e12]
        rows = rows[going[rows]]
        if not len(rows):
            break
    return p, best


def adadelta(f: Residuals, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 4000, decay: float = 0.95) -> Found:
    """Gradient steps scaled by running means of squared gradients and steps (Zeiler, 2012), in units of the start."""
    p, rows = np.array(start, float), np.arange(len(start))
    unit, v = np.abs(p) + 1e-3, f(rows, p)
    seen, moved, best, found = np.zeros(p.shape), np.full(p.shape, 1e-6), _cost(v), p.copy()
    for _ in range(rounds):
        g = 2 * np.einsum("nbk,nb->nk", _jacobian(f, rows, p, v, hi), v) * unit
        on = np.isfinite(g).all(axis=1)
        if not on.all():
            rows, p, g, unit, seen, moved = (a[on] for a in (rows, p, g, unit, seen, moved))
        seen = decay * seen + (1 - decay) * g * g
        d = -np.sqrt((moved + 1e-8) / (seen + 1e-8)) * g
        moved = decay * moved + (1 - decay) * d * d
        p = np.clip(p + d * unit, lo[rows], hi[rows])
        v = f(rows, p)
        value = _cost(v)
        better = value < best[rows]
        best[rows[better]], found[rows[better]] = value[better], p[better]
        on = np.abs(d).max(axis=1) >= 1e-9
        if not on.all():
            rows, p, v, unit, seen, moved = (a[on] for a in (rows, p, v, unit, seen, moved))
        if not len(rows):
            break
    return found, best


def newton(f: Residuals, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = 100) -> Found:
    """Gauss-Newton steps, halved until they gain."""
    p, rows = np.array(start, float), np.arange(len(start))
    best = _cost(f(rows, p))
    for _ in range(rounds):
        v = f(rows, p[rows])
        j = _jacobian(f, rows, p[rows], v, hi)
        ok = np.isfinite(j).all(axis=(1, 2)) & np.isfinite(v).all(axis=1)
        rows, j, v = rows[ok], j[ok], v[ok]
        if not len(rows):
            break
        d = np.einsum("nkb,nb->nk", np.linalg.pinv(j, rcond=np.finfo(float).eps * max(j.shape[1:])), v)
        going, left = np.zeros(len(p), bool), np.arange(len(rows))
        for k in range(30):
            at = rows[left]
            q = np.clip(p[at] - d[left] * 0.5**k, lo[at], hi[at])
            value = _cost(f(at, q))
            better = value < best[at]
            won = at[better]
            going[won] = best[won] - value[better] > 1e-12 * np.maximum(value[better], 1e-300)
            p[won], best[won] = q[better], value[better]
            left = left[~better]
            if not len(left):
                break
        rows = rows[going[rows]]
        if not len(rows):
            break
    return p, best


def combined(f: Residuals, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Found:
    """A short descent, then Newton steps from where it ends, then a short run of adadelta."""
    p, _ = newton(f, descend(f, start, lo, hi, rounds=40)[0], lo, hi)
    return adadelta(f, p, lo, hi, rounds=100)


OPTIMISERS = {"descent": descend, "levenberg-marquardt": levenberg_marquardt, "adadelta": adadelta, "newton": newton, "combined": combined}

_FIT = "rs1 double, chi2_1 double, gof_1 double, rs2 double, c02 double, chi2_2 double, gof_2 double, rs3 double, c03 double, gamma3 double, chi2_3 double, gof_3 double, concentration double, nb_rvir int"


def _shells(radius: float, r: np.ndarray, m: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """Bins within the radius, and outer and inner radius and mass of each shell that is fitted; None for under 4 bins."""
    inside = r <= radius
    nb = int(inside.sum())
    if nb < 4:
        return None
    r, m = r[inside], m[inside]
    shell, prior = np.diff(m, prepend=0.0), np.concatenate(([0.0], r[:-1]))
    use = (shell > 0) & (r > 0)
    return (nb, r[use], prior[use], shell[use]) if use.sum() >= 3 else None


def _fit_alike(radius: np.ndarray, nb: np.ndarray, r: np.ndarray, prior: np.ndarray, shell: np.ndarray, resolution: float, optimiser: str) -> np.ndarray:
    """The fits of profiles that have equally many shells: a row of radii and masses each."""
    w, minimise = np.where(r < 3 * resolution, 0.1, 1.0), OPTIMISERS[optimiser]
    lo, hi = np.stack([radius * 1e-4, np.zeros(len(radius))], 1), np.stack([radius, np.full(len(radius), 100.0)], 1)

    def ratio(i: np.ndarray, p: np.ndarray) -> np.ndarray:
        rs, outer = p[:, :1], p[:, 1:] if p.shape[1] > 1 else 2.0
        return (enclosed(r[i], rs, outer) - enclosed(prior[i], rs, outer)) / shell[i]

    def given(i: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = ratio(i, p)
        return w[i] * (x * (shell[i].sum(axis=1) / (x * shell[i]).sum(axis=1))[:, None] - 1)

    def best(i: np.ndarray, x: np.ndarray) -> np.ndarray:
        w2 = w[i] * w[i]
        a = (w2 * x).sum(axis=1) / (w2 * x * x).sum(axis=1)
        return np.where(a > 0, a, 0.0)

    def free(i: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = ratio(i, p)
        return w[i] * (x * best(i, x)[:, None] - 1)

    with np.errstate(all="ignore"):
        every = np.arange(len(radius))
        p1, c1 = minimise(given, radius[:, None] / 12, lo[:, :1], hi[:, :1])
        p2, c2 = minimise(free, p1, lo[:, :1], hi[:, :1])
        p3, c3 = minimise(free, np.column_stack([p2, np.full(len(p2), 2.0)]), lo, hi)
        rs1, rs2, rs3, g3 = p1[:, 0], p2[:, 0], p3[:, 0], p3[:, 1]
        a2, a3 = best(every, ratio(every, p2)) / rs2**3, best(every, ratio(every, p3)) / rs3**3
        gof = lambda c, k: np.where(nb > k, c / (nb - k), np.nan)
        return np.column_stack([rs1, c1, gof(c1, 1), rs2, a2, c2, gof(c2, 2), rs3, a3, g3, c3, gof(c3, 3), radius / rs2, nb])


TOGETHER = 1000  # profiles that are fitted at once


def fit_many(profiles: list[tuple[float, np.ndarray, np.ndarray]], resolution: float = FORCE_RESOLUTION, optimiser: str = "descent") -> list[tuple | None]:
    """fit_profile() of each (radius, radii, masses), those with equally many shells together."""
    shells = [_shells(*p) for p in profiles]
    out: list[tuple | None] = [None] * len(profiles)
    alike: dict[int, list[int]] = {}
    for i, s in enumerate(shells):
        if s is not None:
            alike.setdefault(len(s[1]), []).append(i)
    for every in alike.values():
        for at in range(0, len(every), TOGETHER):
            which = every[at : at + TOGETHER]
            nb, r, prior, shell = (np.array([shells[i][k] for i in which]) for k in range(4))
            fits = _fit_alike(np.array([profiles[i][0] for i in which], float), nb, r, prior, shell, resolution, optimiser)
            for i, f in zip(which, fits, strict=True):
                out[i] = (*(float(x) for x in f[:-1]), int(f[-1]))
    return out


def fit_profile(radius: float, r: np.ndarray, m: np.ndarray, resolution: float = FORCE_RESOLUTION, optimiser: str = "descent") -> tuple | None:
    """Three fits in turn, each started from the one before; None for under 4 bins within the radius.

    What is fitted is the mass of each shell over the observed one, less 1, with a weight of 0.1 under three resolutions.
    The first fit takes its amplitude from the whole mass. Those of the others are linear, so the best one for a shape is
    known, and only the scale radius (up to the radius) and the outer slope (0 to 100) are searched.
    """
    return fit_many([(radius, r, m)], resolution, optimiser)[0]


def fit_profiles(profiles: DataFrame, resolution: float = FORCE_RESOLUTION, least_particles: int = 100, optimiser: str = "descent") -> DataFrame:
    """profiles(id, mass, radius, np, radii, masses) with the fits' columns; small ones are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _FIT.split(", ")]
        for rows in batches:
            fits = fit_many([(x.radius, np.asarray(x.radii, float), np.asarray(x.masses, float)) for x in rows.itertuples()], resolution, optimiser)
            ok = [f is not None for f in fits]
            out = rows.loc[ok, ["id", "mass", "radius"]].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame([f for f in fits if f is not None], columns=names)], axis=1)

    # Fits cost far more than their bytes tell, so they are dealt to a fixed number of tasks that isn't coalesced: some for
    # each core, no more, as many profiles that are fitted together cost little more than a few.
    spark = profiles.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))
    return profiles.where(F.col("np") >= least_particles).select("id", "mass", "radius", "radii", "masses").repartition(n, "id").mapInPandas(run, f"id long, mass double, radius double, {_FIT}")


def resample(profiles: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Per profile and logarithmic bin: id, bin_id, r, density from the spline of the enclosed mass, within its own radii."""
    edges = np.geomspace(lo, hi, bins + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for x in rows.itertuples():
                r, m = np.asarray(x.radii, float), np.asarray(x.masses, float)
                if len(r) < 2:
                    continue
                use = np.flatnonzero((edges[:-1] >= r[0]) & (edges[1:] <= r[-1]))
                if len(use):
                    a, b = spline_at(r, m, edges[use]), spline_at(r, m, edges[use + 1])
                    rho = (b - a) / (4 * np.pi / 3 * (edges[use + 1] ** 3 - edges[use] ** 3))
                    out.append(pd.DataFrame({"id": x.id, "bin_id": use.astype(np.int32), "r": np.sqrt(edges[use] * edges[use + 1]), "density": rho}))
            yield pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "bin_id": pd.Series(dtype="int32"), "r": pd.Series(dtype=float), "density": pd.Series(dtype=float)})

    return profiles.select("id", "radii", "masses").mapInPandas(run, "id long, bin_id int, r double, density double")


def lookup(objects: DataFrame, profiles: DataFrame) -> DataFrame:
    """objects(id, ...) with the columns of their profiles, null for an object that has none."""
    return objects.join(profiles, "id", "left")


def stack_profiles(profiles: DataFrame, wanted: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """Median, 20-80 % and confidence interval of the density in each bin over the wanted(id) profiles."""
    from cosmolith.operators.aggregates import order_stats

    return order_stats(resample(profiles.join(wanted.select("id").distinct(), "id"), bins, lo, hi), ["bin_id"], "density", mad=False)
