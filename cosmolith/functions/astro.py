"""Closed forms of the catalogue domain, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
OMEGA_M, OMEGA_L, HUBBLE = 0.307, 0.693, 0.678
AGE_GYR, AGE_RATIO = 11.5570, 1.50244
HUBBLE_GYR = 0.06934
STELLAR_ALPHA, STELLAR_DELTA, STELLAR_GAMMA = -1.84754, 3.85767, 0.44557
STELLAR_EPS, STELLAR_M1 = -1.959715, 11.483698


def _c(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def safe_log10(x) -> Column:
    """log10, null where it isn't defined."""
    return F.when(_c(x) > 0, F.log10(_c(x)))


def redshift(a) -> Column:
    return 1.0 / _c(a) - 1.0


def cosmic_time(a) -> Column:
    """Gyr since the start at scale factor a."""
    return AGE_GYR * F.asinh(AGE_RATIO * F.pow(_c(a), F.lit(1.5)))


def dynamical_time(a) -> Column:
    """Gyr: (3 d H**2 / 8 pi)**-0.5, with d the virial overdensity of Bryan and Norman (1998) over the matter share."""
    y = OMEGA_M * F.pow(_c(a), F.lit(-3.0))
    share = y / (y + OMEGA_L)
    x = share - 1.0
    over = (18 * math.pi**2 + 82.0 * x - 39.0 * x * x) / share
    return F.pow(over * 3.0 * HUBBLE_GYR**2 * (y + OMEGA_L) / (8 * math.pi), F.lit(-0.5))


def stellar_mass(halo) -> Column:
    """Mass of the galaxy that a halo hosts (Behroozi et al., 2013, equation 3); a value under 100 is taken for a log10."""
    mean = F.when(_c(halo) < 100, _c(halo)).otherwise(safe_log10(halo))

    def f(x: Column) -> Column:
        rise = STELLAR_DELTA * F.pow(F.log10(1.0 + F.exp(x)), F.lit(STELLAR_GAMMA)) / (1.0 + F.exp(F.pow(F.lit(10.0), -x)))
        return rise - F.log10(F.pow(F.lit(10.0), STELLAR_ALPHA * x) + 1.0)

    return F.pow(F.lit(10.0), STELLAR_EPS + STELLAR_M1 + f(mean - STELLAR_M1) - f(F.lit(0.0))) / HUBBLE


def concentration(radius, scale) -> Column:
    return F.try_divide(_c(radius), _c(scale))


def elongation(b, c) -> Column:
    return 1.0 - F.sqrt(_c(b) * _c(b) + _c(c) * _c(c)) / math.sqrt(2)


def alignment(x: list[str], y: list[str]) -> Column:
    """Absolute cosine between two vectors; null where one is zero."""
    dot = sum((_c(a) * _c(b) for a, b in zip(x, y, strict=True)), F.lit(0.0))
    length = lambda v: F.sqrt(sum((_c(a) * _c(a) for a in v), F.lit(0.0)))
    return F.abs(F.try_divide(dot, length(x) * length(y)))


def rotation(x, y, z) -> tuple[Column, Column]:
    """(about x, about z) in degrees: the polar angle, where what is over 90 counts back as 90 - angle, and the angle of
    the line y / x. A zero vector has none, so both are 0."""
    r = F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))
    tilt = F.degrees(F.acos(F.try_divide(_c(z), r)))
    line = F.when(_c(x) == 0, 90.0 * F.signum(_c(y))).otherwise(F.degrees(F.atan(F.try_divide(_c(y), _c(x)))))
    return F.when(r == 0, 0.0).otherwise(F.when(tilt > 90, 90.0 - tilt).otherwise(tilt)), F.when(r == 0, 0.0).otherwise(line)


def physical(r, a) -> Column:
    return _c(r) * _c(a)


def nfw_mass(r, rs, amplitude=1.0) -> Column:
    """Mass within r of a Navarro-Frenk-White profile."""
    a = F.lit(amplitude) if isinstance(amplitude, float) else _c(amplitude)
    return a * F.pow(_c(rs), F.lit(3.0)) * (F.log((_c(rs) + _c(r)) / _c(rs)) - _c(r) / (_c(rs) + _c(r)))


def profile_mass(r, rs, outer, amplitude=1.0) -> Column:
    """Mass within r for a density (r / rs)**-1 (1 + r / rs)**-outer, with limits of its own at outer = 1 and 2."""
    a = F.lit(amplitude) if isinstance(amplitude, float) else _c(amplitude)
    x, g = _c(r) / _c(rs), _c(outer)
    near = lambda v: F.abs(g - v) < 1e-6
    other = (1 - F.pow(1 + x, 1 - g) * (1 + (g - 1) * x)) / ((g - 1) * (g - 2))
    return a * F.pow(_c(rs), F.lit(3.0)) * F.when(near(1.0), x - F.log1p(x)).when(near(2.0), F.log1p(x) - x / (1 + x)).otherwise(F.when(~near(1.0) & ~near(2.0), other))


def accretion_ratios(instant, dynamical, mass) -> tuple[Column, Column]:
    """Accretion rates over the mass, at once and over a dynamical time."""
    return F.try_divide(_c(instant), _c(mass)), F.try_divide(_c(dynamical), _c(mass))


def formation_epoch(c) -> Column:
    """The scale factor at which a halo of concentration c formed (Wechsler et al., 2002)."""
    return F.try_divide(F.lit(4.1), _c(c))


def scale_radius_jiang(rvir, rs) -> Column:
    """log10(rs ((rvir / rs) / 7) ** 0.4), as a column of its own."""
    return safe_log10(_c(rs) * F.pow(_c(rvir) / _c(rs) / 7.0, F.lit(0.4)))


RETRIES = 64  # points drawn for a variate at most; a chance of 1e-43 finds none within the circle


def normal(*key, seed: int = 0, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A normal variate that depends on the key columns and the seed alone: the same in any partition and on any retry.

    The polar rule on points of the square whose coordinates are 52 bits each of a hash of key, seed and the number of
    the try; the first point within the unit circle counts. Rows alike in key have the same variate.
    """
    name = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key))

    def unit(h: Column, at: int) -> Column:
        return F.conv(F.substring(h, at, 13), 16, 10).cast("double") * F.lit(2.0**-51) - 1

    def step(acc: Column, i: Column) -> Column:
        h = F.transform(F.array(F.md5(F.concat_ws("|", name, i.cast("string")).cast("binary"))), lambda h: F.struct(unit(h, 1).alias("x"), unit(h, 14).alias("y")))
        drawn = F.get(F.transform(h, lambda p: F.struct(p["x"].alias("x"), (p["x"] * p["x"] + p["y"] * p["y"]).alias("w"))), 0)
        return F.when((acc["w"] > 0) & (acc["w"] < 1), acc).otherwise(drawn)  # nothing is drawn once a point has been found

    start = F.struct(F.lit(0.0).alias("x"), F.lit(2.0).alias("w"))
    z = F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), start, step, lambda p: p["x"] * F.sqrt(-2 * F.log(p["w"]) / p["w"]))
    return F.lit(float(mean)) + F.lit(float(deviation)) * z


def dyn_ssfr(sfr, log_mass, draw=None, key: tuple = (), seed: int = 0) -> Column:
    """Specific rate; a quiescent galaxy gets 10 ** (-12 + 0.2 draw), of a normal draw by its key columns if none is given."""
    z = normal(*key, seed=seed) if draw is None else _c(draw)
    return F.when(_c(sfr) == 0, F.pow(F.lit(10.0), -12 + 0.2 * z)).otherwise(_c(sfr) / F.pow(F.lit(10.0), _c(log_mass)))


def gaussian_kernel(fwhm: float, cutoff: float = 1e-5) -> list[tuple[int, float]]:
    """(offset, weight) of a 1-D kernel cut where it falls under cutoff of its peak; weights sum to 1."""
    sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    reach = max(1, int(sigma * math.sqrt(-2 * math.log(cutoff))))
    raw = [(k, math.exp(-k * k / (2 * sigma * sigma))) for k in range(-reach, reach + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def chi2(observed: str, expected: str, weights: str) -> Column:
    """Sum of w (o - e)**2 over array columns."""
    d = F.zip_with(F.col(observed), F.col(expected), lambda o, e: (o - e) * (o - e))
    return F.aggregate(F.zip_with(d, F.col(weights), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
