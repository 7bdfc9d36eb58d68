"""Parametric light-curve models, error function and distributions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of both models with their bounds and starting points.
NEWLING = {"logA": (0.0, 10.0, 5.0), "phi": (-60.0, 100.0, 30.0), "logsigma": (-3.0, 4.0, 1.0), "logk": (-4.0, 4.0, 1.0), "logpsi": (-6.0, 10.0, 1.0)}
KARPENKA = {"logA": (math.log(1e-5), math.log(1000), math.log(100)), "logB": (math.log(1e-5), math.log(100), math.log(10)), "t0": (0.0, 100.0, 20.0), "t1": (0.0, 100.0, 30.0), "T_rise": (0.0, 100.0, 40.0), "T_fall": (0.0, 100.0, 40.0)}


def hermite(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The cubic from (x1, y1) to (x2, y2) that is level at both ends."""
    u = (x - x1) / (x2 - x1)
    rise = y2 - y1
    return y1 + rise * u * u * (3 - 2 * u)


def newling(t: Column, p: Mapping[str, Column]) -> Column:
    """A gamma-like pulse from phi on with a level tail that sets in smoothly."""
    amp, k, sigma, psi = (F.exp(p[n]) for n in ("logA", "logk", "logsigma", "logpsi"))
    phi = p["phi"]
    tau = k * sigma + phi
    delta = (t - phi) / sigma
    pulse = amp * F.exp(k * F.ln(F.when(delta > 0, delta)) - delta - k * F.ln(k) + k)
    tail = F.when(t < phi, 0.0).when(t <= tau, hermite(t, phi, F.lit(0.0), tau, psi)).otherwise(psi)
    return F.when(t > phi, pulse + tail).otherwise(0.0)


def karpenka(t: Column, p: Mapping[str, Column]) -> Column:
    """An exponential rise and fall with a quadratic bump."""
    bump = 1 + F.exp(p["logB"]) * (t - p["t1"]) * (t - p["t1"])
    since = t - p["t0"]
    return F.exp(p["logA"]) * bump * F.exp(-since / p["T_fall"]) / (1 + F.exp(-since / p["T_rise"]))


def erf(x: Column) -> Column:
    """The error function to 1.5e-7, by a rational approximation that other engines can repeat."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def detection_probability(s2n: Column) -> Column:
    return (erf((s2n - 5.5) / 2) + 1) / 2


def triangular_from_left(u: Column, low: Column, high: Column) -> Column:
    """The inverse distribution function of the triangle that is highest at its low end."""
    return high - (high - low) * F.sqrt(1 - u)


def trapezoid(u: Column, low: Column, high: Column, right_density: Column) -> Column:
    """The inverse distribution function of a density that runs straight from the low to the high end.

    ``right_density`` is its value at the high end; where that makes it flat the distribution is uniform.
    """
    width = high - low
    left = 2 / width - right_density
    slope = (right_density - left) / width
    bent = (F.sqrt(left * left + 2 * slope * u) - left) / F.when(F.abs(slope) > 1e-12, slope)
    return low + F.coalesce(bent, u * width)


def redshift_limits(z: Column, bands: Sequence[float], stretch: float = 1.0) -> tuple[Column, Column]:
    """The redshifts to which an object can be moved with the model's wavelengths ``bands`` (u, g, …, z, y)."""
    u, g, z_band, y = bands[0], bands[1], bands[-2], bands[-1]
    low = F.greatest(F.lit(1e-4), (1 + z) / F.lit(2 - z_band / y) - 1)
    return low, ((1 + z) / F.lit(2 - g / u) - 1) * stretch if 2 - g / u > 0 else F.lit(None).cast("double")


def log_triangular_redshift(u: Column, low: Column, high: Column) -> Column:
    """A redshift drawn with a triangle in its logarithm and reflected, so that high redshifts prevail."""
    return -F.exp(triangular_from_left(u, F.ln(low), F.ln(high))) + low + high


def shifted_wavelength(wavelength: Column, z0: Column, z1: Column) -> Column:
    return wavelength * (1 + z0) / (1 + z1)


def stretched_time(t: Column, t_peak: Column, z0: Column, z1: Column) -> Column:
    return t_peak + (t - t_peak) * (1 + z1) / (1 + z0)
