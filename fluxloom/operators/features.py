"""Features of light curves: wavelets on arrays, statistics of modelled and observed fluxes, classification ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.runtime import dealt
from fluxloom.schema import LSST

#: Analysis low-pass filters that no rule below gives.
LOW_PASS = {
    "coif1": (-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539),
}
_WIDEST = {"db": 20, "sym": 10}


#: The orders of the biorthogonal splines, of synthesis and analysis.
SPLINES = ("1.1", "1.3", "1.5", "2.2", "2.4", "2.6", "2.8", "3.1", "3.3", "3.5", "3.7", "3.9", "4.4", "5.5", "6.8")
#: Of these the ones whose further zeros are shared out: zeros at -1 of synthesis and analysis, and which group of zeros synthesis takes.
_SHARED = {"4.4": (4, 4, 1), "5.5": (6, 4, 1), "6.8": (6, 8, 1)}


def wavelets(biorthogonal: bool = False) -> list[str]:
    """The names of the orthogonal wavelets, or those of the biorthogonal ones, that ``filters_of`` and ``synthesis_of`` know."""
    if biorthogonal:
        return [f"{family}{n}" for family in ("bior", "rbio") for n in SPLINES]
    return ["haar", *LOW_PASS, *[f"{family}{n}" for family, top in _WIDEST.items() for n in range(1 if family == "db" else 2, top + 1)]]


def _from_roots(n: int, roots: np.ndarray) -> np.ndarray:
    """The filter with ``n`` zeros at -1 and the given ones, of sum sqrt(2)."""
    taps = np.real(np.poly(np.concatenate([roots, -np.ones(n)])))
    return taps * (np.sqrt(2.0) / taps.sum())


@lru_cache(64)
def _orthogonal(family: str, n: int) -> tuple[float, ...]:
    """The analysis low-pass filter with ``n`` vanishing moments.

    The half-band polynomial, sum of C(n - 1 + k, k) y^k, has its zeros in pairs z, 1 / z with z + 1 / z = 2 - 4 y. Of each pair
    the extremal-phase filter (db) takes the one inside the circle; the least asymmetric one (sym) takes, pair by
    pair, those that keep the phase nearest to a line.
    """
    y = np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else np.zeros(0)
    half = 1 - 2 * y
    inside = np.array([z for h in half for z in (h - np.sqrt(h * h - 1 + 0j), h + np.sqrt(h * h - 1 + 0j)) if abs(z) < 1])
    best = _from_roots(n, inside)
    if family == "sym":
        groups = [np.array([z]) if abs(z.imag) < 1e-9 else np.array([z, z.conjugate()]) for z in inside if z.imag > -1e-9]
        omega, found = np.linspace(1e-3, np.pi * 0.9, 200), None
        for choice in product((False, True), repeat=max(0, len(groups) - 1)):
            zeros = [g if not out else 1 / g.conjugate() for g, out in zip(groups, (False, *choice), strict=True)]
            taps = _from_roots(n, np.concatenate(zeros) if zeros else np.zeros(0))
            phase = np.unwrap(np.angle(np.exp(-1j * np.outer(omega, np.arange(2 * n))) @ taps))
            line = np.polyfit(omega, phase, 1)
            off = float(((phase - np.polyval(line, omega)) ** 2).sum())
            if found is None or off < found - 1e-9:
                found, best = off, taps
        # of a filter and its mirror image the one that is heavier towards its start
        best = best if (best**2 @ np.arange(2 * n)) <= n - 0.5 else best[::-1]
        return tuple(best.tolist())
    return tuple(best[::-1].tolist())


@lru_cache(64)
def _spline(orders: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The low-pass filters of analysis and synthesis of a biorthogonal spline, on one even length and with one centre.

    The half-band polynomial of ``_orthogonal`` keeps its zeros here in whole groups, a zero with its inverse and conjugates, so
    that both filters are symmetric. Synthesis is the plain spline and analysis takes all groups, except where they are shared.
    """
    synthesis, analysis, taken = _SHARED.get(orders, (*map(int, orders.split(".")), None))
    n = (synthesis + analysis) // 2
    y = np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else np.zeros(0)
    both = lambda v: [1 - 2 * v - np.sqrt((1 - 2 * v) ** 2 - 1 + 0j), 1 - 2 * v + np.sqrt((1 - 2 * v) ** 2 - 1 + 0j)]
    groups = [both(v.real) if abs(v.imag) < 1e-9 else both(v) + both(v.conjugate()) for v in y if v.imag > -1e-9]
    groups.sort(key=len, reverse=True)  # those of four zeros first, in the order of the roots
    mine = [z for i, g in enumerate(groups) for z in g if i == taken]
    others = [z for i, g in enumerate(groups) for z in g if i != taken]
    low, back = _from_roots(analysis, np.array(others, complex)), _from_roots(synthesis, np.array(mine, complex))
    width = max(len(low), len(back)) + max(len(low), len(back)) % 2
    ahead = lambda taps: (width - len(taps) + 1) // 2
    return tuple(tuple(np.pad(t, (ahead(t), width - len(t) - ahead(t))).tolist()) for t in (low, back))


def _banks(wavelet: str) -> tuple[tuple[float, ...], tuple[float, ...]] | None:
    """The low-pass filters of analysis and synthesis where these differ."""
    family, orders = wavelet[:4], wavelet[4:]
    if family not in ("bior", "rbio") or orders not in SPLINES:
        return None
    return _spline(orders) if family == "bior" else _spline(orders)[::-1]


def _mirrored(low: Sequence[float]) -> tuple[float, ...]:
    return tuple((-1) ** k * low[len(low) - 1 - k] for k in range(len(low)))


def synthesis_of(wavelet: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Low-pass and high-pass taps of the inverse; those of ``filters_of`` but for biorthogonal families."""
    banks = _banks(wavelet)
    return (banks[1], _mirrored(banks[0])) if banks else filters_of(wavelet)


def filters_of(wavelet: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Low-pass and high-pass taps of the analysis; a ValueError for an unknown wavelet."""
    if banks := _banks(wavelet):
        return banks[0], _mirrored(banks[1])
    name = {"haar": "db1", "sym2": "db2", "sym3": "db3"}.get(wavelet, wavelet)
    family, number = name.rstrip("0123456789"), name[len(name.rstrip("0123456789")) :]
    if name in LOW_PASS:
        low = LOW_PASS[name]
    elif family in _WIDEST and number and 1 <= int(number) <= _WIDEST[family]:
        low = _orthogonal(family, int(number))
    else:
        raise ValueError(f"unknown wavelet {wavelet}; one of {wavelets() + wavelets(True)}")
    return low, _mirrored(low)


def max_level(n: int) -> int:
    """How often a length can be halved."""
    return (n & -n).bit_length() - 1 if n else 0


def check_level(level: int | str, n: int) -> int:
    top = max_level(n)
    if level == "max":
        return top
    if not isinstance(level, int) or not 1 <= level <= top:
        raise ValueError(f"a level from 1 to {top} or 'max'")
    return level


def swt_array(x: np.ndarray, levels: int, wavelet: str = "sym2") -> list[tuple[np.ndarray, np.ndarray]]:
    """(cA, cD) of levels 1 to ``levels``, along the last axis: sums around a circle, 2^(level-1) apart, nothing decimated."""
    low, high = filters_of(wavelet)
    out = []
    for level in range(levels):
        around = [np.roll(x, -k << level, axis=-1) for k in range(len(low))]
        out.append((sum(t * r for t, r in zip(low, around, strict=True)), sum(t * r for t, r in zip(high, around, strict=True))))
        x = out[-1][0]
    return out


def iswt_array(approximation: np.ndarray, details: Sequence[np.ndarray], wavelet: str = "sym2") -> np.ndarray:
    """The signal of the deepest approximation and the details of levels 1, 2, …, along the last axis."""
    low, high = synthesis_of(wavelet)
    x = approximation
    for level in range(len(details) - 1, -1, -1):
        x = sum(a * np.roll(x, k << level, axis=-1) + d * np.roll(details[level], k << level, axis=-1) for k, (a, d) in enumerate(zip(low, high, strict=True))) / 2
    return x


def _by_length(arrays: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the arrays of each length, some thousands at a time."""
    lengths = np.array([len(x) for x in arrays], int)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, 1 + len(at) // 4096):
            yield part, np.stack(arrays.to_numpy()[part]).astype(float)


def swt(df: DataFrame, column: str, levels: int, wavelet: str = "sym2") -> DataFrame:
    """``df`` with the arrays cA_l and cD_l for l = 1 … levels of an array column."""
    filters_of(wavelet)
    kind = T.StructType([T.StructField(f"{c}_{level}", T.ArrayType(T.DoubleType())) for level in range(1, levels + 1) for c in ("cA", "cD")])

    @F.pandas_udf(kind)
    def transformed(arrays: pd.Series) -> pd.DataFrame:
        out = {name: np.empty(len(arrays), object) for name in kind.names}
        for at, x in _by_length(arrays):
            for name, c in zip(kind.names, (c for pair in swt_array(x, levels, wavelet) for c in pair), strict=True):
                out[name][at] = list(c) if c.shape[1] else [[]] * len(at)
        return pd.DataFrame(out)

    return df.withColumn("_swt", transformed(F.col(column))).select("*", "_swt.*").drop("_swt")


def iswt(df: DataFrame, levels: int, name: str, wavelet: str = "sym2") -> DataFrame:
    """``df`` with ``name``: the signal of cA_levels and all cD."""
    filters_of(wavelet)

    @F.pandas_udf("array<double>")
    def restored(deepest: pd.Series, *details: pd.Series) -> pd.Series:
        out = np.empty(len(deepest), object)
        for at, x in _by_length(deepest):
            again = iswt_array(x, [np.stack(d.to_numpy()[at]).astype(float) for d in details], wavelet)
            out[at] = list(again) if again.shape[1] else [[]] * len(at)
        return pd.Series(out)

    return df.withColumn(name, restored(f"cA_{levels}", *[f"cD_{level}" for level in range(1, levels + 1)]))


def feature_vector(df: DataFrame, levels: int, filters: Sequence[str] = LSST, key: str = "object_id") -> DataFrame:
    """(key, features): per band in order, per level from the deepest, cA and then cD, in one array."""
    parts = F.flatten(F.array(*[F.col(f"{c}_{level}") for level in range(levels, 0, -1) for c in ("cA", "cD")]))
    place = F.array_position(F.array(*[F.lit(f) for f in filters]), F.col("filter"))
    rows = df.where(place > 0).select(key, F.struct(place.alias("p"), parts.alias("v")).alias("s"))
    return rows.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["v"])).alias("features"))


def coefficient_table(df: DataFrame, levels: int, key: str = "object_id") -> DataFrame:
    """Coefficients as a readable table: one row per object, band and place."""
    names = [f"{c}_{level}" for level in range(1, levels + 1) for c in ("cA", "cD")]
    zipped = df.select(key, "filter", F.posexplode(F.arrays_zip(*names)).alias("place", "c"))
    return zipped.select(key, "filter", "place", *[F.col(f"c.{n}").alias(n) for n in names])


def pack_models(models: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, filter, mjd, flux, flux_error): models as arrays by time. A grid is as long as its model, not as the data."""
    row = F.struct("mjd", "flux", "flux_error")
    packed = dealt(models.select(key, "filter", "mjd", "flux", "flux_error"), key, "filter").groupBy(key, "filter").agg(F.sort_array(F.collect_list(row)).alias("_r"))
    return packed.select(key, "filter", *[F.col(f"_r.{c}").alias(c) for c in ("mjd", "flux", "flux_error")])


FRACTIONS = (0.8, 0.5, 0.2)


def _tenths(share: float) -> str:
    """A share in a column name, without the point that SQL would read as a field."""
    return f"{share:.1f}".replace(".", "_")


def times_to_fractions(flux: Column, peak: Column, top: Column, forward: bool = True) -> Column:
    """Steps from the peak until the flux is below 0.8, 0.5 and 0.2 of it, one after another; null where it is not."""
    outward = F.slice(flux, peak + 2, F.size(flux)) if forward else F.reverse(F.slice(flux, F.lit(1), peak))

    def step(state: Column, x: Column) -> Column:
        met, seen, times = state["met"], state["seen"] + 1, []
        for i, f in enumerate(FRACTIONS):
            now = (met == i) & (x < top * f)
            times.append(F.when(now, seen).otherwise(state[f"t{i}"]).alias(f"t{i}"))
            met = F.when(now, F.lit(i + 1)).otherwise(met)
        return F.struct(met.alias("met"), seen.alias("seen"), *times)

    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("met"), F.lit(0).alias("seen"), *[none.alias(f"t{i}") for i in range(3)])
    return F.aggregate(outward, begin, step)


def peak_heights(flux: Column, height: Column) -> Column:
    """Heights of the local maxima of at least ``height``, highest first; a plateau is one peak, ends are none."""
    runs = F.filter(flux, lambda x, i: (i == 0) | (x != F.get(flux, i - 1)))
    tops = F.filter(runs, lambda x, i: (i > 0) & (i < F.size(runs) - 1) & (x > F.get(runs, i - 1)) & (x > F.get(runs, i + 1)) & (x >= height))
    return F.sort_array(tops, asc=False)


def _array_percentile(values: Column, share: float) -> Column:
    """The interpolated percentile of an array."""
    ordered = F.sort_array(values)
    place = (F.size(values) - 1) * F.lit(share)
    low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def band_features(packed: DataFrame, key: str = "object_id") -> DataFrame:
    """One row per object and band with the statistics of its model."""
    flux = F.col("flux")
    df = packed.withColumns({"max_flux": F.array_max(flux), "min_flux": F.array_min(flux)})
    df = df.withColumn("_at", (F.array_position(flux, F.col("max_flux")) - 1).cast("int"))
    df = df.withColumn("time_max", F.get("mjd", F.col("_at")))
    df = df.withColumns({"_fwd": times_to_fractions(flux, F.col("_at"), F.col("max_flux")), "_bwd": times_to_fractions(flux, F.col("_at"), F.col("max_flux"), False)})
    height = F.greatest(F.abs("max_flux"), F.abs("min_flux")) / 5.0
    df = df.withColumns({"_pos": peak_heights(flux, height), "_neg": peak_heights(F.transform(flux, lambda x: -x), height)})
    none = F.lit(None).cast("double")
    out = {
        "positive_width": _sum(F.transform(flux, lambda x: F.greatest(x, F.lit(0.0)))) / F.nullif("max_flux", F.lit(0.0)),
        "negative_width": _sum(F.transform(flux, lambda x: F.least(x, F.lit(0.0)))) / F.nullif("min_flux", F.lit(0.0)),
        "abs_diff": _sum(F.transform(flux, lambda x, i: F.when(i == 0, 0.0).otherwise(F.abs(x - F.get(flux, i - 1))))),
        "total_s2n": F.sqrt(_sum(F.zip_with(flux, "flux_error", lambda a, b: F.pow(a / F.nullif(b, F.lit(0.0)), F.lit(2.0))))),
    }
    out |= {f"percentile_{p}": _array_percentile(flux, p / 100) for p in (10, 30, 50, 70, 90)}
    for name in ("fwd", "bwd"):
        out |= {f"time_{name}_max_{_tenths(f)}": F.col(f"_{name}.t{i}").cast("double") for i, f in enumerate(FRACTIONS)}
    for name in ("pos", "neg"):
        c = F.col(f"_{name}")
        out[f"peaks_{name}_count"] = F.size(c)
        out |= {f"peaks_{name}_frac_{i}": F.when(F.size(c) >= i, F.get(c, F.lit(i - 1)) / F.get(c, F.lit(0))).otherwise(none) for i in (2, 3)}
    return df.select(key, "filter", "max_flux", "min_flux", "time_max", *[v.alias(k) for k, v in out.items()])


_EDGES = (5, 20, 50, *range(100, 900, 100))
#: (start, end, name) of the bins around the peak: the centre, then rises and falls named by their far edges.
TIME_BINS = (
    (-5, 5, "center"),
    *((-b, -a, f"rise_{b}") for a, b in zip(_EDGES, _EDGES[1:], strict=False)),
    *((a, b, f"fall_{b}") for a, b in zip(_EDGES, _EDGES[1:], strict=False)),
)


def observed_features(obs: DataFrame, max_times: DataFrame, key: str = "object_id") -> DataFrame:
    """Counts and widths by signal to noise, and counts in the bins around ``max_time``."""
    rows = obs.withColumn("_s", F.col("flux") / F.nullif("flux_error", F.lit(0.0))).join(max_times.select(key, "max_time"), key)
    s, off = F.col("_s"), F.col("mjd") - F.col("max_time")
    found = [F.count("*").alias("count")]
    found += [F.count_if(s < t if t < 0 else s > t).alias(f"count_s2n_{t}") for t in (-20, -10, -5, -3, 3, 5, 10, 20)]
    found.append((F.count_if(F.abs(s) < 3) / F.count("*")).alias("frac_background"))
    for t in (5, 10, 20):
        when = F.when(F.abs(s) > t, F.col("mjd"))
        found.append(F.when(F.count(when) < 2, -1.0).otherwise(F.max(when) - F.min(when)).alias(f"time_width_s2n_{t}"))
    found += [F.count_if((off > a) & (off < b)).alias(f"count_max_{n}") for a, b, n in TIME_BINS]
    return rows.groupBy(key).agg(*found)


def raw_features(obs: DataFrame, models: DataFrame, objects: DataFrame, filters: Sequence[str] = LSST, gp_params: DataFrame | None = None, key: str = "object_id") -> DataFrame:
    """One wide row per object: host columns, counts, the statistics of each band, model means in the bins around the peak."""
    packed = pack_models(models, key)
    bands = band_features(packed, key)
    tops = bands.groupBy(key).agg(F.median("time_max").alias("max_time"))
    kept = [c for c in bands.columns if c not in (key, "filter")]
    wide = bands.groupBy(key).pivot("filter", list(filters)).agg(*[F.first(c).alias(c) for c in kept])
    columns = [F.col(key)]
    for f in filters:
        for c in kept:
            source = F.col(f"{f}_{c}")
            if c == "time_max":
                columns.append(source.alias(f"_tmax_{f}"))
            elif c.startswith("peaks"):
                head, tail = c[:9], c[10:]
                columns.append(source.alias(f"{head}_{f}_{tail}"))
            elif c.startswith("percentile"):
                columns.append(source.alias(f"percentile_{f}_{c.split('_')[1]}"))
            else:
                columns.append(source.alias(f"{c}_{f}"))
    wide = wide.select(*columns).join(tops, key)
    wide = wide.withColumns({f"max_dt_{f}": F.col(f"_tmax_{f}") - F.col("max_time") for f in filters}).drop(*[f"_tmax_{f}" for f in filters])
    scaled = models.select(key, "filter", "mjd", "flux").join(bands.select(key, "filter", "max_flux"), [key, "filter"]).join(tops, key)
    off, rel = F.col("mjd") - F.col("max_time"), F.col("flux") / F.nullif("max_flux", F.lit(0.0))
    inside = lambda a, b: F.when((off >= a) & (off < b), rel)
    binned = scaled.groupBy(key).agg(*[f(inside(a, b)).alias(f"{n}_max_{name}") for a, b, name in TIME_BINS for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    seen = observed_features(obs, tops, key)
    host = [F.col(c).alias(n) for c, n in (("hostgal_specz", "host_specz"), ("hostgal_photoz", "host_photoz"), ("hostgal_photoz_err", "host_photoz_error"), ("ra", "ra"), ("decl", "decl"), ("mwebv", "mwebv"), ("ddf", "ddf")) if c in objects.columns]
    out = seen.join(wide, key).join(binned, key).join(objects.select(key, *host), key)
    for _, _, name in TIME_BINS:
        out = out.withColumns({f"{n}_max_{name}": F.when(F.col(f"count_max_{name}") > 0, F.col(f"{n}_max_{name}")) for n in ("mean", "std")})
    if gp_params is not None:
        fitted = gp_params.select(key, *[F.get("params", F.lit(i)).alias(f"gp_fit_{i}") for i in range(2)])
        out = out.join(fitted, key, "left")
    return out


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _median_of(columns: Sequence[Column]) -> Column:
    """The median of the values that are there."""
    return _array_percentile(F.array_compact(F.array(*columns)), 0.5)


def classification_features(raw: DataFrame, filters: Sequence[str] = LSST, key: str = "object_id", middle: str = "lssti", red: str = "lssty", blue: str = "lsstg") -> DataFrame:
    """The 41 ratios and combinations of raw features that classifiers use."""
    c = lambda name, f=None: F.col(name if f is None else f"{name}_{f}").cast("double")
    out = {"host_photoz": c("host_photoz"), "host_photoz_error": c("host_photoz_error")}
    out["length_scale"] = c("gp_fit_1") if "gp_fit_1" in raw.columns else F.lit(None).cast("double")
    out["max_mag"] = -2.5 * F.log10(F.nullif(F.abs(c("max_flux", middle)), F.lit(0.0)))
    out["pos_flux_ratio"] = _over(c("max_flux", middle), c("max_flux", middle) - c("min_flux", middle))
    for side in ("max", "min"):
        for name, f in (("red", red), ("blue", blue)):
            a, b = F.abs(c(f"{side}_flux", f)), F.abs(c(f"{side}_flux", middle))
            out[f"{side}_flux_ratio_{name}"] = _over(a, a + b)
    out["max_dt"] = c("max_dt", red) - c("max_dt", blue)
    out |= {n: c(n, middle) for n in ("positive_width", "negative_width")}
    for way in ("fwd", "bwd"):
        for share in (0.5, 0.2):
            name = f"time_{way}_max_{_tenths(share)}"
            out[name] = c(name, middle)
            for colour, f in (("red", red), ("blue", blue)):
                out[f"{name}_ratio_{colour}"] = _over(c(name, f), c(name, f) + c(name, middle))
    out |= {"frac_s2n_5": c("count_s2n_5") / c("count"), "frac_s2n_-5": c("`count_s2n_-5`") / c("count"), "frac_background": c("frac_background"), "time_width_s2n_5": c("time_width_s2n_5")}
    out["count_max_center"] = c("count_max_center")
    for way in ("rise", "fall"):
        total = out["count_max_center"]
        for edge in (20, 50, 100):
            total = total + c(f"count_max_{way}_{edge}")
            out[f"count_max_{way}_{edge}"] = total
    out["peak_frac_2"] = _median_of([c(f"peaks_pos_{f}_frac_2") for f in filters])
    squares = F.lit(0.0)
    for f in filters:
        squares = squares + F.pow(c("total_s2n", f), F.lit(2.0))
    out["total_s2n"] = F.sqrt(squares)
    share = {p: _median_of([_over(c(f"percentile_{f}_{p}") - c("min_flux", f), c("max_flux", f) - c("min_flux", f)) for f in filters]) for p in (10, 30, 50, 70, 90)}
    out |= {f"percentile_diff_{p}_50": share[p] - share[50] for p in (10, 30, 70, 90)}
    return raw.select(key, *[v.alias(k) for k, v in out.items()])


def explained_components(eigenvalues: DataFrame, share: float = 0.95) -> DataFrame:
    """(n_components): the least number of leading eigenvalues (place, value) that explain ``share``."""
    from pyspark.sql import Window as W

    running = F.sum("value").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) / F.sum("value").over(W.partitionBy())
    return eigenvalues.withColumn("_c", running).where(F.col("_c") >= share - 1e-12).agg(F.min("place").alias("n_components"))


def combine_features(*tables: DataFrame, key: str = "object_id") -> DataFrame:
    """Feature tables joined by object; a column that two of them have is an error."""
    out = tables[0]
    for more in tables[1:]:
        if both := set(out.columns) & set(more.columns) - {key}:
            raise ValueError(f"columns in two tables: {sorted(both)}")
        out = out.join(more, key)
    return out
