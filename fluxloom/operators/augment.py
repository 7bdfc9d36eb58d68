"""Synthesised objects: an original is moved to another redshift, its model read at the new wavelengths and times.

Every copy draws from a generator seeded by its id and try, so results do not depend on how rows are dealt out. The
surveys differ only in the constants of ``SURVEYS``; copies for several surveys share the models of their originals.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.fit import _seed
from fluxloom.operators.gp import condition, in_batches, kernel_2d, many_fit_2d
from fluxloom.operators.neighbours import nearest_rows
from fluxloom.ordering import ranked, running_sums
from fluxloom.runtime import broadcast_if_small, in_groups, materialised
from fluxloom.schema import PASSBANDS


@dataclass(frozen=True)
class Survey:
    """How a survey chooses redshifts and fields, how often it observes, and its added noise.

    ``n_obs`` and the entries of ``noise`` are mixtures of (weight, mean, variance); noise is the logarithm of the added
    error in each band.
    """

    redshift: str
    from_ddf: bool
    ddf: bool
    least_obs: int
    n_obs: tuple[tuple[float, float, float], ...]
    noise: Mapping[str, tuple[tuple[float, float, float], ...]]


def _noise(**bands: tuple) -> dict[str, tuple[tuple[float, float, float], ...]]:
    """Per band the weights, means and variances of its mixture."""
    return {f"lsst{b}": tuple(zip(*parts, strict=True)) for b, parts in bands.items()}


#: Fixed values of the surveys: the rule for redshifts, whether originals must be deep-field, the field of copies, the
#: least number of observations, its mixture (weight, mean, variance), and the noise of the bands.
SURVEYS = {
    "plasticc_wfd": Survey("wfd", False, False, 3, ((1.0, 24.5006006, 72.5106613),), _noise(
        u=((1.0,), (2.34,), (0.43**2,)),
        g=((1.0,), (0.94,), (0.41**2,)),
        r=((1.0,), (1.30,), (0.41**2,)),
        i=((1.0,), (1.82,), (0.42**2,)),
        z=((1.0,), (2.56,), (0.36**2,)),
        y=((1.0,), (3.33,), (0.37**2,)),
    )),
    "plasticc_ddf": Survey("ddf", True, True, 20, ((0.34393457, 57.36015146, 271.58889272), (0.65606543, 92.7741619, 338.53085446)), _noise(
        u=((1.0,), (0.68,), (0.26**2,)),
        g=((1.0,), (0.25,), (0.50**2,)),
        r=((1.0,), (0.16,), (0.36**2,)),
        i=((1.0,), (0.53,), (0.27**2,)),
        z=((1.0,), (0.88,), (0.22**2,)),
        y=((1.0,), (1.76,), (0.23**2,)),
    )),
    "baseline_v20_plasticc_wfd": Survey("wfd", True, True, 4, ((0.33829852, 17.57122788, 88.81445042), (0.36584055, 98.76335824, 175.56964147), (0.29586093, 55.84976549, 90.92855255)), _noise(
        u=((0.50890351, 0.1674677, 0.3236288), (1.15910188, 1.57513178, 0.75304931), (0.02570773, 0.12252229, 0.02907247)),
        g=((0.31367609, 0.14129098, 0.54503293), (-0.25116208, 0.6020499, 0.1060065), (0.03202531, 0.06563274, 0.02546574)),
        r=((0.31646206, 0.17148511, 0.51205283), (-0.20202721, 0.46961199, 0.15050021), (0.02614601, 0.1284051, 0.02230432)),
        i=((0.3383791, 0.50591912, 0.15570179), (0.25100765, 0.53670117, 0.95752681), (0.02520334, 0.01984151, 0.12698874)),
        z=((0.44948967, 0.33357324, 0.21693709), (0.92402643, 0.71355807, 1.25239874), (0.01066763, 0.01201745, 0.03381948)),
        y=((0.16064206, 0.34760465, 0.49175329), (2.23060362, 1.57224717, 1.81965783), (0.06961287, 0.02034714, 0.01822751)),
    )),
    "baseline_v20_wfd": Survey("base-v2", False, False, 3, ((0.679, 33.6, 199.09), (0.321, 65.1, 453.67)), _noise(
        u=((0.29, 0.71), (2.24, 1.93), (0.38, 0.09)),
        g=((0.88, 0.12), (1.26, 1.98), (0.11, 0.85)),
        r=((0.29, 0.71), (1.89, 1.58), (0.34, 0.08)),
        i=((0.63, 0.37), (1.99, 2.45), (0.08, 0.20)),
        z=((1.0,), (2.67,), (0.14,)),
        y=((1.0,), (3.23,), (0.14,)),
    )),
    "presto_v20_wfd": Survey("base-v2", False, False, 3, ((0.626, 27.11, 125.04), (0.374, 53.72, 252.05)), _noise(
        u=((0.64, 0.36), (1.96, 2.35), (0.09, 0.28)),
        g=((0.10, 0.90), (2.12, 1.41), (0.98, 0.14)),
        r=((0.23, 0.45, 0.32), (2.82, 1.60, 2.20), (0.30, 0.08, 0.12)),
        i=((0.66, 0.34), (1.96, 2.48), (0.10, 0.26)),
        z=((1.0,), (2.68,), (0.17,)),
        y=((0.62, 0.38), (3.07, 3.52), (0.07, 0.13)),
    )),
    "baseline_v20_subset_wfd": Survey("base-v2", False, False, 3, ((0.322, 16.86, 46.62), (0.678, 61.15, 561.06)), _noise(
        u=((0.24, 0.76), (2.34, 1.92), (0.46, 0.10)),
        g=((0.88, 0.12), (1.26, 2.06), (0.11, 0.93)),
        r=((0.27, 0.73), (1.92, 1.57), (0.38, 0.09)),
        i=((0.62, 0.38), (1.97, 2.45), (0.08, 0.22)),
        z=((1.0,), (2.65,), (0.14,)),
        y=((1.0,), (3.23,), (0.15,)),
    )),
    "noroll_v20_subset_wfd": Survey("base-v2", False, False, 3, ((0.289, 31.93, 30.23), (0.215, 18.07, 42.76), (0.181, 59.65, 75.83), (0.315, 45.35, 34.96)), _noise(
        u=((0.25, 0.75), (2.29, 1.95), (0.45, 0.10)),
        g=((0.11, 0.89), (2.13, 1.27), (1.08, 0.12)),
        r=((0.76, 0.24), (1.59, 1.92), (0.09, 0.40)),
        i=((0.63, 0.37), (1.98, 2.44), (0.08, 0.23)),
        z=((1.0,), (2.65,), (0.14,)),
        y=((1.0,), (3.22,), (0.14,)),
    )),
}


@lru_cache(256)
def _steps(parts: tuple) -> tuple[list[float], list[tuple[float, float]]]:
    """Where the weights of a mixture end, from 0 to 1, as ``Generator.choice`` sums them, and its means and deviations."""
    weights = np.array([w for w, _, _ in parts])
    ends = (weights / weights.sum()).cumsum()
    return (ends / ends[-1]).tolist(), [(mean, math.sqrt(variance)) for _, mean, variance in parts]


def _drawn(rng: np.random.Generator, ends: list[float], parts: list[tuple[float, float]]) -> float:
    return rng.normal(*parts[bisect_right(ends, rng.random())])


def mixture(rng: np.random.Generator, parts: tuple) -> float:
    return float(_drawn(rng, *_steps(parts)))


def new_redshift(rng: np.random.Generator, z: float, rule: str) -> float:
    w = PASSBANDS
    low = max(1e-4, (1 + z) / (2 - w["lsstz"] / w["lssty"]) - 1)
    high = ((1 + z) / (2 - w["lsstg"] / w["lsstu"]) - 1) * (1.4 if rule == "ddf" else 1.0)
    a, b, u = math.log(low), math.log(high), rng.random()
    if rule == "base-v2":
        right = 0.1 * 2 / (b - a)
        left = 2 / (b - a) - right
        slope = (right - left) / (b - a)
        x = a + (u * (b - a) if abs(slope) < 1e-12 else (math.sqrt(left * left + 2 * slope * u) - left) / slope)
    else:
        x = b - (b - a) * math.sqrt(1 - u)
    return -math.exp(x) + low + high


def luminosity_distance(z: float, h0: float = 70.0, matter: float = 0.3) -> float:
    """In megaparsec, for a flat universe with a cosmological constant."""
    radiation = 4.15e-5 * (2.725 / 2.725) ** 4 / (h0 / 100) ** 2
    x = np.linspace(0, z, 513)
    e = 1 / np.sqrt(matter * (1 + x) ** 3 + radiation * (1 + x) ** 4 + 1 - matter - radiation)
    step = z / 512
    return 299792.458 / h0 * (1 + z) * float(step / 3 * (e[0] + e[-1] + 4 * e[1:-1:2].sum() + 2 * e[2:-1:2].sum()))


class Redshifts:
    """Numbered rows (difference, error) that workers draw from: all of them, equal ones held once with their count.

    Equal rows have numbers side by side, ``ends`` are the numbers after the last of each.
    """

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        self.rows, self.ends = rows, np.cumsum(counts)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, number: int) -> np.ndarray:
        return self.rows[self.ends.searchsorted(number, side="right")]


def new_photoz(rng: np.random.Generator, z: float, table: Redshifts | np.ndarray, tries: int = 100) -> tuple[float, float] | None:
    """The first positive pair of photometric redshift and error drawn from rows (difference, error)."""
    for _ in range(tries):
        diff, error = table[rng.integers(len(table))]
        if z + diff > 0 and error > 0:
            return float(z + diff), float(error)
    return None


def trimmed(mjd: np.ndarray, flux: np.ndarray, longest: float, step: float = 5.0) -> np.ndarray:
    """The places of rows in time that stay: the fainter edge is cut by up to five days until the object is short enough."""
    at = np.arange(len(mjd))
    while len(at) and mjd[at[-1]] - mjd[at[0]] > longest:
        t, size = mjd[at], np.abs(flux[at])
        a, b = t[0], t[-1]
        cut = min(step, b - a - longest)
        head, tail = size[t < a + cut], size[t > b - cut]
        first = (head.sum() / len(head) if len(head) else 0.0) <= (tail.sum() / len(tail) if len(tail) else 0.0)
        at = at[t >= a + max(cut, 1e-9)] if first else at[t <= b - max(cut, 1e-9)]
    return at


def observing_times(rng: np.random.Generator, mjd: np.ndarray, band: np.ndarray, flux: np.ndarray, z0: float, z1: float, target: int, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, times in the original's frame, bands) of a copy: the observations in time order, ``band`` by place, stretched about
    the peak, cut to the longest duration, filled or thinned towards ``target``.
    """
    stretch = (1 + z1) / (1 + z0)
    peak = mjd[int(flux.argmax())]
    new = peak + (mjd - peak) * stretch
    at = np.flatnonzero(new >= 0)
    at = at[trimmed(new[at], flux[at], longest)]
    if not len(at):
        return new[at], mjd[at], band[at]
    own = band[at]
    extra = min(max(0, int(target * (stretch - 1))), len(mjd) // 2)
    if extra:
        at = np.concatenate([at, at[rng.integers(len(at), size=extra)]])
        own = np.concatenate([own, rng.choice(np.unique(own), extra)])
    drop = int(max(len(at) - target, 0.1 * len(at)))
    kept = np.sort(rng.permutation(len(at))[drop:])
    kept = kept[np.argsort(new[at[kept]], kind="stable")]
    at, own = at[kept], own[kept]
    return (new[at] - new[at[0]] if len(at) else new[at]), mjd[at], own


def _erf(x: np.ndarray) -> np.ndarray:
    return np.array([math.erf(v) for v in x])


def quota(objects: DataFrame, wanted: DataFrame | str | None, key: str = "object_id", each: int = 10) -> DataFrame:
    """(key, n_copies): none, ``each`` copies of all, or a table of them whose ids must all exist."""
    if wanted is None:
        return objects.select(key).limit(0).withColumn("n_copies", F.lit(0))
    if isinstance(wanted, str):
        if wanted != "all":
            raise ValueError("'all', a table of copies or nothing")
        return objects.select(key).withColumn("n_copies", F.lit(each))
    lost = [r[0] for r in wanted.select(key).join(objects.select(key), key, "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"not in the dataset: {lost}")
    return wanted.select(key, F.col("n_copies").cast("int").alias("n_copies"))


def standardised_redshifts(table: DataFrame) -> DataFrame:
    """(z_diff, hostgal_photoz_err) of a table that has the error and either the difference or both redshifts."""
    names = set(table.columns)
    if "hostgal_photoz_err" in names and {"hostgal_specz", "hostgal_photoz"} <= names:
        return table.select((F.col("hostgal_photoz") - F.col("hostgal_specz")).alias("z_diff"), "hostgal_photoz_err")
    if {"z_diff", "hostgal_photoz_err"} <= names:
        return table.select("z_diff", "hostgal_photoz_err")
    raise ValueError("a redshift table has hostgal_photoz_err and either z_diff or hostgal_specz and hostgal_photoz")


#: Different rows of a redshift table that are sent to the workers whole: some 3 MB. Beyond, draws are joined to the table.
SENT_REDSHIFTS = 1 << 17


_REDSHIFT_ORDER = ("h", "z_diff", "hostgal_photoz_err")


def _redshift_rows(objects: DataFrame, z_table: DataFrame | None = None) -> DataFrame:
    """(h, z_diff, hostgal_photoz_err): the rows from which photometric redshifts are drawn, numbered in the order of these columns.

    They come from ``z_table`` or the objects with a spectroscopic redshift.
    """
    rows = standardised_redshifts(objects.where("hostgal_specz > 0") if z_table is None else z_table).where("z_diff IS NOT NULL AND hostgal_photoz_err IS NOT NULL")
    return rows.select(F.xxhash64("z_diff", "hostgal_photoz_err").alias("h"), *[F.col(c).cast("double").alias(c) for c in ("z_diff", "hostgal_photoz_err")])


def redshift_table(objects: DataFrame, most: int = SENT_REDSHIFTS, z_table: DataFrame | None = None) -> Redshifts | None:
    """All rows (photoz - specz, error) from which photometric redshifts are drawn; none if over ``most`` of them differ."""
    counts = materialised(_redshift_rows(objects, z_table).groupBy(*_REDSHIFT_ORDER).agg(F.count("*").alias("n")))
    if counts.count() > most:
        return None
    rows = counts.orderBy(*_REDSHIFT_ORDER).collect()
    return Redshifts(np.array([(r.z_diff, r.hostgal_photoz_err) for r in rows], float).reshape(-1, 2), np.array([r.n for r in rows], int))


def _joined_photoz(wanted: DataFrame, numbered: DataFrame, key: str, surveys: Sequence[str], pick: Callable, seed: int, tries: int, most: int = 100) -> DataFrame:
    """(key, pairs): of every survey, copy and try the draws that ``new_photoz`` makes, from a table that stays a table.

    The draws are joined to the numbers of its rows: the first draw of each, then the next nine, then the rest, for those without
    a positive pair so far. ``pairs`` has the number of draws, redshift and error; a try without a positive pair is not in it.
    """
    total, kind = numbered.count(), dict(wanted.dtypes)[key]
    left = wanted.select(key, "z0", F.posexplode(F.array(*[F.lit(s) for s in surveys])).alias("s", "survey"), "n_copies")
    left = left.withColumn("i", F.explode(F.expr("sequence(0, n_copies - 1)"))).select(key, "z0", "s", "survey", "i", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
    found = None
    for first, last in ((0, 1), (1, 10), (10, most)):
        def asked(batches: Iterator[pa.RecordBatch], first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z, numbers = [], []
                for name, z0, survey, i, attempt in zip(*[batch[c].to_pylist() for c in (key, "z0", "survey", "i", "attempt")], strict=True):
                    rng = np.random.default_rng(_seed(seed, name, i, attempt))
                    z.append(pick(survey)(rng, z0))
                    numbers.append([int(rng.integers(total)) for _ in range(last)][first:])
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in (key, "z0", "s", "survey", "i", "attempt")], pa.array(z, pa.float64()), pa.array(numbers, pa.list_(pa.int64()))], names=[key, "z0", "s", "survey", "i", "attempt", "z", "numbers"])

        draws = materialised(left.mapInArrow(asked, f"{key} {kind}, z0 double, s int, survey string, i int, attempt int, z double, numbers array<long>"))
        own = [key, "s", "i", "attempt"]
        met = draws.select(*own, "z", F.posexplode("numbers").alias("draw", "number")).join(numbered, "number").where("z + z_diff > 0 AND hostgal_photoz_err > 0")
        good = met.groupBy(*own).agg(F.min(F.struct((F.col("draw") + first + 1).alias("draws"), (F.col("z") + F.col("z_diff")).alias("photoz"), F.col("hostgal_photoz_err").alias("error"))).alias("p"))
        good = materialised(good)
        found = good if found is None else found.unionByName(good)
        left = draws.join(good.drop("p"), own, "left_anti").select(key, "z0", "s", "survey", "i", "attempt")
    return found.groupBy(key).agg(F.collect_list(F.struct("s", "i", "attempt", F.col("p.draws").cast("int").alias("draws"), "p.photoz", "p.error")).alias("pairs"))


def augment(obs: DataFrame, objects: DataFrame, copies: DataFrame, survey: str = "plasticc_wfd", max_duration: float | None = None, seed: int = 0, tries: int = 10, key: str = "object_id", choose_z: Callable | None = None, z_table: DataFrame | None = None) -> DataFrame:
    """Observations of synthesised objects with their redshift columns repeated on each row.

    object_id (``<id>_aug<i>``), original_event, mjd, filter, flux, flux_error, detected, z columns. A copy needs three
    observations of which two are detected, and has ``tries`` attempts at it. ``max_duration`` must not be shorter than
    the longest object.
    """
    return augment_surveys(obs, objects, copies, [survey], max_duration, seed, tries, key, choose_z, z_table).drop("survey")


def augment_surveys(obs: DataFrame, objects: DataFrame, copies: DataFrame, surveys: Sequence[str], max_duration: float | None = None, seed: int = 0, tries: int = 10, key: str = "object_id", choose_z: Callable | None = None, z_table: DataFrame | None = None, sent: int = SENT_REDSHIFTS) -> DataFrame:
    """``augment`` for each of ``surveys``, whose name is the last column: an original's model is fitted once.

    A redshift table of over ``sent`` different rows is not sent to the workers; the draws from it are then made by a join.
    """
    setups = [SURVEYS[s] for s in surveys]
    from fluxloom.operators.stats import longest

    top = longest(obs, key).first()[0] or 0.0
    if max_duration is not None and max_duration < top:
        raise ValueError(f"an object lasts {top} days, more than {max_duration}")
    limit, table = max_duration or top, redshift_table(objects, sent, z_table)
    pick = lambda s: choose_z or (lambda rng, z: new_redshift(rng, z, SURVEYS[s].redshift))
    host = objects.select(key, "ddf", *[F.col(c).cast("double").alias(c) for c in ("hostgal_specz", "hostgal_photoz")])
    host = host.where("ddf") if all(s.from_ddf for s in setups) else host
    host = host.withColumn("z0", F.when((F.col("hostgal_specz") > 0) & ~F.isnan("hostgal_specz"), F.col("hostgal_specz")).otherwise(F.greatest("hostgal_photoz", F.lit(1e-3))))
    host = host.join(copies.where("n_copies > 0"), key).select(key, "ddf", "z0", "n_copies")
    if table is None:
        numbered = ranked(_redshift_rows(objects, z_table).withColumn("_all", F.lit(0)), ["_all"], _REDSHIFT_ORDER, "number")
        numbered = materialised(numbered.select("number", "z_diff", "hostgal_photoz_err"))
        total = numbered.count()
        host = host.join(_joined_photoz(host, numbered, key, surveys, pick, seed, tries), key, "left")
    else:
        total = len(table)
        host = host.withColumn("pairs", F.lit(None).cast("array<struct<s:int,i:int,attempt:int,draws:int,photoz:double,error:double>>"))
    rows = obs.where(~F.col("flux_error").eqNullSafe(F.lit(0.0))).select(key, "filter", *[F.col(c).cast("double").alias(c) for c in ("mjd", "flux", "flux_error")]).join(host, key)
    noise = [{f: _steps(parts) for f, parts in s.noise.items()} for s in setups]

    def photoz(rng: np.random.Generator, z: float, place: tuple[int, int, int], pairs: dict) -> tuple[float, float] | None:
        if table is not None:
            return new_photoz(rng, z, table)
        draws, *pair = pairs.get(place, (0,))
        for _ in range(draws):
            rng.integers(total)
        return tuple(pair) or None

    def made(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        ends = np.append(starts[1:], rows.num_rows)
        wide = np.flatnonzero(ends - starts >= 2)
        if not total:
            return
        for part in in_batches(ends[wide] - starts[wide]):
            yield from copied(rows, starts[wide[part]], ends[wide[part]])

    def copied(rows: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.Table]:
        names = sorted(set(rows["filter"].unique().to_pylist()) - {None})
        code = {f: i for i, f in enumerate(names)}
        band = np.array([code.get(f, -1) for f in rows["filter"].to_pylist()], int)
        wave = np.array([*[PASSBANDS.get(f, np.nan) for f in names], np.nan], float)
        mjd, flux, error = (rows[c].to_numpy() for c in ("mjd", "flux", "flux_error"))
        spans = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        curves = [(np.column_stack([mjd[at], wave[band[at]]]), flux[at], error[at]) for at in spans]
        first = [rows[c].take(pa.array(starts)).to_pylist() for c in (key, "ddf", "z0", "n_copies", "pairs")]
        told, parts = [], []  # (object_id, original_event, z, photoz, error, survey) and (times, bands, flux, error, detected) of each copy
        params, _ = many_fit_2d(curves)
        for at, curve, p, name, ddf, z0, n, pairs in zip(spans, curves, params, *first, strict=True):
            gp, _ = condition(kernel_2d(p[0], p[1]), *curve)
            away, t, own = luminosity_distance(z0), mjd[at], band[at]
            drawn = {(r["s"], r["i"], r["attempt"]): (r["draws"], r["photoz"], r["error"]) for r in pairs or ()}
            for s, setup in enumerate(setups):
                if setup.from_ddf and not ddf:
                    continue
                added = [noise[s].get(f) for f in names]
                for i in range(n):
                    for attempt in range(tries):
                        rng = np.random.default_rng(_seed(seed, name, i, attempt))
                        z1 = pick(surveys[s])(rng, z0)
                        pair = photoz(rng, z1, (s, i, attempt), drawn)
                        target = max(setup.least_obs, int(mixture(rng, setup.n_obs)))
                        times, rest, kept = observing_times(rng, t, own, flux[at], z0, z1, target, limit)
                        if pair is None or len(times) < 3:
                            continue
                        mean, var = gp.predict(np.column_stack([rest, wave[kept] * (1 + z0) / (1 + z1)]))
                        scale = (1 + z0) / (1 + z1) * (away / luminosity_distance(z1)) ** 2
                        extra = np.exp([_drawn(rng, *added[f]) for f in kept.tolist()])
                        value = mean * scale + rng.normal(0, extra)
                        wide = np.sqrt(np.maximum(var, 0) * scale**2 + extra**2)
                        seen = rng.random(len(value)) < (_erf((value / wide - 5.5) / 2) + 1) / 2
                        if seen.sum() < 2:
                            continue
                        told.append((f"{name}_aug{i}", str(name), z1, *pair, s))
                        parts.append((times, kept, value, wide, seen))
                        break
        if not told:
            return
        times, kept, value, wide, seen = (np.concatenate(c) for c in zip(*parts, strict=True))
        ids, events, z, photo, unsure, which = zip(*told, strict=True)
        each = pa.array(np.repeat(np.arange(len(told)), [len(c[0]) for c in parts]))
        long = lambda values, kind=None: pa.array(values, kind).take(each)
        yield pa.table({
            "object_id": long(ids), "original_event": long(events), "mjd": pa.array(times), "filter": pa.array(names).take(pa.array(kept)), "flux": pa.array(value), "flux_error": pa.array(wide), "detected": pa.array(seen),
            "hostgal_specz": long(z, pa.float64()), "hostgal_photoz": long(photo, pa.float64()), "hostgal_photoz_err": long(unsure, pa.float64()), "ddf": long([setups[s].ddf for s in which]), "survey": long([surveys[s] for s in which]),
        })

    columns = "object_id string, original_event string, mjd double, filter string, flux double, flux_error double, detected boolean, hostgal_specz double, hostgal_photoz double, hostgal_photoz_err double, ddf boolean, survey string"
    return in_groups(rows, [key], made, columns, ["mjd", "filter", "flux", "flux_error"])


def refit_gps(made: DataFrame, key: str = "object_id", **options) -> DataFrame:
    """Gaussian processes of the synthesised objects only: those of ``augment``, or marked ``augmented``.

    ``options`` are those of ``fit_gps``.
    """
    from fluxloom.operators.gp import fit_gps

    only = made.where("augmented") if "augmented" in made.columns else made.where("original_event IS NOT NULL") if "original_event" in made.columns else made
    return fit_gps(only, key=key, **options)


def smote(rows: DataFrame, k: int = 5, seed: int = 0, key: str = "object_id", label: str = "label", column: str = "features", borderline: bool = False, weights: DataFrame | None = None, each: int = 512) -> DataFrame:
    """Synthetic rows that bring every class to the size of the largest: (key, label, features, original_event).

    Each is a random point between a row and one of its ``k`` nearest in the class, found exactly by a metric index. What a
    class needs is dealt to its rows in a random order by running sums, a row's share at a time, rounded down or up; with
    ``borderline`` shares follow the mean distance of a row's nearest, with ``weights`` (key, weight) these, and a class without
    weight deals evenly. A row's draws are cut into runs of ``each`` and these are spread over tasks of some thousands, so that a
    rare class is made in as many tasks as a common one. Rows that repeat an id are rows of their own.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_need", F.max("_n").over(W.partitionBy()) - F.col("_n")).where("_need > 0")
    data = rows.join(sizes, rows[label].eqNullSafe(sizes[label])).drop(sizes[label])
    data = data.select(F.col(key).cast("string").alias("id"), F.col(label).alias("y"), F.col(column).cast("array<double>").alias("x"), "_need")
    data = data.withColumn("copy", F.row_number().over(W.partitionBy("y", "id").orderBy("x")))
    # null labels are a class
    data = data.withColumns({"g": F.coalesce(F.concat(F.lit("="), F.col("y").cast("string")), F.lit("-")), "row": F.concat_ws("\u0001", F.coalesce("id", F.lit("")), "copy")})
    data = materialised(data)
    found = nearest_rows(data, data, k + 1, "row", "g", "x", group="g").where(F.col("other") != F.col("row"))
    found = found.withColumn("_r", F.row_number().over(W.partitionBy("row").orderBy("d", "other"))).where(F.col("_r") <= k)
    # vectors are fetched for the nearest rows only
    found = found.join(data.select(F.col("row").alias("_other"), F.col("x").alias("_x")), F.col("other") == F.col("_other"))
    lists = found.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("_r", F.col("_x").alias("x")))).alias("near"), F.avg("d").alias("far"))
    data = data.join(lists, F.col("row") == F.col("_row"), "left")
    if weights is not None:
        given = weights.groupBy(F.col(key).cast("string").alias("_wi")).agg(F.max("weight").alias("_w"))
        share = data.join(given, data["id"] == given["_wi"], "left").withColumn("share", F.coalesce("_w", F.lit(0.0)))
    else:
        share = data.withColumn("share", F.coalesce("far", F.lit(0.0)) if borderline else F.lit(1.0))
    # shares are whole numbers, so that sums do not depend on how rows are dealt out
    share = share.withColumn("share", F.round(F.col("share") * 1_000_000).cast("long"))
    even = materialised(share.groupBy(F.col("g").alias("_g")).agg(F.sum("share").alias("_all"), F.count("*").alias("_rows")))
    share = share.join(broadcast_if_small(even), F.col("g") == F.col("_g")).withColumn("share", F.when(F.col("_all") > 0, F.col("share")).otherwise(1))
    share = share.withColumn("_all", F.when(F.col("_all") > 0, F.col("_all")).otherwise(F.col("_rows"))).select("g", "row", "id", "copy", "y", "x", "near", "share", "_all", "_need")
    lot = F.xxhash64(F.lit(seed), "row")
    sums = materialised(running_sums(share, [F.col("g"), lot, F.col("row")], ahead=F.col("share")))
    first = materialised(sums.groupBy(F.col("g").alias("_g")).agg(F.min("ahead").alias("_first")))
    dealt_ = sums.join(broadcast_if_small(first), F.col("g") == F.col("_g")).withColumn("ahead", F.col("ahead") - F.col("_first"))
    upto = lambda x: F.floor(x.cast("double") * F.col("_need") / F.col("_all"))
    dealt_ = dealt_.select("row", "id", "copy", "y", "x", "near", upto(F.col("ahead")).alias("low"), upto(F.col("ahead") + F.col("share")).alias("high")).where("high > low")
    total = dealt_.agg(F.coalesce(F.sum(F.col("high") - F.col("low")), F.lit(0))).first()[0]
    runs = dealt_.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("low") - 1) / each))))
    runs = runs.repartition(max(1, math.ceil(total / (8 * each))), "row", "run")
    last = F.least(F.col("high") - F.col("low"), (F.col("run") + 1) * each) - 1
    draws = runs.withColumn("j", F.explode(F.sequence(F.col("run") * each, last)))
    chance = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "row", "j"), 11) / float(1 << 53)
    place = F.floor(chance(1) * F.size("near")).cast("int")
    other = F.when(F.size("near") > 0, F.get("near", place)["x"]).otherwise(F.col("x"))
    draws = draws.withColumns({"_t": chance(2), "_o": other})
    point = F.zip_with("x", "_o", lambda a, b: a + F.col("_t") * (b - a))
    name = F.concat(F.col("id"), F.lit("_syn"), F.when(F.col("copy") > 1, F.concat(F.col("copy").cast("string"), F.lit("_"))).otherwise(""), F.col("j").cast("string"))
    return draws.select(name.alias(key), F.col("y").alias(label), point.alias(column), F.col("id").alias("original_event"))


def _alien_share(rows: DataFrame, k: int, key: str, label: str, column: str) -> DataFrame:
    """(key, label, alien, n): how many of a row's ``k`` nearest other rows, over all classes, are of another class."""
    found = nearest_rows(rows, rows, k + 1, key, label, column).where(F.col("other") != F.col(key))
    found = found.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("d", "other"))).where(F.col("_r") <= k)
    return found.join(rows.select(key, F.col(label).alias("_own")), key).groupBy(key).agg(F.count_if(F.col("y") != F.col("_own")).alias("alien"), F.count("*").alias("n"))


METHODS = ("SMOTE", "ADASYN", "SVMSMOTE", "SMOTEENN", "SMOTETomek")


def resample(rows: DataFrame, method: str = "SMOTE", k: int = 5, seed: int = 0, key: str = "object_id", label: str = "label", column: str = "features") -> DataFrame:
    """Rows and synthetic rows, (key, label, features, original_event), with the classes brought to one size.

    ADASYN draws rows by the share of their nearest that are of another class. SVMSMOTE draws rows within the margin of the
    kernel machine whose nearest are not all of another class. SMOTEENN takes rows out again that have one of another class among
    their three nearest, SMOTETomek pairs of different classes that are each other's nearest. Keys are distinct.
    """
    if method not in METHODS:
        raise ValueError(f"{method}: one of {METHODS}")
    plain = rows.select(F.col(key).cast("string").alias(key), label, F.col(column).cast("array<double>").alias(column))
    weights = None
    if method in ("ADASYN", "SVMSMOTE"):
        alien = materialised(_alien_share(plain, k, key, label, column))
        weights = alien.select(key, (F.col("alien") / F.col("n")).alias("weight"))
    if method == "SVMSMOTE":
        from fluxloom.operators.classify import KernelSvm

        machine = KernelSvm().fit(plain.select(key, F.col(label).alias("label"), F.col(column).alias("features")))
        told = machine.predict(plain.select(key, F.col(label).alias("label"), F.col(column).alias("features")), key)
        own = F.element_at("probability", F.array_position(F.array(*[F.lit(y) for y in machine.labels]), F.col("label")).cast("int"))
        inside = told.select(key, (own <= 1 / (1 + math.exp(-1.0))).alias("inside"))
        weights = weights.join(inside, key).select(key, (F.col("inside") & (F.col("weight") < 1)).cast("double").alias("weight"))
    made = smote(plain, k, seed, key, label, column, weights=weights)
    out = materialised(plain.withColumn("original_event", F.lit(None).cast("string")).unionByName(made))
    if method == "SMOTEENN":
        bad = _alien_share(out, 3, key, label, column).where("alien > 0")
        return out.join(bad.select(key), key, "left_anti")
    if method == "SMOTETomek":
        found = nearest_rows(out, out, 2, key, label, column).where(F.col("other") != F.col(key))
        first = found.groupBy(key).agg(F.min_by(F.struct("other", "y"), F.struct("d", "other")).alias("_f"))
        first = materialised(first.join(out.select(key, F.col(label).alias("_own")), key).select(F.col(key).alias("_a"), F.col("_f.other").alias("_b"), (F.col("_f.y") != F.col("_own")).alias("_apart")).where("_apart"))
        pairs = first.alias("p").join(first.alias("q"), (F.col("p._a") == F.col("q._b")) & (F.col("p._b") == F.col("q._a"))).select(F.col("p._a").alias(key))
        return out.join(pairs.distinct(), key, "left_anti")
    return out
