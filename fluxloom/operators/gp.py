"""Gaussian processes over light curves: kernels, fits, predictions.

The likelihood is maximised over log parameters in a box by a simplex search, so no derivative is needed and a failed
factorisation only costs a step. The searches of many objects go on side by side, with the covariances of curves of one length in
one array; each object's steps are those of a search by itself. Fit, prediction on a grid and any further step per object run in
one grouped function, as each grouped function shuffles anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.fit import Many, many_nelder_mead, nelder_mead
from fluxloom.runtime import dealt, in_groups
from fluxloom.schema import PASSBANDS

#: What is reported as the error where a predictive variance comes out negative.
BAD_ERROR = 666666.0


def matern32(r: np.ndarray) -> np.ndarray:
    s = np.sqrt(3.0) * r
    return (1 + s) * np.exp(-s)


def exp_squared(r2: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * r2)


def exp_sine2(delta: np.ndarray, gamma: float, log_period: float) -> np.ndarray:
    return np.exp(-gamma * np.sin(np.pi * delta / np.exp(log_period)) ** 2)


class Gp(NamedTuple):
    """A process conditioned on points: covariance function, points, factor and weights."""

    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]
    x: np.ndarray
    factor: np.ndarray
    weights: np.ndarray

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance."""
        cross = self.kernel(at, self.x)
        half = np.linalg.solve(self.factor, cross.T)
        own = np.array([self.kernel(at[i : i + 1], at[i : i + 1])[0, 0] for i in range(min(1, len(at)))])
        return cross @ self.weights, (own[0] if len(own) else 0.0) - (half * half).sum(axis=0)


def condition(kernel, x: np.ndarray, y: np.ndarray, e: np.ndarray) -> tuple[Gp, float]:
    """The process given noisy values, and its negative log likelihood."""
    k = kernel(x, x)
    k[np.diag_indices_from(k)] += e * e + 1e-10 * max(1e-30, k[0, 0])
    factor = np.linalg.cholesky(k)
    half = np.linalg.solve(factor, y)
    weights = np.linalg.solve(factor.T, half)
    return Gp(kernel, x, factor, weights), float(0.5 * half @ half + np.log(np.diag(factor)).sum() + 0.5 * len(y) * np.log(2 * np.pi))


def negative_log_likelihood(kernel, x: np.ndarray, y: np.ndarray, e: np.ndarray) -> float:
    """That of ``condition``, by one factorisation: the values are a last row beside the covariances, whose factor is L^-1 y."""
    n, noise = len(y), e * e
    k = np.zeros((n + 1, n + 1))
    k[:n, :n] = kernel(x, x)
    at = np.arange(n)
    noise = noise + 1e-10 * max(1e-30, k[0, 0])
    k[at, at] += noise
    k[n, :n] = y
    k[n, n] = 1 + 2 * float(y @ y) / float(noise.min())  # more than y K^-1 y; the row before it does not depend on it
    factor = np.linalg.cholesky(k)
    half = factor[n, :n]
    return float(0.5 * half @ half + np.log(np.diag(factor)[:n]).sum() + 0.5 * n * np.log(2 * np.pi))


def _maximised(make, start, low, high, x, y, e):
    """(parameters, process, converged): the best parameters, or the start where no step succeeds."""

    def cost(p: np.ndarray) -> float:
        try:
            return negative_log_likelihood(make(p), x, y, e)
        except np.linalg.LinAlgError:
            return 1e25

    found, value = nelder_mead(cost, np.asarray(start, float), np.asarray(low, float), np.asarray(high, float), 200, 1e-6)
    good = np.isfinite(value) and value < 1e24
    params = found if good else np.asarray(start, float)
    return params, condition(make(params), x, y, e)[0], bool(good)


#: A curve to fit: points (times, or times beside wavelengths), values and errors.
Curve = tuple[np.ndarray, np.ndarray, np.ndarray]


def _by_length(curves: Sequence[Curve]) -> Iterator[np.ndarray]:
    """The places of curves of one length."""
    sizes = np.array([len(c[1]) for c in curves], int)
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def in_batches(sizes: Sequence[int], most: int = 1 << 22) -> Iterator[range]:
    """Curves side by side whose covariances have ``most`` entries in all, or one that has more."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n * n > most:
            yield range(first, i)
            first, held = i, 0
        held += n * n
    if len(sizes) > first:
        yield range(first, len(sizes))


def _many_costs(curves: Sequence[Curve], apart: Callable, covariance: Callable, entries: int = 1 << 17) -> Many:
    """``negative_log_likelihood`` of many curves by place, 1e25 where the factorisation fails.

    ``apart`` takes pairs of points to what does not depend on the parameters, ``covariance`` these and parameters to covariances.
    Some ``entries`` of them are factored at once, so that they stay near the processor.
    """
    groups, group, place = [], np.empty(len(curves), int), np.empty(len(curves), int)
    for at in _by_length(curves):
        group[at], place[at] = len(groups), np.arange(len(at))
        x, y, e = (np.stack([curves[a][c] for a in at]) for c in range(3))
        i, j = np.tril_indices(y.shape[1])
        groups.append((apart(x[:, i], x[:, j]), i * (y.shape[1] + 1) + j, y, e * e, np.array([float(v @ v) for v in y])))

    def factored(k: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            out = np.full(k.shape, np.nan)
            for i, own in enumerate(k):
                try:
                    out[i] = np.linalg.cholesky(own)
                except np.linalg.LinAlgError:
                    out[i, 0, 0] = -1.0
            return out

    def some(g: int, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        parts, flat, y, noise, square = groups[g]
        n, m = y.shape[1], len(at)
        k = np.zeros((m, (n + 1) * (n + 1)))
        k[:, flat] = covariance([v[at] for v in parts], p)
        noise = noise[at] + 1e-10 * np.maximum(1e-30, k[:, :1])
        k[:, :: n + 2][:, :n] += noise
        k = k.reshape(m, n + 1, n + 1)
        k[:, n, :n] = y[at]
        k[:, n, n] = 1 + 2 * square[at] / noise.min(axis=1)
        factor = factored(k)
        half, own = factor[:, n, :n], np.diagonal(factor, axis1=1, axis2=2)[:, :n]
        failed = own[:, 0] < 0
        with np.errstate(invalid="ignore"):
            value = 0.5 * np.array([h @ h for h in half]) + np.log(own).sum(axis=1) + 0.5 * n * np.log(2 * np.pi)
        return np.where(failed, 1e25, value)

    def costs(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for g in np.unique(group[rows]):
            own = np.flatnonzero(group[rows] == g)
            for part in np.array_split(own, -(-len(own) * (groups[g][2].shape[1] + 1) ** 2 // entries)):
                out[part] = some(g, place[rows[part]], p[part])
        return out

    return costs


def _many_maximised(costs: Many, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, converged) of ``_maximised`` for each row."""
    found, value = many_nelder_mead(costs, start, low, high, 200, 1e-6)
    good = np.isfinite(value) & (value < 1e24)
    return np.where(good[:, None], found, start), good


def kernel_2d(log_amp: float, log_time: float, wavelength: float = 6000.0):
    """Matern-3/2 over (time, wavelength) with the given log variance and log squared time scale."""
    scale = np.exp(0.5 * log_time)

    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t, w = (a[:, None, 0] - b[None, :, 0]) / scale, (a[:, None, 1] - b[None, :, 1]) / wavelength
        return np.exp(log_amp) * matern32(np.sqrt(t * t + w * w))

    return k


def _box_2d(y: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, least and greatest parameters."""
    s2n = np.abs(y) / np.sqrt(e * e + (0.01 * y.max()) ** 2)
    scale = max(abs(float(y[s2n.argmax()])), 1e-6)
    start = np.array([2 * np.log(0.5 * scale), np.log(20.0**2)])
    return start, np.array([start[0] - 10, 0.0]), np.array([start[0] + 10, np.log(1000.0**2)])


def fit_2d(t: np.ndarray, wave: np.ndarray, y: np.ndarray, e: np.ndarray):
    """(log variance, log squared time scale), the process and whether the search succeeded."""
    return _maximised(lambda p: kernel_2d(p[0], p[1]), *_box_2d(y, e), np.column_stack([t, wave]), y, e)


def _apart_2d(a: np.ndarray, b: np.ndarray, wavelength: float = 6000.0) -> list[np.ndarray]:
    w = (a[..., 1] - b[..., 1]) / wavelength
    return [a[..., 0] - b[..., 0], w * w]


def _covariance_2d(parts: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Those of ``kernel_2d``; ``parts`` is written over."""
    s, w2 = parts
    s /= np.exp(0.5 * p[:, 1:])
    s *= s
    s += w2
    np.sqrt(s, out=s)
    s *= np.sqrt(3.0)
    k = np.exp(np.negative(s, out=w2), out=w2)
    s += 1
    k *= s
    k *= np.exp(p[:, :1])
    return k


def many_fit_2d(curves: Sequence[Curve]) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, converged) of ``fit_2d`` for each curve, whose points are (time, wavelength)."""
    start, low, high = (np.array(v).reshape(-1, 2) for v in zip(*[_box_2d(y, e) for _, y, e in curves], strict=True))
    return _many_maximised(_many_costs(curves, _apart_2d, _covariance_2d), start, low, high)


def kernel_1d(params: Sequence[float], periodic: bool):
    """A squared exponential of variance and squared length, with a periodic part where asked."""
    a, m = np.exp(params[0]), np.exp(params[1])

    def k(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        d = x[:, None] - z[None, :]
        out = a * exp_squared(d * d / m)
        return out + np.exp(params[2]) * exp_sine2(d, np.exp(params[3]), params[4]) if periodic else out

    return k


#: The five kernels in the order in which they are tried, as (variance, squared length) of the squared
#: exponential and, for the last two, (variance, gamma, log period) of the periodic part. The first is a parameter.
KERNELS_1D = ((500.0**2, 20.0**2), (400.0, 200.0), (400.0, 20.0), (400.0, 20.0, 4.0, 6.0, 6.0), (19.0, 9.0, 4.0, 6.0, 6.0))


def fit_1d(t: np.ndarray, y: np.ndarray, e: np.ndarray, kernel_param: tuple[float, float] = (500.0, 20.0), good: float = 2.0):
    """(kernel place, log parameters, process, converged, chi-square over points): the first kernel that fits, else the best."""
    best = None
    for i, values in enumerate(KERNELS_1D):
        values = (kernel_param[0] ** 2, kernel_param[1] ** 2) if i == 0 else values
        start = np.array([np.log(v) for v in values[:4]] + ([values[4]] if len(values) > 4 else []))
        params, gp, ok = _maximised(lambda p, n=len(values): kernel_1d(p, n > 2), start, start - 10, start + 10, t, y, e)
        chi = float((((y - gp.predict(t)[0]) / e) ** 2).mean())
        if best is None or chi < best[4]:
            best = (i, params, gp, ok, chi)
        if chi <= good:
            break
    return best


def _covariance_1d(parts: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Those of ``kernel_1d``."""
    (d,) = parts
    own = np.exp(p)[:, :, None]
    k = own[:, 0] * exp_squared(d * d / own[:, 1])
    if p.shape[1] > 2:
        k += own[:, 2] * np.exp(-own[:, 3] * np.sin(np.pi * d / own[:, 4]) ** 2)
    return k


def many_fit_1d(curves: Sequence[Curve], kernel_param: tuple[float, float] = (500.0, 20.0), good: float = 2.0) -> list[tuple]:
    """``fit_1d`` for each curve, whose points are times."""
    best: list[tuple | None] = [None] * len(curves)
    left = np.arange(len(curves))
    for i, values in enumerate(KERNELS_1D):
        if not len(left):
            break
        values = (kernel_param[0] ** 2, kernel_param[1] ** 2) if i == 0 else values
        start = np.tile([np.log(v) for v in values[:4]] + ([values[4]] if len(values) > 4 else []), (len(left), 1))
        own = [curves[c] for c in left]
        params, ok = _many_maximised(_many_costs(own, lambda a, b: [a - b], _covariance_1d), start, start - 10, start + 10)
        on = []
        for c, (t, y, e), p, converged in zip(left, own, params, ok, strict=True):
            gp, _ = condition(kernel_1d(p, len(p) > 2), t, y, e)
            chi = float((((y - gp.predict(t)[0]) / e) ** 2).mean())
            if best[c] is None or chi < best[c][4]:
                best[c] = (i, p, gp, bool(converged), chi)
            on.append(not chi <= good)
        left = left[np.array(on, bool)]
    return best


GP_SCHEMA = "filter string, grid_ix int, mjd double, flux double, flux_error double, kernel int, params array<double>, converged boolean, status string"


def fit_gps(obs: DataFrame, number_gp: int = 100, t_min: float = 0.0, t_max: float = 278.0, gp_dim: int = 2, filters: Sequence[str] = (), subtract_background: bool = False, kernel_param: tuple[float, float] = (500.0, 20.0), key: str = "object_id", wavelengths: Mapping[str, float] = PASSBANDS) -> DataFrame:
    """Fit every object and predict on ``number_gp`` times from ``t_min`` to ``t_max`` in every band.

    A row per grid point, with the parameters. An object that cannot be fitted gives one row with its status. With one
    dimension a band without data is zero on the grid.
    """
    if subtract_background:
        from fluxloom.operators.stats import subtract_background as subtracted

        obs = subtracted(obs, key)
    kind = dict(obs.dtypes)[key]
    grid = np.linspace(t_min, t_max, number_gp)
    names = list(filters)

    def tried(function: Callable, curves: list):
        """``function`` of all curves at once or, where one cannot be fitted, of each by itself: results or errors."""
        try:
            return list(function(curves))
        except (ValueError, np.linalg.LinAlgError):
            out = []
            for c in curves:
                try:
                    out += function([c])
                except (ValueError, np.linalg.LinAlgError) as problem:
                    out.append(problem)
            return out

    def processes(curves: list) -> list:
        params, ok = many_fit_2d(curves)
        return [(0, p, condition(kernel_2d(p[0], p[1]), x, y, e)[0], o) for (x, y, e), p, o in zip(curves, params, ok, strict=True)]

    def fitted(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        ends, kinds = np.append(starts[1:], table.num_rows), table.schema.field(key).type
        for part in in_batches(ends - starts):
            yield from _told(table, [(int(starts[i]), int(ends[i])) for i in part], kinds)

    def _told(table: pa.Table, spans: list[tuple[int, int]], kinds: pa.DataType) -> Iterator[pa.Table]:
        first = spans[0][0]
        held = table.slice(first, spans[-1][1] - first).select(["filter", "mjd", "flux", "flux_error"]).to_pandas()
        band, (t, y, e) = held["filter"].to_numpy(object), (held[c].to_numpy(float) for c in ("mjd", "flux", "flux_error"))
        wave = held["filter"].map(wavelengths).to_numpy(float)
        curves, own, bands, failed = [], [], [], {}
        for o, (a, z) in enumerate((a - first, z - first) for a, z in spans):
            at = a + np.flatnonzero(e[a:z] != 0)
            bands.append(sorted(names or pd.unique(band[a:z]).tolist(), key=lambda f: wavelengths.get(f, 0.0)))
            if not len(at):
                failed[o] = ValueError("no usable observation")
            elif gp_dim == 2:
                curves.append((np.column_stack([t[at], wave[at]]), y[at], e[at]))
                own.append((o, None))
            else:
                for b in bands[o]:
                    one = at[band[at] == b]
                    if len(one):
                        curves.append((t[one], y[one], e[one]))
                        own.append((o, b))
        got = {}
        for who, what in zip(own, tried(processes if gp_dim == 2 else (lambda c: many_fit_1d(c, kernel_param)), curves) if curves else [], strict=True):
            if isinstance(what, Exception):
                failed.setdefault(who[0], what)
            got[who] = what
        rows, mean, var = [], [], []  # (object, band, kernel, parameters, converged) for each grid
        for o in range(len(spans)):
            if o in failed:
                continue
            if gp_dim == 2:
                i, params, gp, ok = got[o, None]
                if not bands[o]:
                    continue
                at = [gp.predict(np.column_stack([np.tile(grid, len(bands[o])), np.repeat([wavelengths[b] for b in bands[o]], len(grid))]))]
                rows += [(o, b, i, params, ok) for b in bands[o]]
            else:
                one = [got.get((o, b)) for b in bands[o]]
                at = [g[2].predict(grid) if g else (np.zeros(len(grid)), np.zeros(len(grid))) for g in one]
                rows += [(o, b, g[0], g[1], g[3]) if g else (o, b, -1, np.zeros(0), True) for b, g in zip(bands[o], one, strict=True)]
            mean += [m for m, _ in at]
            var += [v for _, v in at]
        n = len(grid)
        id_of = lambda objects: table[key].take(pa.array([spans[o][0] for o in objects], pa.int64())).combine_chunks()
        if rows:
            each, v = pa.array(np.repeat(np.arange(len(rows)), n)), np.concatenate(var)
            long = lambda values: values.take(each)
            yield pa.table({
                key: long(id_of([r[0] for r in rows])), "filter": long(pa.array([r[1] for r in rows], pa.string())), "grid_ix": pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows))), "mjd": pa.array(np.tile(grid, len(rows))),
                "flux": pa.array(np.concatenate(mean)), "flux_error": pa.array(np.where(v >= 0, np.sqrt(np.maximum(v, 0)), BAD_ERROR)), "kernel": long(pa.array([r[2] for r in rows], pa.int32())),
                "params": long(pa.array([r[3].tolist() for r in rows], pa.list_(pa.float64()))), "converged": long(pa.array([bool(r[4]) for r in rows])), "status": pa.array(["ok"] * n * len(rows)),
            })
        if failed:
            none = lambda kind: pa.nulls(len(failed), kind)
            yield pa.table({key: id_of(failed), "filter": none(pa.string()), "grid_ix": none(pa.int32()), "mjd": none(pa.float64()), "flux": none(pa.float64()), "flux_error": none(pa.float64()), "kernel": none(pa.int32()), "params": none(pa.list_(pa.float64())), "converged": pa.array([False] * len(failed)), "status": pa.array([f"failed: {problem}" for problem in failed.values()])})

    rows = obs.select(key, "filter", *[F.col(c).cast("double").alias(c) for c in ("mjd", "flux", "flux_error")])
    return in_groups(rows, [key], fitted, f"{key} {kind}, {GP_SCHEMA}", ["mjd", "filter", "flux", "flux_error"])


def models_of(fits: DataFrame, key: str = "object_id") -> DataFrame:
    return fits.where("status = 'ok'").select(key, "filter", "grid_ix", "mjd", "flux", "flux_error")


def params_of(fits: DataFrame, key: str = "object_id") -> DataFrame:
    """One row per object (two dimensions) or per object and band (one)."""
    return fits.where("status = 'ok' AND grid_ix = 0").select(key, "filter", "kernel", "params", "converged")


def predict_2d(obs: DataFrame, params: DataFrame, times: Sequence[float], filters: Sequence[str], key: str = "object_id", wavelengths: Mapping[str, float] = PASSBANDS) -> DataFrame:
    """Predictions at given times from saved parameters and the observations: no process is pickled."""
    kind, at = dict(obs.dtypes)[key], np.asarray(times, float)

    def predicted(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["flux_error"] != 0]
        if not len(rows) or not len(fits):
            return pd.DataFrame(columns=[key, "filter", "mjd", "flux", "flux_error"])
        p = fits["params"].iloc[0]
        x = np.column_stack([rows["mjd"], rows["filter"].map(wavelengths)]).astype(float)
        gp, _ = condition(kernel_2d(p[0], p[1]), x, rows["flux"].to_numpy(float), rows["flux_error"].to_numpy(float))
        parts = []
        for f in filters:
            mean, var = gp.predict(np.column_stack([at, np.full(len(at), wavelengths[f])]))
            parts.append(pd.DataFrame({key: rows[key].iloc[0], "filter": f, "mjd": at, "flux": mean, "flux_error": np.sqrt(np.maximum(var, 0))}))
        return pd.concat(parts)

    one = params.dropDuplicates([key]).select(key, "params")
    left = dealt(obs.select(key, "filter", "mjd", "flux", "flux_error"), key).groupBy(key)
    return left.cogroup(dealt(one, key).groupBy(key)).applyInPandas(predicted, f"{key} {kind}, filter string, mjd double, flux double, flux_error double")


def peak_times(obs: DataFrame, params: DataFrame, filters: Sequence[str], before: float = 105.0, after: float = 300.0, key: str = "object_id", wavelengths: Mapping[str, float] = PASSBANDS) -> DataFrame:
    """(key, peak_mjd): the day of the highest modelled flux in any band, the first on ties.

    Days run from ``before`` days before an object's first detection to ``after`` days after its last; an object without a
    detection has no row. The process is made again from its parameters and the observations.
    """
    kind = dict(obs.dtypes)[key]

    def found(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        seen = rows[rows["detected"].astype(bool)]["mjd"] if len(rows) else []
        rows = rows[rows["flux_error"] != 0]
        if not len(rows) or not len(fits) or not len(seen):
            return pd.DataFrame(columns=[key, "peak_mjd"])
        p, days = fits["params"].iloc[0], np.arange(seen.min() - before, seen.max() + after + 1)
        x = np.column_stack([rows["mjd"], rows["filter"].map(wavelengths)]).astype(float)
        gp, _ = condition(kernel_2d(p[0], p[1]), x, rows["flux"].to_numpy(float), rows["flux_error"].to_numpy(float))
        flux = np.stack([gp.kernel(np.column_stack([days, np.full(len(days), wavelengths[f])]), gp.x) @ gp.weights for f in filters]).max(axis=0)
        return pd.DataFrame({key: [rows[key].iloc[0]], "peak_mjd": [float(days[flux.argmax()])]})

    one = params.dropDuplicates([key]).select(key, "params")
    left = dealt(obs.select(key, "filter", "mjd", "flux", "flux_error", "detected"), key).groupBy(key)
    return left.cogroup(dealt(one, key).groupBy(key)).applyInPandas(found, f"{key} {kind}, peak_mjd double")


def reconstruction_error(models: DataFrame, restored: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, error): chi-square over points of a restored model (key, filter, grid_ix, flux) against the model.

    The join is a shuffled one: sizes estimated before rows are exploded leave out the points, so that a table of all
    points would be broadcast.
    """
    other = restored.select(key, "filter", "grid_ix", F.col("flux").alias("_r"))
    part = (F.col("flux") - F.col("_r")) / F.nullif("flux_error", F.lit(0.0))
    return models.join(other.hint("merge"), [key, "filter", "grid_ix"]).groupBy(key).agg(F.avg(part * part).alias("error"))
