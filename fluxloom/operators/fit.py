"""Fits of parametric and template models, object by object."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions import curves as C
from fluxloom.runtime import dealt, in_groups, lists

MODELS = {"newling": (C.NEWLING, C.newling), "karpenka": (C.KARPENKA, C.karpenka)}


def _newling(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    amp, phi, sigma, k, psi = np.exp(p[0]), p[1], np.exp(p[2]), np.exp(p[3]), np.exp(p[4])
    since = np.asarray(t - phi)
    delta = np.maximum(since / sigma, 1e-300)
    u = since / (k * sigma)
    u = np.minimum(np.maximum(u, 0, out=u), 1, out=u)
    pulse = np.log(delta)
    pulse *= k
    pulse -= delta
    pulse -= k * np.log(k)
    pulse += k
    np.minimum(np.maximum(pulse, -700, out=pulse), 700, out=pulse)
    np.exp(pulse, out=pulse)
    pulse *= amp
    return np.where(t > phi, pulse + psi * u * u * (3 - 2 * u), 0.0)


def _karpenka(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    rise, fall = np.maximum(p[4], 1e-3), np.maximum(p[5], 1e-3)
    since = t - p[2]
    shape = np.exp(np.clip(-since / fall - np.logaddexp(0, -since / rise), -700, 700))
    return np.exp(p[0]) * (1 + np.exp(p[1]) * (t - p[3]) ** 2) * shape


CURVES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"newling": _newling, "karpenka": _karpenka}


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 400, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Minimise ``f`` in a box by a simplex whose points are clipped to it."""
    n = len(start)
    x = np.vstack([start] + [np.where(np.arange(n) == i, np.where(start + 0.1 * (high - low) <= high, start + 0.1 * (high - low), start - 0.1 * (high - low)), start) for i in range(n)])
    y = np.array([f(p) for p in x])
    for _ in range(steps):
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        if y[-1] - y[0] <= tol * (abs(y[0]) + tol):
            break
        centre = x[:-1].mean(axis=0)
        move = lambda a: np.clip(centre + a * (x[-1] - centre), low, high)  # noqa: B023,E731
        p = move(-1.0)
        v = f(p)
        if v < y[0]:
            q = move(-2.0)
            w = f(q)
            x[-1], y[-1] = (q, w) if w < v else (p, v)
        elif v < y[-2]:
            x[-1], y[-1] = p, v
        else:
            q = move(-0.5 if v < y[-1] else 0.5)
            w = f(q)
            if w < min(v, y[-1]):
                x[-1], y[-1] = q, w
            else:
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                y[1:] = [f(p) for p in x[1:]]
    best = int(np.argmin(y))
    return x[best], float(y[best])


#: Of some rows, by place, the values at one point each.
Many = Callable[[np.ndarray, np.ndarray], np.ndarray]


def many_nelder_mead(f: Many, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 400, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """``nelder_mead`` for each row of ``start``, ``low`` and ``high``, step by step for all that have not ended."""
    m, n = start.shape
    up = start + 0.1 * (high - low)
    first = np.where(up <= high, up, start - 0.1 * (high - low))
    x = np.repeat(start[:, None], n + 1, axis=1)
    i = np.arange(n)
    x[:, i + 1, i] = first
    live = np.arange(m)
    y = np.stack([f(live, x[:, j]) for j in range(n + 1)], axis=1)
    best, value = np.empty_like(start), np.empty(m)
    for _ in range(steps):
        order = np.argsort(y, axis=1, kind="stable")
        x, y = np.take_along_axis(x, order[..., None], axis=1), np.take_along_axis(y, order, axis=1)
        ended = y[:, -1] - y[:, 0] <= tol * (np.abs(y[:, 0]) + tol)
        if ended.any():
            best[live[ended]], value[live[ended]] = x[ended, 0], y[ended, 0]
            x, y, live = x[~ended], y[~ended], live[~ended]
            if not len(live):
                return best, value
        a, b = low[live], high[live]
        centre = x[:, :-1].mean(axis=1)
        p = np.clip(centre - (x[:, -1] - centre), a, b)
        v = f(live, p)
        further = v < y[:, 0]
        taken = further | (v < y[:, -2])
        old = y[:, -1].copy()
        at = np.flatnonzero(further | ~taken)
        shrunk = np.zeros(len(live), bool)
        q, w = p, v
        if len(at):
            pace = np.where(further[at], -2.0, np.where(v[at] < old[at], -0.5, 0.5))
            q, w = p.copy(), v.copy()
            q[at] = np.clip(centre[at] + pace[:, None] * (x[at, -1] - centre[at]), a[at], b[at])
            w[at] = f(live[at], q[at])
            better = np.where(further, w < v, w < np.where(old < v, old, v))
            shrunk = ~taken & ~better
            use = (further | ~taken) & better
            p, v = np.where(use[:, None], q, p), np.where(use, w, v)
        put = ~shrunk
        x[put, -1], y[put, -1] = p[put], v[put]
        if shrunk.any():
            x[shrunk, 1:] = x[shrunk, :1] + 0.5 * (x[shrunk, 1:] - x[shrunk, :1])
            for j in range(1, n + 1):
                y[shrunk, j] = f(live[shrunk], x[shrunk, j])
    at = y.argmin(axis=1)
    best[live], value[live] = x[np.arange(len(live)), at], y[np.arange(len(live)), at]
    return best, value


def _seed(*parts) -> int:
    import zlib

    return zlib.crc32(":".join(map(str, parts)).encode())


def _least_squares(curve, t, y, e, start, low, high, attempts, seed):
    chi = lambda p: float(np.sum(((y - curve(t, p)) / e) ** 2))
    rng = np.random.default_rng(seed)
    best, value = nelder_mead(chi, start, low, high)
    for _ in range(attempts - 1):
        if value / len(t) < 2:
            break
        found, v = nelder_mead(chi, rng.uniform(low, high), low, high)
        if v < value:
            best, value = found, v
    return best, value


def _ensemble(curve, t, y, e, start, low, high, attempts, seed, walkers=24, rounds=200, chain=None):
    """Affine-invariant sampling under a uniform prior on the box; the likeliest sample. ``chain`` takes every step's points."""
    rng = np.random.default_rng(seed)
    log = lambda p: -0.5 * float(np.sum(((y - curve(t, p)) / e) ** 2)) if np.all((p >= low) & (p <= high)) else -np.inf
    x = np.clip(start + 0.05 * (high - low) * rng.standard_normal((walkers, len(start))), low, high)
    v = np.array([log(p) for p in x])
    best, top = x[v.argmax()].copy(), v.max()
    for _ in range(rounds):
        for i in range(walkers):
            j = (i + 1 + rng.integers(walkers - 1)) % walkers
            z = (1 + rng.random()) ** 2 / 2
            p = x[j] + z * (x[i] - x[j])
            w = log(p)
            if np.log(rng.random()) < (len(start) - 1) * np.log(z) + w - v[i]:
                x[i], v[i] = p, w
                if w > top:
                    best, top = p.copy(), w
        if chain is not None:
            chain.append((x.copy(), v.copy()))
    return best, -2 * top


def _nested(curve, t, y, e, start, low, high, attempts, seed, live=60, rounds=1500):
    """Nested sampling with shrinking steps from live points; the likeliest point."""
    rng = np.random.default_rng(seed)
    log = lambda p: -0.5 * float(np.sum(((y - curve(t, p)) / e) ** 2))
    x = rng.uniform(low, high, (live, len(start)))
    x[0] = start
    v = np.array([log(p) for p in x])
    for _ in range(rounds):
        worst = int(v.argmin())
        spread = x.std(axis=0) + 1e-6 * (high - low)
        if v.max() - v.min() < 1e-4:
            break
        scale = 1.0
        for _ in range(20):
            p = np.clip(x[rng.integers(live)] + scale * spread * rng.standard_normal(len(start)), low, high)
            w = log(p)
            if w > v[worst]:
                x[worst], v[worst] = p, w
                break
            scale *= 0.7
        else:
            break
    best = int(v.argmax())
    return x[best], -2 * v[best]


SAMPLERS = {"leastsq": _least_squares, "mcmc": _ensemble, "nested": _nested}


def _many_least_squares(chi: Many, points: int | np.ndarray, start, low, high, attempts, seeds):
    """``_least_squares`` of many rows."""
    best, value = many_nelder_mead(chi, start, low, high)
    draws = [np.random.default_rng(s) for s in seeds] if attempts > 1 else []
    left, points = np.arange(len(start)), np.broadcast_to(points, len(start))
    for _ in range(attempts - 1):
        left = left[~(value[left] / points[left] < 2)]
        if not len(left):
            break
        begin = np.array([draws[i].uniform(low[i], high[i]) for i in left])
        found, v = many_nelder_mead(lambda rows, p: chi(left[rows], p), begin, low[left], high[left])  # noqa: B023
        good = v < value[left]
        best[left[good]], value[left[good]] = found[good], v[good]
    return best, value


def _pairs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the upper halves of words, as draws of ``Generator.integers`` take them one after the other."""
    return raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)


def _place(half: np.ndarray, count: int) -> np.ndarray:
    """A place below ``count`` from 32 random bits."""
    return ((half * np.uint64(count)) >> np.uint64(32)).astype(int)


def _many_ensemble(chi: Many, points: int, start, low, high, attempts, seeds, walkers=24, rounds=200, chain=None):
    """``_ensemble`` of many rows, with the same draws: each row's are taken in one block, two moves from five words."""
    m, n = start.shape
    moves = walkers * rounds
    x, raw = np.empty((m, walkers, n)), np.empty((m, -(-moves // 2), 5), np.uint64)
    for i, s in enumerate(seeds):
        rng = np.random.default_rng(s)
        x[i] = np.clip(start[i] + 0.05 * (high[i] - low[i]) * rng.standard_normal((walkers, n)), low[i], high[i])
        raw[i] = rng.bit_generator.random_raw(raw[i].size).reshape(-1, 5)
    unit = lambda word: (word >> np.uint64(11)) * (1.0 / 9007199254740992.0)
    partner = np.stack([_place(h, walkers - 1) for h in _pairs(raw[:, :, 0])], axis=2).reshape(m, -1)
    reach = (1 + unit(raw[:, :, [1, 3]]).reshape(m, -1)) ** 2 / 2
    with np.errstate(divide="ignore"):
        need, gain = np.log(unit(raw[:, :, [2, 4]]).reshape(m, -1)), (n - 1) * np.log(reach)
    del raw
    rows = np.arange(m)

    def log(p: np.ndarray) -> np.ndarray:
        inside = np.flatnonzero(((p >= low) & (p <= high)).all(axis=1))
        out = np.full(m, -np.inf)
        out[inside] = -0.5 * chi(inside, p[inside])
        return out

    v = np.stack([log(x[:, w]) for w in range(walkers)], axis=1)
    best, top = x[rows, v.argmax(axis=1)], v.max(axis=1)
    for move in range(moves):
        i = move % walkers
        other = x[rows, (i + 1 + partner[:, move]) % walkers]
        p = other + reach[:, move, None] * (x[:, i] - other)
        w = log(p)
        with np.errstate(invalid="ignore"):
            taken = need[:, move] < gain[:, move] + w - v[:, i]
        x[taken, i], v[taken, i] = p[taken], w[taken]
        better = taken & (w > top)
        best[better], top[better] = p[better], w[better]
        if chain is not None and i == walkers - 1:
            chain.append((x.copy(), v.copy()))
    return best, -2 * top


def _many_nested(chi: Many, points: int, start, low, high, attempts, seeds, live=60, rounds=1500):
    """``_nested`` of many rows with the same draws, two tries' at a time; a row goes on to its next try by itself."""
    m, n = start.shape
    draws = [np.random.default_rng(s) for s in seeds]
    x = np.stack([g.uniform(a, b, (live, n)) for g, a, b in zip(draws, low, high, strict=True)], axis=1)  # points before rows: their sums run over rows
    x[0] = start
    v = np.stack([-0.5 * chi(np.arange(m), x[j]) for j in range(live)], axis=1)
    done, tries, scale, at = np.zeros(m, int), np.zeros(m, int), np.ones(m), np.arange(m)
    floor = 1e-6 * (high - low)
    worst, spread = v.argmin(axis=1), x.std(axis=0) + floor
    at = at[~(v.max(axis=1) - v.min(axis=1) < 1e-4)]
    word, normal = np.empty(m, np.uint64), np.empty((m, 2, n))
    words, normals, places = [g.bit_generator.random_raw for g in draws], [g.standard_normal for g in draws], list(normal)
    turn = 0
    while len(at):
        if turn % 2 == 0:  # all rows that go on have made the same number of tries
            ids = at.tolist()
            word[at] = [words[i]() for i in ids]
            for i in ids:
                normals[i](out=places[i])
        half = _pairs(word[at])[turn % 2]
        below, above = low[at], high[at]
        p = x[_place(half, live), at] + scale[at, None] * spread[at] * normal[at, turn % 2]
        p = np.minimum(np.maximum(p, below, out=p), above, out=p)
        w = -0.5 * chi(at, p)
        turn += 1
        good = w > v[at, worst[at]]
        won, lost = at[good], at[~good]
        x[worst[won], won], v[won, worst[won]] = p[good], w[good]
        own = v.take(won, axis=0)
        worst[won], spread[won], scale[won], tries[won] = own.argmin(axis=1), x.take(won, axis=1).std(axis=0) + floor[won], 1.0, 0
        done[won] += 1
        scale[lost] *= 0.7
        tries[lost] += 1
        over = (done[at] >= rounds) | (tries[at] >= 20)
        over[good] |= own.max(axis=1) - v[won, worst[won]] < 1e-4
        at = at[~over]
    best = v.argmax(axis=1)
    return x[best, np.arange(m)], -2 * v[np.arange(m), best]


MANY = {"leastsq": _many_least_squares, "mcmc": _many_ensemble, "nested": _many_nested}


class Bands(NamedTuple):
    """Bands, shorter ones first: their names as Arrow columns and as values, their numbers of points, and chi-squares by place."""

    names: dict
    ids: list
    points: np.ndarray
    chi: Many
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _batches(lengths: np.ndarray, most: int, points: int = 1 << 20) -> Iterator[slice]:
    """Bands side by side, ``lengths`` rising: ``most`` at most, which hold ``points`` once filled up to the longest, or one band."""
    first = 0
    while first < len(lengths):
        last = min(first + most, len(lengths))
        while last - first > 1 and (last - first) * lengths[last - 1] > points:
            last = first + (last - first + 1) // 2
        yield slice(first, last)
        first = last


def _many_chi(curve, lengths: np.ndarray, t: np.ndarray, y: np.ndarray, e: np.ndarray, block: int = 256) -> Many:
    """Chi-squares of bands by place. Bands of rising ``lengths`` are rows of ``t``, ``y`` and ``e``, filled up behind; ``block`` rows are
    taken at once, of which each sum is over a band's own points.
    """

    def chi(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for a in range(0, len(rows), block):
            own = rows[a : a + block]
            sizes = lengths[own]
            n = sizes[-1]
            part = y.take(own, axis=0)[:, :n] - curve(t.take(own, axis=0)[:, :n], np.ascontiguousarray(p[a : a + block].T)[:, :, None])
            part /= e.take(own, axis=0)[:, :n]
            part *= part
            cuts = np.flatnonzero(sizes[1:] != sizes[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                part[i:j, : sizes[i]].sum(axis=1, out=out[a + i : a + j])
        return out

    return chi


def _by_band(obs: DataFrame, key: str, curve, bounds: Mapping, function: Callable[[Bands], dict], columns: str, most: int) -> DataFrame:
    """``function`` over bands, at most ``most`` at once: the columns (key, filter, ``columns``)."""
    low, high, start = (np.array([b[i] for b in bounds.values()], float) for i in range(3))

    def run(table: pa.Table, starts: np.ndarray):
        t, y, e = (table[c].to_numpy() for c in ("mjd", "flux", "flux_error"))
        sizes = np.diff(np.append(starts, table.num_rows))
        order = np.argsort(sizes, kind="stable")
        for part in _batches(sizes[order], most):
            groups = order[part]
            names = {c: table[c].take(pa.array(starts[groups])).combine_chunks() for c in (key, "filter")}
            lengths = sizes[groups]
            at = starts[groups][:, None] + np.minimum(np.arange(lengths[-1]), lengths[:, None] - 1)  # filled up with the last point
            each = lambda v, n=len(groups): np.tile(v, (n, 1))
            bands = Bands(names, list(zip(names[key].to_pylist(), names["filter"].to_pylist(), strict=True)), lengths, _many_chi(curve, lengths, t[at], y[at], e[at]), each(start), each(low), each(high))
            with np.errstate(over="ignore", invalid="ignore"):
                yield pa.table(function(bands))

    rows = obs.where(~F.col("flux_error").eqNullSafe(F.lit(0.0))).select(key, "filter", *[F.col(c).cast("double").alias(c) for c in ("mjd", "flux", "flux_error")])
    return in_groups(rows, [key, "filter"], run, f"{key} {dict(obs.dtypes)[key]}, filter string, {columns}", ["mjd", "flux", "flux_error"])


def fit_parametric(obs: DataFrame, model: str = "newling", sampler: str = "leastsq", attempts: int = 5, seed: int = 0, key: str = "object_id", limits: Mapping[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(key, filter, params, chisq, n_points, status): one fit per object and band.

    A band with no usable point has no row; ``fit_table`` fills it with zeros.
    """
    curve, run = CURVES[model], MANY[sampler]

    def fitted(b: Bands) -> dict:
        p, c = run(b.chi, b.points, b.start, b.low, b.high, attempts, [_seed(seed, *i) for i in b.ids])
        return {**b.names, "params": lists(p), "chisq": pa.array(c), "n_points": pa.array(b.points.astype(np.int32)), "status": pa.array(["ok"] * len(c))}

    return _by_band(obs, key, curve, limits or MODELS[model][0], fitted, "params array<double>, chisq double, n_points int, status string", 256 if sampler == "mcmc" else 1024)


def sample_chains(obs: DataFrame, model: str = "newling", rounds: int = 200, walkers: int = 24, seed: int = 0, key: str = "object_id", limits: Mapping[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(key, filter, step, walker, params, log_likelihood): the chains of the ensemble sampler, one row per sampled point."""

    def sampled(b: Bands) -> dict:
        chain = []
        _many_ensemble(b.chi, b.points, b.start, b.low, b.high, 1, [_seed(seed, *i) for i in b.ids], walkers, rounds, chain)
        m, n = b.start.shape
        each = np.repeat(np.arange(m), rounds * walkers)
        x = np.stack([p for p, _ in chain], axis=1).reshape(-1, n) if chain else np.empty((0, n))
        v = np.stack([w for _, w in chain], axis=1).ravel() if chain else np.empty(0)
        step, walker = (np.tile(i.ravel().astype(np.int32), m) for i in np.indices((rounds, walkers)))
        return {**{c: a.take(pa.array(each)) for c, a in b.names.items()}, "step": pa.array(step), "walker": pa.array(walker), "params": lists(x), "log_likelihood": pa.array(v)}

    return _by_band(obs, key, CURVES[model], limits or MODELS[model][0], sampled, "step int, walker int, params array<double>, log_likelihood double", 256)


class NestedRun(NamedTuple):
    """Points with their log likelihoods and normalised weights, the log evidence and its error, and the information gained."""

    points: np.ndarray
    log_likelihood: np.ndarray
    weight: np.ndarray
    log_evidence: float
    error: float
    information: float


def nested_run(log: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray, live: int = 100, steps: int = 25, seed: int = 0, rest: float = 0.01, most: int = 50_000) -> NestedRun:
    """Nested sampling of a likelihood under a uniform prior on a box.

    The worst of the live points leaves with the share of prior volume that its likelihood marks off, about 1 / live of what is left;
    a walk of ``steps`` steps from another live point, above that likelihood, takes its place. It ends once the live points could
    raise the log evidence by less than ``rest``; they then share the volume that is left.
    """
    rng, width = np.random.default_rng(seed), len(low)
    x = rng.uniform(low, high, (live, width))
    v = np.array([log(p) for p in x])
    gone, values, logs, evidence, scale = [], [], [], -np.inf, 1.0
    shell = np.log(-np.expm1(-1.0 / live))  # the log of the share that leaves
    for i in range(most):
        worst = int(v.argmin())
        mark = v[worst]
        gone.append(x[worst].copy())
        values.append(mark)
        logs.append(mark - i / live + shell)
        evidence = np.logaddexp(evidence, logs[-1])
        if v.max() - (i + 1) / live < evidence + np.log(np.expm1(rest)) or v.max() - mark < 1e-12:
            break
        start = int(rng.integers(live - 1))
        start += start >= worst
        p, w, spread, taken = x[start].copy(), v[start], x.std(axis=0) + 1e-9 * (high - low), 0
        for _ in range(steps):
            q = p + scale * spread * rng.standard_normal(width)
            if np.all((q >= low) & (q <= high)) and (u := log(q)) > mark:
                p, w, taken = q, u, taken + 1
        scale *= np.exp((taken / steps - 0.4) * 0.3)
        x[worst], v[worst] = p, w
    else:
        i = most - 1
    # the live points, without the one that has just left, share the rest
    left = np.arange(live) != int(v.argmin())
    logs += (v[left] - (i + 1) / live - np.log(left.sum())).tolist()
    values, points = np.array([*values, *v[left]]), np.array([*gone, *x[left]])
    logs = np.array(logs)
    evidence = float(np.logaddexp.reduce(logs))
    weight = np.exp(logs - evidence)
    information = max(0.0, float((weight * values).sum()) - evidence)
    return NestedRun(points, values, weight, evidence, float(np.sqrt(information / live)), information)


def many_nested_runs(chi: Many, low: np.ndarray, high: np.ndarray, seeds: Sequence[int], live: int = 100, steps: int = 25, rest: float = 0.01, most: int = 50_000) -> list[NestedRun]:
    """``nested_run`` of many rows with the same draws, those of two rounds at a time; ``chi`` is -2 times the log likelihood."""
    draws, (m, n) = [np.random.default_rng(s) for s in seeds], low.shape
    x = np.stack([g.uniform(a, b, (live, n)) for g, a, b in zip(draws, low, high, strict=True)], axis=1)
    v = np.stack([-0.5 * chi(np.arange(m), x[j]) for j in range(live)], axis=1)
    words, normals = [g.bit_generator.random_raw for g in draws], [g.standard_normal for g in draws]
    evidence, scale, ended, at = np.full(m, -np.inf), np.ones(m), np.full(m, most - 1), np.arange(m)
    word, normal, history = np.empty(m, np.uint64), np.empty((m, 2, steps, n)), []
    shell, room, places = np.log(-np.expm1(-1.0 / live)), np.log(np.expm1(rest)), list(normal)
    for i in range(most):
        worst = v[at].argmin(axis=1)
        mark = v[at, worst]
        logs = mark - i / live + shell
        history.append((at, x[worst, at], mark, logs))
        evidence[at] = np.logaddexp(evidence[at], logs)
        top = v[at].max(axis=1)
        over = (top - (i + 1) / live < evidence[at] + room) | (top - mark < 1e-12)
        ended[at[over]] = i
        at, worst, mark = at[~over], worst[~over], mark[~over]
        if not len(at):
            break
        if i % 2 == 0:
            ids = at.tolist()
            word[at] = [words[r]() for r in ids]
            for r in ids:
                normals[r](out=places[r])
        start = _place(_pairs(word[at])[i % 2], live - 1)
        start += start >= worst
        below, above = low[at], high[at]
        p, w, taken = x[start, at], v[at, start], np.zeros(len(at), int)
        pace, drawn = scale[at, None] * (x.take(at, axis=1).std(axis=0) + 1e-9 * (above - below)), normal[at, i % 2]
        for step in range(steps):
            q = p + pace * drawn[:, step]
            inside = np.flatnonzero(np.logical_and.reduce(((q >= below) & (q <= above)).T))
            u = -0.5 * chi(at.take(inside), q.take(inside, axis=0))
            good = u > mark.take(inside)
            to = inside[good]
            p[to], w[to] = q[to], u[good]
            taken[to] += 1
        scale[at] *= np.exp((taken / steps - 0.4) * 0.3)
        x[worst, at], v[at, worst] = p, w
    row, points, values, logs = (np.concatenate(c) for c in zip(*history, strict=True))
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=m))[:-1]
    out = []
    for r, own in enumerate(np.split(order, ends)):
        # the live points, without the one that has just left, share the rest
        left = np.arange(live) != int(v[r].argmin())
        mine = np.concatenate([logs[own], v[r][left] - (ended[r] + 1) / live - np.log(left.sum())])
        held, total = np.concatenate([values[own], v[r][left]]), float(np.logaddexp.reduce(mine))
        weight = np.exp(mine - total)
        information = max(0.0, float((weight * held).sum()) - total)
        out.append(NestedRun(np.concatenate([points[own], x[left, r]]), held, weight, total, float(np.sqrt(information / live)), information))
    return out


def nested_posterior(obs: DataFrame, model: str = "newling", live: int = 100, steps: int = 25, seed: int = 0, key: str = "object_id", limits: Mapping[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """(key, filter, point, params, log_likelihood, weight, log_evidence, log_evidence_error): a row for each weighted point.

    Weights of an object's band sum to 1; the evidence is that of the model under a uniform prior within the limits, without
    the constant of the errors. A band without a usable point has no row.
    """

    def sampled(b: Bands) -> dict:
        runs = many_nested_runs(b.chi, b.low, b.high, [_seed(seed, *i) for i in b.ids], live, steps)
        sizes = [len(r.weight) for r in runs]
        each = pa.array(np.repeat(np.arange(len(runs)), sizes))
        spread = lambda name: pa.array(np.repeat([getattr(r, name) for r in runs], sizes))
        joined = lambda name: np.concatenate([getattr(r, name) for r in runs])
        own = {"point": pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])), "params": lists(joined("points")), "log_likelihood": pa.array(joined("log_likelihood")), "weight": pa.array(joined("weight"))}
        return {**{c: a.take(each) for c, a in b.names.items()}, **own, "log_evidence": spread("log_evidence"), "log_evidence_error": spread("error")}

    columns = "point int, params array<double>, log_likelihood double, weight double, log_evidence double, log_evidence_error double"
    return _by_band(obs, key, CURVES[model], limits or MODELS[model][0], sampled, columns, 1024)


def posterior_means(posterior: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, filter, params, deviations, log_evidence, best): weighted means and deviations of the points, and the likeliest one."""
    each = posterior.select(key, "filter", "weight", "log_evidence", F.posexplode("params").alias("i", "x"))
    parts = each.groupBy(key, "filter", "log_evidence", "i").agg(F.sum(F.col("weight") * F.col("x")).alias("m"), F.sum(F.col("weight") * F.col("x") * F.col("x")).alias("q"))
    packed = parts.groupBy(key, "filter", "log_evidence").agg(F.sort_array(F.collect_list(F.struct("i", "m", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("s")))).alias("p"))
    best = posterior.groupBy(key, "filter").agg(F.max_by("params", F.struct("log_likelihood", "point")).alias("best"))
    return packed.select(key, "filter", F.col("p.m").alias("params"), F.col("p.s").alias("deviations"), "log_evidence").join(best, [key, "filter"])


def fit_table(fits: DataFrame, filters: Sequence[str], model: str = "newling", key: str = "object_id") -> DataFrame:
    """One row per object with a column for each band and parameter, zero where a band was not fitted."""
    wide = fits.groupBy(key).pivot("filter", list(filters)).agg(F.first("params"))
    names = list(MODELS[model][0])
    return wide.select(key, *[F.coalesce(F.col(f)[i], F.lit(0.0)).alias(f"{f}-{n}") for f in filters for i, n in enumerate(names)])


def reconstruct(obs: DataFrame, model: str, params: Mapping[str, Column], points: int = 100, key: str = "object_id") -> DataFrame:
    """(key, filter, grid_ix, mjd, flux): the model at ``points`` times over each band's span, from its start."""
    spans = obs.groupBy(key, "filter").agg((F.max("mjd") - F.min("mjd")).alias("_l"))
    grid = spans.select(key, "filter", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_ix"), "_l")
    grid = grid.withColumn("mjd", F.col("grid_ix") * F.col("_l") / F.lit(float(points - 1))).drop("_l")
    return grid.withColumn("flux", MODELS[model][1](F.col("mjd"), params))


def reconstruct_fits(obs: DataFrame, fits: DataFrame, model: str, points: int = 100, key: str = "object_id") -> DataFrame:
    """``reconstruct`` with the fitted parameters of each object and band."""
    names = list(MODELS[model][0])
    joined = obs.join(fits.where("status = 'ok'").select(key, "filter", "params"), [key, "filter"])
    spans = joined.groupBy(key, "filter").agg((F.max("mjd") - F.min("mjd")).alias("_l"), F.first("params").alias("_p"))
    grid = spans.select(key, "filter", "_p", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_ix"), "_l")
    grid = grid.withColumn("mjd", F.col("grid_ix") * F.col("_l") / F.lit(float(points - 1)))
    return grid.select(key, "filter", "grid_ix", "mjd", MODELS[model][1](F.col("mjd"), {n: F.col("_p")[i] for i, n in enumerate(names)}).alias("flux"))


def fit_template(obs: DataFrame, templates: DataFrame, key: str = "object_id", shifts: Sequence[float] | None = None, stretches: Sequence[float] = (0.5, 0.63, 0.8, 1.0, 1.25, 1.6, 2.0), sampler: str = "leastsq", seed: int = 0, bounds: Mapping[str, tuple[float, float]] | None = None, redshifts: DataFrame | None = None) -> DataFrame:
    """The best template (name, filter, phase, flux) for each object: template, t0, stretch, amplitude, chisq, status.

    For a template, start and stretch the amplitude has a closed form. The starts, two days apart, cover all at which the
    template meets the object's own times, unless ``shifts`` are given; each template's best start and stretch are then
    refined by ``sampler`` (leastsq, mcmc or nested) and the least chi-square wins. Templates are model inputs of bounded
    size and are sent to the workers.

    ``bounds`` keeps t0 or stretch within (low, high). ``redshifts`` (key, z) fixes an object's redshift: its template is
    stretched by 1 + z besides, so that ``stretch`` is the one in its own frame.
    """
    run, bounds = SAMPLERS[sampler], dict(bounds or {})
    if unknown := set(bounds) - {"t0", "stretch"}:
        raise ValueError(f"no such parameters: {sorted(unknown)}")
    table, kind = _template_table(templates), dict(obs.dtypes)[key]
    slowest, fastest = bounds.get("stretch", (0.0, np.inf))
    stretches = [s for s in stretches if slowest <= s <= fastest] or [float(np.mean(bounds["stretch"]))]

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["flux_error"] != 0]
        t, y, e, band = (pdf[c].to_numpy() for c in ("mjd", "flux", "flux_error", "filter"))
        z = float(pdf["_z"].iloc[0]) if len(pdf) and "_z" in pdf and pd.notna(pdf["_z"].iloc[0]) else 0.0
        best = None
        for name, bands in sorted(table.items()):

            def model(p: np.ndarray) -> tuple[float, np.ndarray]:
                m = np.zeros(len(t))
                for f, (x, v) in bands.items():  # noqa: B023
                    at = band == f
                    m[at] = np.interp((t[at] - p[0]) / (p[1] * (1 + z)), x, v, left=0.0, right=0.0)
                norm = float(np.sum((m / e) ** 2))
                return (max(0.0, float(np.sum(m * y / e**2)) / norm) if norm > 0 else 0.0), m

            def curve(_, p: np.ndarray) -> np.ndarray:
                a, m = model(p)  # noqa: B023
                return a * m

            phases = np.concatenate([x for x, _ in bands.values()])
            first = None
            for s in stretches:
                reach = (t.min() - phases.max() * s * (1 + z), t.max() - phases.min() * s * (1 + z)) if len(t) else (0.0, 0.0)
                reach = (max(reach[0], bounds["t0"][0]), min(reach[1], bounds["t0"][1])) if "t0" in bounds else reach
                t0 = np.asarray(shifts, float) if shifts is not None else np.unique(np.minimum(np.arange(reach[0], reach[1] + 2, 2.0), reach[1]))
                for t0 in np.array_split(t0, 1 + len(t0) * len(t) // 1_000_000):
                    m = np.zeros((len(t0), len(t)))
                    for f, (x, v) in bands.items():
                        at = band == f
                        m[:, at] = np.interp((t[at] - t0[:, None]) / (s * (1 + z)), x, v, left=0.0, right=0.0)
                    norm, some = ((m / e) ** 2).sum(axis=1), m.any(axis=1)
                    a = np.where(norm > 0, np.maximum(0.0, (m * y / e**2).sum(axis=1) / np.where(norm > 0, norm, 1.0)), 0.0)
                    c = np.where(some, (((y - a[:, None] * m) / e) ** 2).sum(axis=1), np.inf)
                    if some.any() and (first is None or c.min() < first[2]):
                        first = (float(t0[c.argmin()]), float(s), float(c.min()))
            if first is None:
                continue
            start = np.array(first[:2])
            low, high = np.array([start[0] - 4, max(slowest, start[1] / 1.6)]), np.array([start[0] + 4, min(fastest, start[1] * 1.6)])
            if "t0" in bounds:
                low[0], high[0] = max(low[0], bounds["t0"][0]), min(high[0], bounds["t0"][1])
            found, c = run(curve, t, y, e, start, low, high, 1, _seed(seed, pdf[key].iloc[0], name))
            if c > first[2]:
                found, c = start, first[2]
            if best is None or c < best[4]:
                best = (name, float(found[0]), float(found[1]), model(found)[0], float(c))
        row = best or (None, None, None, None, None)
        return pd.DataFrame([(pdf[key].iloc[0] if len(pdf) else None, *row, len(t), "ok" if best else "no template fits")], columns=[key, "template", "t0", "stretch", "amplitude", "chisq", "n_points", "status"]) if len(pdf) else pd.DataFrame(columns=[key, "template", "t0", "stretch", "amplitude", "chisq", "n_points", "status"])

    schema = f"{key} {kind}, template string, t0 double, stretch double, amplitude double, chisq double, n_points int, status string"
    rows = obs.select(key, "filter", "mjd", "flux", "flux_error")
    if redshifts is not None:
        rows = rows.join(redshifts.select(key, F.col("z").cast("double").alias("_z")), key, "left")
    return dealt(rows, key).groupBy(key).applyInPandas(fitted, schema)


def _template_table(templates: DataFrame, most: int = 1_000_000) -> dict:
    """Templates by name and filter as (phases, fluxes); more than ``most`` points are refused, as they go to all workers."""
    rows = templates.select("name", "filter", "phase", "flux").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} template points")
    return {n: {f: (h["phase"].to_numpy(), h["flux"].to_numpy()) for f, h in g.sort_values("phase").groupby("filter")} for n, g in rows.groupby("name")}


def reconstruct_template(obs: DataFrame, fits: DataFrame, templates: DataFrame, points: int = 100, key: str = "object_id", redshifts: DataFrame | None = None) -> DataFrame:
    """(key, filter, grid_ix, mjd, flux): each object's fitted template at ``points`` times over its span in each of its bands."""
    table = _template_table(templates)
    spans = obs.groupBy(key, "filter").agg(F.min("mjd").alias("a"), F.max("mjd").alias("b"))
    rows = spans.join(fits.where("status = 'ok'").select(key, "template", "t0", "stretch", "amplitude"), key)
    rows = rows.withColumn("z", F.lit(0.0)) if redshifts is None else rows.join(redshifts.select(key, F.col("z").cast("double").alias("z")), key, "left").na.fill(0.0, ["z"])
    ids = dict(obs.dtypes)[key]

    def read(batches):
        for pdf in batches:
            out = {c: [] for c in (key, "filter", "grid_ix", "mjd", "flux")}
            for r in pdf.itertuples(index=False):
                t = np.linspace(r.a, r.b, points)
                x, v = table[r.template].get(r.filter, (np.zeros(1), np.zeros(1)))
                flux = r.amplitude * np.interp((t - r.t0) / (r.stretch * (1 + r.z)), x, v, left=0.0, right=0.0)
                for c, values in ((key, [getattr(r, key)] * points), ("filter", [r.filter] * points), ("grid_ix", range(points)), ("mjd", t), ("flux", flux)):
                    out[c] += list(values)
            yield pd.DataFrame(out)

    return rows.mapInPandas(read, f"{key} {ids}, filter string, grid_ix int, mjd double, flux double")


def fit_with(obs: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "object_id") -> DataFrame:
    """A model of the caller's own, object by object."""
    return dealt(obs, key).groupBy(key).applyInPandas(function, schema)
