"""Bands of different lengths that one sampler takes at once: the same as band by band."""

import numpy as np

from fluxloom.operators import fit as P


def _bands():
    r = np.random.default_rng(9)
    lengths = np.sort(np.array([1, 2, 3, 7, 8, 9, 9, 12, 17, 17, 24]))
    t, y, e = (np.full((len(lengths), 24), 5.0) for _ in range(3))
    for i, n in enumerate(lengths):
        t[i, :n], y[i, :n], e[i, :n] = np.sort(r.uniform(0, 30, n)), r.uniform(0, 200, n), r.uniform(1, 9, n)
    return lengths, t, y, e


def test_chi_squares_are_over_own_points():
    lengths, t, y, e = _bands()
    p = np.random.default_rng(1).uniform(0.5, 3, (len(lengths), 5))
    for block in (3, 256):
        got = P._many_chi(P.CURVES["newling"], lengths, t, y, e, block)(np.arange(1, 11), p[1:])
        want = [np.sum(((y[i, :n] - P._newling(t[i, :n], p[i])) / e[i, :n]) ** 2) for i, n in enumerate(lengths)][1:]
        assert got.tolist() == want


def test_samplers_take_bands_of_all_lengths():
    lengths, t, y, e = _bands()
    low, high, start = (np.array([b[i] for b in P.MODELS["newling"][0].values()], float) for i in range(3))
    each = lambda v: np.tile(v, (len(lengths), 1))
    chi, seeds = P._many_chi(P.CURVES["newling"], lengths, t, y, e), list(range(len(lengths)))
    for name in P.SAMPLERS:
        more = {"mcmc": {"rounds": 20}, "nested": {"rounds": 150}}.get(name, {})
        found, value = P.MANY[name](chi, lengths, each(start), each(low), each(high), 3, seeds, **more)
        for i, n in enumerate(lengths):
            p, c = P.SAMPLERS[name](P._newling, t[i, :n], y[i, :n], e[i, :n], start, low, high, 3, i, **more)
            assert np.allclose(found[i], p, rtol=1e-9) and np.isclose(value[i], c, rtol=1e-9), name
    runs = P.many_nested_runs(chi, each(low), each(high), seeds, 15, 6)
    for i, n in enumerate(lengths):
        own = P.nested_run(lambda p: -0.5 * float(np.sum(((y[i, :n] - P._newling(t[i, :n], p)) / e[i, :n]) ** 2)), low, high, 15, 6, i)  # noqa: B023
        assert np.allclose(runs[i].points, own.points, rtol=1e-9) and np.isclose(runs[i].log_evidence, own.log_evidence)


def test_batches_hold_many_lengths_in_bounds():
    lengths = np.sort(np.random.default_rng(2).integers(1, 40, 1000))
    parts = list(P._batches(lengths, 256))
    assert len(parts) == 4 and [p.stop for p in parts] == [256, 512, 768, 1000]
    parts = list(P._batches(np.array([1, 2, 3, 5000, 5000]), 256, 6000))
    assert [(p.start, p.stop) for p in parts] == [(0, 3), (3, 4), (4, 5)]
