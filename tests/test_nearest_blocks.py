"""Nearest rows found in blocks of products: exact, with ties, whatever the bounds; queries are dealt over all partitions."""

import numpy as np
import pytest

from fluxloom.operators import neighbours as N


@pytest.mark.parametrize(("count", "step"), [(3000, 0), (3000, 0.5), (5, 0), (0, 0)])
def test_blocks_give_the_nearest_with_ties(count, step):
    r = np.random.default_rng(count)
    known, asked = r.normal(size=(count, 4)), r.normal(size=(300, 4))
    if step:  # many equal vectors and distances
        known, asked = np.round(known / step) * step, np.round(asked / step) * step
    d = np.sqrt(((asked[:, None] - known[None]) ** 2).sum(axis=2))
    kth = np.sort(d, axis=1)[:, 3] if count > 3 else np.full(300, np.inf)
    for most in (None, kth, 1.5 * kth + 0.1, 0.5 * kth):
        bound = np.full(300, np.inf) if most is None else most
        for i, at, far in N.nearest_of(asked, known, 4, most):
            needed = np.flatnonzero(d[i] <= min(kth[i], bound[i]))
            assert set(needed) <= set(at.tolist()) and np.allclose(far, d[i, at])


def test_one_query_of_copies():
    found = list(N.nearest_of(np.zeros((1, 3)), np.zeros((5000, 3)), 2))
    assert len(found) == 1 and sorted(found[0][1]) == list(range(5000)) and not found[0][2].any()


def test_queries_of_one_shelf_are_dealt_over_partitions():
    assert N.queries_of_part(51_282, 65_536, 24) == 8192  # one part for all before
    assert N.queries_of_part(6_000_000, 65_536, 200) == 30_000
    assert N.queries_of_part(10**9, 65_536, 200) == 65_536 and N.queries_of_part(0, 4, 0) == 1
