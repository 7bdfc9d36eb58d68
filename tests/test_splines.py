"""Biorthogonal splines: exact inverses, published values, vanishing moments, refusal of other orders."""

import numpy as np
import pytest

from fluxloom.operators import features as T


@pytest.mark.parametrize("name", [f"{f}{n}" for f in ("bior", "rbio") for n in T.SPLINES])
def test_inverse_is_exact(name):
    x = np.random.default_rng(1).normal(size=128)
    levels = T.swt_array(x, 4, name)
    assert np.allclose(T.iswt_array(levels[-1][0], [d for _, d in levels], name), x, atol=1e-9)
    for low, high in (T.filters_of(name), T.synthesis_of(name)):
        assert len(low) == len(high) and len(low) % 2 == 0
        assert sum(low) == pytest.approx(np.sqrt(2)) and sum(high) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("orders", T.SPLINES)
def test_filters_are_dual_and_symmetric(orders):
    low, back = (np.array(x) for x in T._spline(orders))
    n = len(low)
    for shift in range(-n + 2, n - 1, 2):
        both = sum(low[k] * back[k + shift] for k in range(n) if 0 <= k + shift < n)
        assert both == pytest.approx(1.0 if shift == 0 else 0.0, abs=1e-9)
    for taps in (low, back):
        held = np.trim_zeros(np.where(abs(taps) < 1e-12, 0, taps))
        assert np.allclose(held, held[::-1])
    # as many moments of the details vanish as the orders say, but for 5.5, whose zeros are 6 and 4
    want = {"5.5": 6}.get(orders, int(orders.split(".")[0]))
    assert all(abs(sum((-1) ** k * k**m * t for k, t in enumerate(back))) < 1e-6 * n**m for m in range(want))


def test_published_values():
    low, back = T._spline("4.4")
    assert np.allclose(sorted(low)[-1], 0.85269867900889) and np.allclose(sorted(back)[-1], 0.78848561640558)
    low, back = T._spline("2.2")
    held = [x for x in low if abs(x) > 1e-12]
    assert np.allclose(held, np.array([-1, 2, 6, 2, -1]) * np.sqrt(2) / 8) and np.allclose([x for x in back if abs(x) > 1e-12], np.array([1, 2, 1]) * np.sqrt(2) / 4)
    assert np.allclose(T._spline("1.1")[0], T.filters_of("haar")[0])
    assert np.allclose(sorted(T._spline("5.5")[0])[-1], 0.7366601814282105) and np.allclose(sorted(T._spline("6.8")[0])[-1], 0.8259229974584023)


def test_unknown_orders_are_refused():
    for name in ("bior1.2", "rbio7.7", "bior", "bior4"):
        with pytest.raises(ValueError):
            T.filters_of(name)
    assert {"bior3.9", "rbio6.8"} <= set(T.wavelets(True))


def test_in_spark(spark):
    x = np.random.default_rng(2).normal(size=32).tolist()
    df = spark.createDataFrame([(x,)], "x array<double>")
    assert np.allclose(T.iswt(T.swt(df, "x", 3, "bior2.6"), 3, "again", "bior2.6").first().again, x)
