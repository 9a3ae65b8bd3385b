"""The clamp scan against a walk from row to row."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.functions.scan import clamp_levels, compose, fold


def walk(flow, cap, begins, start):
    level, before, after = 0.0, [], []
    for a, c, first, s in zip(flow, cap, begins, start):
        level = s if first else level
        before.append(level)
        level = min(c, max(0.0, level + a))
        after.append(level)
    return before, after


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
@pytest.mark.parametrize("size", [1.0, 300.0, 9000.0])
def test_levels_equal_the_walk(n, size):
    rng = np.random.default_rng(n)
    flow, cap = rng.normal(size=n) * size, rng.choice([4000.0, 5000.0], n)
    begins, start = rng.random(n) < 0.02, rng.uniform(-100, 6000, n)
    if n:
        begins[0] = True
    for found, wanted in zip(clamp_levels(flow, cap, begins, start), walk(flow, cap, begins, start), strict=True):
        assert np.allclose(found, wanted, atol=1e-8)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 777])
def test_one_map_stands_for_all_rows(n):
    rng = np.random.default_rng(n)
    flow, cap = rng.normal(size=n) * 200, np.full(n, 5000.0)
    whole = fold(flow, cap)
    cut = n // 2
    parts = compose(fold(flow[:cut], cap[:cut]), fold(flow[cut:], cap[cut:])) if cut else whole
    for level in (0.0, 1234.5, 5000.0):
        _, after = walk(flow, cap, [True] + [False] * (n - 1), [level] * n)
        for a, lo, hi in (whole, parts):
            assert min(hi, max(lo, level + a)) == pytest.approx(after[-1], abs=1e-8)


def test_a_walk_is_the_same_wherever_it_is_cut():
    from tidewell.functions import scan

    rng = np.random.default_rng(4)
    flow, cap = rng.normal(0.0, 900.0, 60), np.full(60, 5000.0)
    flow[50] = np.nan
    before, after = scan.walk(flow, cap, 100.1)
    parts = [scan.walk(flow[:7], cap[:7], 100.1)]
    parts.append(scan.walk(flow[7:], cap[7:], parts[0][1][-1]))
    assert np.array_equal(np.concatenate([p[1] for p in parts]), after, equal_nan=True)
    want = scan.clamp_levels(flow, cap, np.zeros(60, bool), np.full(60, 100.1))
    assert np.allclose(want[0], before, equal_nan=True) and np.allclose(want[1], after, equal_nan=True)
