"""Running values kept within limits, for whole arrays at once.

An hour turns a level ``l`` into ``min(cap, max(0, l + a))``. Such maps ``l -> min(hi, max(lo, l + a))`` are closed under
composition, so a prefix scan in log n steps over ``(a, lo, hi)`` arrays replaces a walk from row to row. A row that
begins a series is a map with ``lo = hi``: it does not depend on anything before it, so many series share one scan.
"""

from __future__ import annotations

import numpy as np

Maps = tuple[np.ndarray, np.ndarray, np.ndarray]


def clamped(level: np.ndarray, flow: np.ndarray, cap: np.ndarray) -> np.ndarray:
    return np.minimum(cap, np.maximum(0.0, level + flow))


def compose(first: Maps, then: Maps) -> Maps:
    """The maps that apply ``first`` and ``then`` in turn."""
    (a, lo, hi), (b, low, high) = first, then
    return a + b, np.minimum(high, np.maximum(low, lo + b)), np.minimum(high, np.maximum(low, hi + b))


def clamp_levels(flow: np.ndarray, cap: np.ndarray, begins: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels before and after every row; ``begins`` marks rows that start from ``start``, the first row always does."""
    n = len(flow)
    if not n:
        return np.empty(0), np.empty(0)
    begins = begins.copy()
    begins[0] = True
    fixed = clamped(start, flow, cap)
    maps = np.where(begins, 0.0, flow), np.where(begins, fixed, 0.0), np.where(begins, fixed, cap)
    step = 1
    while step < n and not (maps[1] == maps[2]).all():
        later = compose(tuple(m[:-step] for m in maps), tuple(m[step:] for m in maps))
        maps = tuple(np.concatenate([m[:step], x]) for m, x in zip(maps, later, strict=True))
        step *= 2
    after = maps[1]
    return np.where(begins, start, np.concatenate([[0.0], after[:-1]])), after


def walk(flow: np.ndarray, cap: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Levels before and after every row of one series, row by row: the same to the last digit wherever it is cut."""
    levels = [float(start)]
    for a, c in zip(flow.tolist(), cap.tolist(), strict=True):
        levels.append(min(max(levels[-1] + a, 0.0), c) if c == c else c)
    return np.array(levels[:-1]), np.array(levels[1:])


def fold(flow: np.ndarray, cap: np.ndarray) -> tuple[float, float, float]:
    """One map for all rows in turn, by halving."""
    maps: Maps = flow.astype(float), np.zeros(len(flow)), np.asarray(cap, float)
    while len(maps[0]) > 1:
        n = len(maps[0]) // 2 * 2
        pairs = compose(tuple(m[0:n:2] for m in maps), tuple(m[1:n:2] for m in maps))
        maps = tuple(np.concatenate([x, m[n:]]) for x, m in zip(pairs, maps, strict=True))
    return float(maps[0][0]), float(maps[1][0]), float(maps[2][0])
