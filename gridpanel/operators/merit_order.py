"""The merit order of many hours at once, on numpy columns.

An hour's blocks are one row of a matrix; sorting, cumulative supply and the search for the
block at which supply meets demand run over whole batches. Sums are taken in the order in which
the row-wise and the window form of the clearing take them, so results agree to the last digit.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np


@dataclass(frozen=True)
class Cleared:
    """``q`` by hour and block; ``level`` is the cost at the margin, NaN where there is none."""

    q: np.ndarray
    level: np.ndarray
    shed: np.ndarray
    spill: np.ndarray


def demand_at(price: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Demand of all sectors; ``price`` has one more axis than the hours, or the same."""
    total = None
    for own_a, own_b in zip(a, b):
        if price.ndim > own_a.ndim:
            own_a, own_b = own_a[:, None], own_b[:, None]
        part = np.maximum(own_a - own_b * price, 0.0)
        total = part if total is None else total + part
    return total


def price_at(demand: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Price at which demand is the given amount: the largest over subsets of sectors; NaN
    where no sector answers to prices."""
    best = np.full(len(demand), -np.inf)
    for size in range(1, len(a) + 1):
        for subset in combinations(range(len(a)), size):
            slope = _summed(b[i] for i in subset)
            with np.errstate(divide="ignore", invalid="ignore"):
                option = (_summed(a[i] for i in subset) - demand) / slope
            best = np.where(slope == 0, best, np.maximum(best, option))
    return np.where(best == -np.inf, np.nan, best)


def _summed(columns) -> np.ndarray:
    total = None
    for c in columns:
        total = c if total is None else total + c
    return total


def clear(lo: np.ndarray, hi: np.ndarray, mc: np.ndarray, a: np.ndarray, b: np.ndarray, net_export: np.ndarray, loss: float, voll: float) -> Cleared:
    """Clear hours (rows) with blocks (columns, which settle ties of cost by their order)
    against sectors' demand ``a - b * price``. Output below ``lo`` is must-run."""
    gross = 1.0 + loss

    def needed(level):
        x = net_export if level.ndim == 1 else net_export[:, None]
        return gross * demand_at(gross * level, a, b) + x

    def level_for(supply):
        return price_at((supply - net_export) / gross, a, b) / gross

    n, rows = len(lo), np.arange(len(lo))
    order = np.argsort(mc, axis=1, kind="stable")
    must = _summed(lo[:, t] for t in range(lo.shape[1]))
    supply = np.cumsum(np.concatenate([must[:, None], np.take_along_axis(hi - lo, order, 1)], axis=1), axis=1)
    need = needed(np.take_along_axis(mc, order, 1))
    need0, need_voll = needed(np.zeros(n)), needed(np.full(n, voll))
    over = must >= need0
    hit = supply[:, 1:] >= need
    met, first = hit.any(axis=1), hit.argmax(axis=1)
    below, asked, cost = supply[rows, first], need[rows, first], mc[rows, order[rows, first]]
    everything = supply[:, -1]
    short = ~over & ~met & (need_voll > everything)
    level = np.where(below <= asked, cost, level_for(below))
    level = np.where(met, level, np.where(short, voll, level_for(everything)))
    level = np.where(over, 0.0, level)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    until = np.where(over, 0, np.where(met, first, order.shape[1]))[:, None]
    q = np.where(place < until, hi, lo)
    marginal = np.flatnonzero(met & ~over)
    at = order[marginal, first[marginal]]
    q[marginal, at] = lo[marginal, at] + np.maximum(asked - below, 0.0)[marginal]
    return Cleared(q, level, np.where(short, need_voll - everything, 0.0), np.where(over, must - need0, 0.0))
