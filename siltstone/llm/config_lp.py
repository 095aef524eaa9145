"""Bin packing of whole lengths by the configuration linear program.

A configuration is a multiset of lengths that fits in one bin; the program asks for the least number of bins, in
fractions of configurations, that covers a histogram of lengths.  It is solved by multiplicative weights: every length
has a price, a knapsack dynamic program finds the configurations that are worth most (for each length the best one that
holds it), and lengths that these have covered above average become cheaper.  What any round's prices are worth bounds
the number of bins from below.  Rounding takes whole copies and solves again for what is left; the last few lengths go
to the fullest bins that still have room for them.

Everything here is about lengths: time and memory depend on the bin's size and not on how many items there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

ROUNDS, LATER = 60, 20  # rounds of the first solution and of those for what is left
STEP = 0.3  # how much a price falls for one covering above the average
NEAR = 0.02  # configurations that are worth so little less than the best are taken too
SHARE = 0.7  # of a solution that is rounded before the rest is solved again
PASSES = 12


def knapsack(prices: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Most that fits in each room up to ``size``, by price, and the index of a length in it (-1: as in one room less)."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1, np.int32)
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for room in range(1, size + 1):
        k = upto[room]
        best[room] = best[room - 1]
        if k:
            worth = best[room - lengths[:k]] + prices[:k]
            j = int(worth.argmax())
            if worth[j] > best[room]:
                best[room], choice[room] = worth[j], j
    return best, choice


def configurations(choice: np.ndarray, lengths: np.ndarray, size: int) -> list[tuple[tuple[int, int], ...]]:
    """For each length the best configuration that holds it, as ``((index, copies), ...)``."""
    last = np.maximum.accumulate(np.where(choice >= 0, np.arange(size + 1), -1))
    room, rows = size - lengths, [np.arange(len(lengths))]
    while True:
        at = last[room]
        if (at < 0).all():
            break
        item = np.where(at >= 0, choice[at], -1)
        rows.append(item)
        room = np.where(at >= 0, at - lengths[item], 0)
    return [tuple(sorted(Counter(i for i in col if i >= 0).items())) for col in np.stack(rows, 1).tolist()]


@dataclass
class Fractions:
    bins: dict = field(default_factory=dict)  # configuration -> bins of it
    bound: float = 0.0  # no packing has fewer bins


def solve(lengths: np.ndarray, demand: np.ndarray, size: int, rounds: int = ROUNDS) -> Fractions:
    """Fractions of configurations that cover the demand on average; ``lengths`` ascend and have a demand each."""
    mass = demand * lengths / (demand * lengths).sum()
    covered, bins, bound = np.zeros(len(lengths)), Counter(), 0.0
    for _ in range(rounds):
        prices = lengths / size * np.exp(-STEP * (covered - (covered * mass).sum()))
        best, choice = knapsack(prices, lengths, size)
        bound = max(bound, float((prices * demand).sum() / best[size]))
        near = np.flatnonzero(prices + best[size - lengths] >= (1 - NEAR) * best[size])
        found, left = configurations(choice, lengths, size), demand.astype(float)
        for i in near[::-1]:  # large lengths choose first, and nothing is covered more than once in a round
            share = min(left[j] / n for j, n in found[i])
            if share > 0:
                bins[found[i]] += share
                for j, n in found[i]:
                    left[j] -= n * share
        covered += 1 - left / demand
    scale = (covered * mass).sum()
    return Fractions({c: x / scale for c, x in bins.items()}, bound)


def _fill(plan: Counter, lengths: np.ndarray, left: np.ndarray, size: int) -> None:
    """Best fit, the largest first, of many copies at a time: to the bins with the least room that is enough, else to new ones."""
    room = sorted((size - int(sum(lengths[j] * n for j, n in c)), c) for c in plan)
    for i in range(len(lengths) - 1, -1, -1):
        need = int(lengths[i])
        while left[i]:
            at = bisect_left(room, (need, ()))
            space, config = room.pop(at) if at < len(room) else (size, ())
            fit = space // need
            each = min(fit, int(left[i]))
            copies = int(left[i]) // each
            if config:
                copies = min(copies, plan[config])
                plan[config] -= copies
                if plan[config]:
                    insort(room, (space, config))
                else:
                    del plan[config]
            own = Counter(dict(config))
            own[i] += each
            fresh = tuple(sorted(own.items()))
            if fresh not in plan:
                insort(room, (space - each * need, fresh))
            plan[fresh] += copies
            left[i] -= each * copies


@dataclass
class Plan:
    bins: list  # (lengths of one bin, longest first; how many such bins)
    bound: float

    @property
    def total(self) -> int:
        return sum(n for _, n in self.bins)


def plan(histogram: dict[int, int], size: int) -> Plan:
    """Whole bins that hold exactly the histogram's items (``length: count``, lengths from 1 to ``size``), and a lower bound of their number."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(lengths):
        return Plan([], 0.0)
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    taken, bound = Counter(), 0.0
    for turn in range(PASSES):
        at = np.flatnonzero(left)
        if not len(at):
            break
        found = solve(lengths[at], left[at], size, LATER if turn else ROUNDS)
        bound = bound or found.bound
        before, used, most = int((left * lengths).sum()), 0, SHARE * sum(found.bins.values())
        for config, bins in sorted(found.bins.items(), key=lambda x: (-x[1], x[0])):
            if used >= most and used:
                break
            own = [(int(at[j]), n) for j, n in config]
            copies = min(-int(-bins // 1), *(int(left[j]) // n for j, n in own))
            if copies > 0:
                taken[tuple(own)] += copies
                used += copies
                for j, n in own:
                    left[j] -= n * copies
        if int((left * lengths).sum()) > 0.9 * before:
            break
    _fill(taken, lengths, left, size)
    bins = [(tuple(int(lengths[j]) for j, n in sorted(c, reverse=True) for _ in range(n)), int(k)) for c, k in sorted(taken.items())]
    return Plan(bins, bound)
