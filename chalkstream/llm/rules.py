"""Ordered rule lists by incremental reduced-error pruning, and their form in SQL."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    at: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.at if self.above else x[self.feature] < self.at

    def column(self) -> Column:
        return F.col(self.feature) >= self.at if self.above else F.col(self.feature) < self.at


@dataclass(frozen=True)
class Rule:
    kind: str
    tests: tuple[Test, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for t in self.tests:
            out &= t.holds(x)
        return out


def _grow(x: dict[str, np.ndarray], pos: np.ndarray, at: np.ndarray, steps: int) -> list[Test]:
    """Tests added by information gain until no negative is left."""
    tests: list[Test] = []
    while (at & ~pos).any() and len(tests) < 6:
        p0, n0 = (at & pos).sum(), (at & ~pos).sum()
        best, chosen = 1e-9, None
        for f, v in x.items():
            own = np.unique(v[at])
            if len(own) < 2:
                continue
            mids = (own[1:] + own[:-1]) / 2
            for cut in mids[np.unique(np.linspace(0, len(mids) - 1, steps).astype(int))]:
                for above in (True, False):
                    m = at & (v >= cut if above else v < cut)
                    p, n = (m & pos).sum(), (m & ~pos).sum()
                    gain = p * (math.log2((p + 1) / (p + n + 1)) - math.log2((p0 + 1) / (p0 + n0 + 1))) if p else 0.0
                    if gain > best:
                        best, chosen = gain, Test(f, above, float(cut))
        if chosen is None:
            break
        tests.append(chosen)
        at = at & chosen.holds(x)
    return tests


def _prune(tests: list[Test], x: dict[str, np.ndarray], pos: np.ndarray, at: np.ndarray) -> list[Test]:
    """The prefix of tests that does best on rows the rule has not been grown from."""

    def worth(k: int) -> float:
        m = at.copy()
        for t in tests[:k]:
            m &= t.holds(x)
        p, n = (m & pos).sum(), (m & ~pos).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))] if tests else tests


def irep(x: dict[str, np.ndarray], y: np.ndarray, order: list[str], seed: int = 7, steps: int = 40, most_rules: int = 12) -> list[Rule]:
    """Rules for the kinds of order, one kind after the other; what no rule takes is of the last kind of y.

    For each rule, two thirds of the rows left grow it and one third prunes it; a kind ends when a pruned rule is wrong
    on half of the pruning rows it takes, or takes none. Rows a rule takes are not seen by later rules.
    """
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(y), bool), []
    for kind in order:
        pos = y == kind
        for _ in range(most_rules):
            if not (left & pos).any():
                break
            grow = left & (rng.random(len(y)) < 2 / 3)
            tests = _prune(_grow(x, pos, grow, steps), x, pos, left & ~grow)
            if not tests:
                break
            rule = Rule(kind, tuple(tests))
            m = rule.holds(x) & left
            held = m & ~grow
            if not held.any() or (held & pos).sum() <= (held & ~pos).sum():
                break
            rules.append(rule)
            left &= ~m
    return rules


def decide(rules: list[Rule], rest: str) -> Column:
    """The rules as one CASE expression over columns of the features' names."""
    out = None
    for r in rules:
        c = F.lit(True)
        for t in r.tests:
            c = c & t.column()
        out = F.when(c, r.kind) if out is None else out.when(c, r.kind)
    return F.lit(rest) if out is None else out.otherwise(rest)


def predict(rules: list[Rule], x: dict[str, np.ndarray], rest: str) -> np.ndarray:
    out = np.full(len(next(iter(x.values()))), rest, object)
    free = np.ones(len(out), bool)
    for r in rules:
        m = r.holds(x) & free
        out[m] = r.kind
        free &= ~m
    return out
