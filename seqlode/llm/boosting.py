"""Gradient-boosted trees over discrete features.

The training set is a table of distinct feature vectors with their counts, which Spark aggregates over all rows and
whose size the features' levels bound; the fit is a small computation on that table, and the fitted model is a
column expression."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: str = ""
    cut: int = 0
    low: Node | None = None
    high: Node | None = None

    def score(self, row: dict) -> float:
        return self.value if self.low is None else (self.low if row[self.feature] <= self.cut else self.high).score(row)

    def sql(self, name: Callable[[str], str]) -> str:
        if self.low is None:
            return f"{self.value!r}D"
        return f"CASE WHEN {name(self.feature)} <= {self.cut} THEN {self.low.sql(name)} ELSE {self.high.sql(name)} END"


@dataclass
class Boosted:
    """A sum of trees, in log odds."""

    base: float
    trees: list[Node]
    threshold: float = 1.01
    #: What ``calibrate`` has found on held-out cells.
    shown: dict = field(default_factory=dict)

    def score(self, row: dict) -> float:
        return 1 / (1 + math.exp(-self.base - sum(t.score(row) for t in self.trees)))

    def sql(self, name: Callable[[str], str]) -> str:
        """The score as SQL; ``name`` gives the text for a feature. (Built as text, as a model has thousands of nodes.)"""
        total = " + ".join([f"{self.base!r}D", *(t.sql(name) for t in self.trees)])
        return f"(1 / (1 + exp(-({total}))))"

    def column(self) -> Column:
        """The score from columns that are named like the features."""
        return F.expr(self.sql(lambda f: f"`{f}`"))


def fit(cells: list[dict], features: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3, smooth: float = 1.0) -> Boosted:
    """Fit to ``cells``: dicts of integer features with ``n`` rows, ``pos`` of them positive."""
    pos, n = sum(c["pos"] for c in cells), sum(c["n"] for c in cells)
    base = math.log((pos + smooth) / (n - pos + smooth))
    raw = [base] * len(cells)
    out = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        g = [c["pos"] - c["n"] * q for c, q in zip(cells, p, strict=True)]
        h = [c["n"] * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        tree = _grow(cells, list(range(len(cells))), features, g, h, depth, rate, smooth)
        out.append(tree)
        raw = [r + tree.score(c) for r, c in zip(raw, cells, strict=True)]
    return Boosted(base, out)


def _grow(cells, at, features, g, h, depth, rate, smooth) -> Node:
    gs, hs = sum(g[i] for i in at), sum(h[i] for i in at)
    leaf = Node(rate * max(-8.0, min(8.0, gs / (hs + smooth))))
    if depth == 0:
        return leaf
    best = (1e-6, None, 0)
    for f in features:
        sums: dict[int, list[float]] = {}
        for i in at:
            x = sums.setdefault(cells[i][f], [0.0, 0.0])
            x[0] += g[i]
            x[1] += h[i]
        gl = hl = 0.0
        for cut in sorted(sums)[:-1]:
            gl, hl = gl + sums[cut][0], hl + sums[cut][1]
            gain = gl * gl / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs * gs / (hs + smooth)
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is None:
        return leaf
    _, f, cut = best
    low, high = [i for i in at if cells[i][f] <= cut], [i for i in at if cells[i][f] > cut]
    return Node(0.0, f, cut, _grow(cells, low, features, g, h, depth - 1, rate, smooth), _grow(cells, high, features, g, h, depth - 1, rate, smooth))


def calibrate(model: Boosted, cells: list[dict], precision: float, least: float = 0.5) -> float:
    """Set and return the lowest threshold, ``least`` or more, at which ``cells`` (held out from the fit) show this
    precision with one positive and one negative added, so a few cells alone show little; over 1 if there is none."""
    scored = sorted(((model.score(c), c["pos"], c["n"]) for c in cells), key=lambda x: -x[0])
    best, pos, n, i, at = 1.01, 0, 0, 0, (0, 0)
    while i < len(scored) and scored[i][0] >= least:
        s = scored[i][0]
        while i < len(scored) and scored[i][0] == s:
            pos, n, i = pos + scored[i][1], n + scored[i][2], i + 1
        if pos + 1 >= precision * (n + 2):
            best, at = s, (pos, n)
    every = sum(c["pos"] for c in cells), sum(c["n"] for c in cells)
    model.threshold = best
    model.shown = {"positives": every[0], "negatives": every[1] - every[0], "precision": at[0] / at[1] if at[1] else None, "recall": at[0] / every[0] if every[0] else None}
    return best
