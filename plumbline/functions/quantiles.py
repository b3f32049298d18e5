"""Exact quantiles of columns too large to sort in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
GAP = 10_000  # values that a pass may fetch to index
FIFTHS = [0.2, 0.4, 0.6, 0.8]


@dataclass
class _Target:
    """The k-th smallest value (from 0) of a column, known to lie strictly between `lo` and `hi`."""

    column: str
    k: int
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        c = F.col(self.column)
        test = c.isNotNull()
        if self.lo is not None:
            test = test & (c > self.lo)
        if self.hi is not None:
            test = test & (c < self.hi)
        return test

    def below(self, weight: Column) -> Column:
        return F.lit(0) if self.lo is None else _weight_if(F.col(self.column) <= self.lo, weight)


def _weight_if(test: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, weight)), F.lit(0))


def _at(values: list[tuple[float, int]], k: int) -> float:
    """The k-th of (value, how often) pairs."""
    for v, n in sorted(values):
        k -= n
        if k < 0:
            return float(v)
    raise IndexError(k)


def order_statistics(df: DataFrame, wanted: list[tuple[str, int]], gap: int = GAP, weight: str | None = None) -> list[float]:
    """k-th smallest values, exactly. With `weight`, a column of whole numbers above 0, a row counts that often.

    Each pass narrows every target to the gap between two approximate quantiles around its rank (a few
    parts in ten thousand of the rows), taking the quantile itself when the rank falls on its run of equal
    values. A gap small enough is fetched and indexed. No pass holds more than `gap` values of a target. Ranks of weighted rows do
    not tell where among the rows they lie, so each pass then cuts the gap by fifths of its rows.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    targets = [_Target(c, k) for c, k in wanted]
    while open_ := [t for t in targets if t.value is None]:
        sizes = df.agg(*[x for i, t in enumerate(open_) for x in (t.below(w).alias(f"b{i}"), F.count_if(t.inside()).alias(f"m{i}"))]).first()
        small = [(t, sizes[f"b{i}"]) for i, t in enumerate(open_) if sizes[f"m{i}"] <= gap]
        if small:
            picks = [F.collect_list(F.when(t.inside(), F.struct(t.column, weight))).alias(f"v{i}") for i, (t, _) in enumerate(small)] if weight else [
                F.element_at(F.array_sort(F.collect_list(F.when(t.inside(), F.col(t.column)))), t.k - b + 1).alias(f"v{i}")
                for i, (t, b) in enumerate(small)
            ]
            for (t, b), v in zip(small, df.agg(*picks).first()):
                t.value = _at(v, t.k - b) if weight else float(v)
        large = [(t, sizes[f"b{i}"], sizes[f"m{i}"]) for i, t in enumerate(open_) if sizes[f"m{i}"] > gap]
        if not large:
            continue
        near = df.agg(
            *[
                F.percentile_approx(
                    F.when(t.inside(), F.col(t.column)),
                    FIFTHS if weight else [max(0.0, (t.k - b) / m - 2 / ACCURACY), min(1.0, (t.k - b) / m + 2 / ACCURACY)],
                    ACCURACY,
                ).alias(f"q{i}")
                for i, (t, b, m) in enumerate(large)
            ]
        ).first()
        runs = df.agg(
            *[
                _weight_if(F.col(t.column) < q if strict else F.col(t.column) <= q, w).alias(f"r{i}_{j}_{int(strict)}")
                for i, (t, _, _) in enumerate(large)
                for j, q in enumerate(near[i])
                for strict in (True, False)
            ]
        ).first()
        for i, (t, _, _) in enumerate(large):
            for j, q in enumerate(near[i]):
                first, after = runs[f"r{i}_{j}_1"], runs[f"r{i}_{j}_0"]
                if first <= t.k < after:
                    t.value = float(q)
                elif t.k >= after:
                    t.lo = q if t.lo is None else max(t.lo, q)
                else:
                    t.hi = q if t.hi is None else min(t.hi, q)
    return [float(t.value) for t in targets if t.value is not None]


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], gap: int = GAP, weight: str | None = None) -> dict[tuple[str, float], float | None]:
    """Linearly interpolated quantiles per column; None where a column has no values. Tables of any size go the same way."""
    if not columns:
        return {}
    nums = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *([weight] if weight else []))
    w = F.col(weight) if weight else F.lit(1)
    counts = nums.agg(*[_weight_if(F.col(c).isNotNull(), w).alias(c) for c in columns]).first()
    wanted: list[tuple[str, int]] = []
    for c in columns:
        for p in probabilities if counts[c] else []:
            rank = p * (counts[c] - 1)
            wanted += [(c, math.floor(rank)), (c, math.ceil(rank))]
    found = dict(zip(wanted, order_statistics(nums, wanted, gap, weight)))
    out: dict[tuple[str, float], float | None] = {}
    for c in columns:
        for p in probabilities:
            if not counts[c]:
                out[c, p] = None
                continue
            rank = p * (counts[c] - 1)
            lo, hi = found[c, math.floor(rank)], found[c, math.ceil(rank)]
            out[c, p] = lo + (hi - lo) * (rank - math.floor(rank))
    return out
