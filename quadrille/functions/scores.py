"""Scores of a 2x2 grid of regimes, as column expressions and as their NumPy twins.

Cells are ordered 00, 01, 10, 11; 0 is the large-move regime. E is the mean product of signs in a cell, a and b the
mean signs of the two legs. All expressions are null where an input is null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = ("00", "01", "10", "11")


def complete(*cols: Column) -> Column:
    """True where no column is null."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def chsh_sums(e: list[Column]) -> list[Column]:
    """The four sums of the cells with one of them negated, from the last to the first."""
    total = e[0] + e[1] + e[2] + e[3]
    return [total - 2 * e[k] for k in (3, 2, 1, 0)]


def s_odd(e: list[Column]) -> Column:
    return F.when(complete(*e), F.greatest(*[F.abs(s) for s in chsh_sums(e)]))


def delta(a: list[Column], b: list[Column]) -> Column:
    return F.abs(a[0] - a[1]) + F.abs(a[2] - a[3]) + F.abs(b[0] - b[2]) + F.abs(b[1] - b[3])


def ctx(s: Column, d: Column, n: int = 4) -> Column:
    return s - d - F.lit(float(n - 2))


def naive(s: Column) -> Column:
    """1.0 where the uncorrected score passes its bound, else (also for null) 0.0."""
    return F.when(s > 2, 1.0).otherwise(0.0)


def corrected(c: Column) -> Column:
    return F.when(c > 0, 1.0).otherwise(0.0)


def pooled_weight(e: list[Column], n: list[Column]) -> Column:
    """Mean of the cells' E weighted by their counts; null without counts."""
    top = sum((F.coalesce(x * k, F.lit(0.0)) for x, k in zip(e, n, strict=True)), F.lit(0.0))
    return F.try_divide(top, sum((F.coalesce(k, F.lit(0)) for k in n), F.lit(0)).cast("double"))


def pair_arrays(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(N, E, mean a, mean b, s_odd, delta, ctx) of signs a, b and regimes x, y; leading axes are kept.

    Days with a zero or missing sign do not count. Scores are NaN if a cell is empty.
    """
    a, b, x, y = np.broadcast_arrays(a, b, x, y)
    use = np.isfinite(a) & np.isfinite(b) & (a != 0) & (b != 0)
    n, e, ma, mb = [], [], [], []
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in (0, 1):
            for j in (0, 1):
                m = use & (x == i) & (y == j)
                k = m.sum(axis=-1)
                n.append(k)
                for out, v in ((e, a * b), (ma, a), (mb, b)):
                    out.append(np.where(m, v, 0.0).sum(axis=-1) / np.where(k > 0, k, np.nan))
        total = e[0] + e[1] + e[2] + e[3]
        s = np.max(np.abs(np.stack([total - 2 * v for v in e])), axis=0)
        d = abs(ma[0] - ma[1]) + abs(ma[2] - ma[3]) + abs(mb[0] - mb[2]) + abs(mb[1] - mb[3])
    return np.stack(n), np.stack(e), np.stack(ma), np.stack(mb), s, d, s - d - 2.0
