"""Work on the days of all pairs of a window, in blocks, without a row for each pair and day.

A leg (window, member) is one row with its days; a block of a window's pairs is put beside the legs of that window and worked on
as two matrices, pairs by days. The pairs of a window are dealt to ``BLOCKS`` tasks, and a task holds ``CHUNK`` pairs at once, so
memory is bounded by the members of a window, and legs are sent ``BLOCKS`` times in place of once for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS, CHUNK = 8, 2048
PAIR_KEYS = ("window_id", "permno_a", "permno_b")


def leg_days(rows: DataFrame) -> DataFrame:
    """window_id, permno and the days (t) and returns of each leg, in order."""
    days = F.sort_array(F.collect_list(F.struct("t", "ret")))
    legs = rows.filter("ret IS NOT NULL").groupBy("window_id", "permno").agg(days.alias("d"))
    return legs.select("window_id", "permno", F.col("d.t").alias("t"), F.col("d.ret").alias("ret"))


def on_pairs(pairs: DataFrame, rows: DataFrame, kernel: Callable[[pd.DataFrame, np.ndarray, np.ndarray], Iterator[pd.DataFrame]], schema: str, chunk: int = CHUNK) -> DataFrame:
    """kernel(pairs, returns of legs a, returns of legs b) for chunks of pairs; NaN where a leg has no return that day."""
    dealt = pairs.withColumn("_block", F.pmod(F.xxhash64("permno_a", "permno_b"), F.lit(BLOCKS)).cast("int"))
    legs = leg_days(rows).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, left, right):
        out = []
        if len(left) and len(right):
            right = right.sort_values("permno")
            members = right["permno"].to_numpy()
            days = np.full((len(right), 1 + max(t[-1] for t in right["t"])), np.nan)
            for row, t, ret in zip(days, right["t"], right["ret"], strict=True):
                row[np.asarray(t, int)] = ret
            left = left.drop(columns="_block").sort_values(list(PAIR_KEYS)).reset_index(drop=True)
            for a in range(0, len(left), chunk):
                part = left.iloc[a : a + chunk].reset_index(drop=True)
                at = [np.minimum(np.searchsorted(members, part[f"permno_{k}"]), len(members) - 1) for k in "ab"]
                sides = [np.where((members[i] == part[f"permno_{k}"].to_numpy())[:, None], days[i], np.nan) for i, k in zip(at, "ab", strict=True)]
                out += kernel(part, *sides)
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    return dealt.groupBy("window_id", "_block").cogroup(legs.groupBy("window_id", "_block")).applyInPandas(run, schema)


def masked_quantile(v: np.ndarray, mask: np.ndarray, q: float) -> np.ndarray:
    """Interpolated quantile of each row's masked values, as a column; NaN where there are none."""
    n = mask.sum(axis=1)
    s = np.sort(np.where(mask, v, np.inf), axis=1)
    at = q * np.maximum(n - 1, 0)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, np.maximum(n - 1, 0))
    rows = np.arange(len(v))
    with np.errstate(invalid="ignore"):
        value = s[rows, low] + (at - low) * (s[rows, high] - s[rows, low])
    return np.where(n > 0, value, np.nan)[:, None]


def masked_mean(v: np.ndarray, mask: np.ndarray) -> np.ndarray:
    n = mask.sum(axis=-1)
    return np.where(n > 0, np.where(mask, v, 0.0).sum(axis=-1) / np.maximum(n, 1), np.nan)
