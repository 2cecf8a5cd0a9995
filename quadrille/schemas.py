"""Schemas of the engine's tables. Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions.scores import CELLS

RETURNS = "permno int, date date, ret double"
MEMBERSHIP = "permno int, mbrstartdt date, mbrenddt date"
CALENDAR = "date date"
ELIGIBILITY = "window_id int, win_start date, win_end date, permno int"
SPANS = "start date, end date"
TAXONOMY = "name string, start date, end date, type string, notes string"
_CELLS = ", ".join(f"{v}{c} double" for v in ("E", "a", "b") for c in CELLS) + ", " + ", ".join(f"N{c} long" for c in CELLS)
PAIRS = f"window_id int, win_start date, win_end date, permno_a int, permno_b int, {_CELLS}, s_odd double, delta double, ctx double, valid boolean, regime string"
HALF_EDGES = "window_id int, permno_a int, permno_b int, half string, w_s_odd double, w_e00 double, w_pooled double"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def available(df: DataFrame, *names: str) -> list[str]:
    """Those of the names that the table has, whatever their case."""
    by_lower = {c.lower(): c for c in df.columns}
    return [by_lower[n.lower()] for n in names if n.lower() in by_lower]
