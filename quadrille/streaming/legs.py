"""Scoring windows while returns arrive: each member's days wait in state until the calendar closes a window.

The state of a member is the returns of its days in windows that are still open, at most a window and what is allowed to be late.
Rows may come in any order. A window closes when the watermark has passed the end of its last day: its leg (the day masks of large, small and
positive moves, as ``pairs.legs`` makes them) is emitted then, once, and days that no open window holds are forgotten. Days later than
the watermark allows are dropped, as any late event is. Pairs are joined from finished legs, a batch table.
"""

from __future__ import annotations

import bisect
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pairs import WORD, pair_cells, with_scores, words

_STATE = "next int, place array<int>, total array<double>, n array<int>"


def leg_schema(width: int) -> str:
    return "window_id int, permno int, " + ", ".join(f"{m}_{k} long" for k in words(width) for m in ("g0", "g1", "up"))


def _quantile(v: np.ndarray, q: float) -> float:
    """As ``percentile``: weights of both neighbours, and the value itself where the place is a whole number."""
    s, at = np.sort(v), q * (len(v) - 1)
    low = int(at)
    return s[low] if low == at else (low + 1 - at) * s[low] + (at - low) * s[low + 1]


def leg_row(window_id: int, permno: int, t: np.ndarray, ret: np.ndarray, width: int, q: float) -> tuple:
    """The masks of one member's returns (places t in the window, in order)."""
    large = np.abs(ret) >= _quantile(np.abs(ret), q)
    out = [window_id, permno]
    for k in words(width):
        here = (t // WORD == k) & (ret != 0)
        out += [int(sum(1 << int(d) for d in t[here & flag] - k * WORD)) for flag in (large, ~large, ret > 0)]
    return tuple(out)


def streaming_legs(returns: DataFrame, days: list[dt.date], width: int = 60, step: int = 21, q: float = 0.5, late: str = "14 days") -> DataFrame:
    """Legs of closed windows from a stream of permno, date, ret; repeated days are averaged.

    days is the trading calendar (a row for each day there is, known beforehand); days outside it are left out.
    """
    last = [days[k + width - 1] for k in range(0, len(days) - width + 1, step)]
    # a window ends with its last day
    closes = [int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC).timestamp() * 1000) + 86_400_000 for d in last]
    names = [c.split()[0] for c in leg_schema(width).split(", ")]

    def member(key, frames, state: GroupState):
        following, places, totals, counts = state.get if state.exists else (0, [], [], [])
        held = {i: (s, n) for i, s, n in zip(places, totals, counts, strict=True)}
        for f in [] if state.hasTimedOut else frames:
            for d, r in zip(f["date"], f["ret"], strict=True):
                i = bisect.bisect_left(days, d)
                if i < len(days) and days[i] == d and i >= following * step:
                    s, n = held.get(i, (0.0, 0))
                    held[i] = (s + r, n + 1)
        out = []
        while following < len(closes) and closes[following] <= state.getCurrentWatermarkMs():
            at = sorted(i for i in held if following * step <= i < following * step + width)
            if at:
                ret = np.array([held[i][0] / held[i][1] for i in at])
                out.append(leg_row(following, key[0], np.array(at) - following * step, ret, width, q))
            following += 1
        held = {i: v for i, v in sorted(held.items()) if i >= following * step}
        if following < len(closes):
            state.update((following, list(held), [s for s, _ in held.values()], [n for _, n in held.values()]))
            state.setTimeoutTimestamp(max(closes[following], state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    rows = returns.filter("permno IS NOT NULL AND date IS NOT NULL AND ret IS NOT NULL").withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    return rows.select("permno", "date", "ret", "ts").groupBy("permno").applyInPandasWithState(member, leg_schema(width), _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def finished_pairs(spark: SparkSession, path: str, store: str, calendar: DataFrame, eligibility: DataFrame, width: int = 60, step: int = 21, n_min: int = 10, q: float = 0.5, late: str = "14 days", files_per_batch: int = 1000) -> DataFrame:
    """Runs the stream over the returns that are there now and scores the pairs of the windows that the watermark has closed.

    Run again with the same store, it takes new files only, and what it has emitted stays.
    """
    days = sorted(r["date"] for r in calendar.select("date").collect())  # small by nature: a row for each trading day
    returns = spark.readStream.schema("permno int, date date, ret double").option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    run = streaming_legs(returns, days, width, step, q, late).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)
    run.start(f"{store}/legs").awaitTermination()
    legs = spark.read.schema(leg_schema(width)).parquet(f"{store}/legs").join(eligibility.select("window_id", "permno"), ["window_id", "permno"])
    return with_scores(pair_cells(legs, width), n_min)
