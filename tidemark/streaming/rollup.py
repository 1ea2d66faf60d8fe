"""The pyramid as a stream: closed buckets of all levels, emitted as later points arrive.

State per metric: the last point's time and the open bucket of each level. Points have to arrive in the order of
time within a metric (within a micro-batch they are sorted), so there is no lateness to wait for and no watermark. What is to be done with
a late point is said by ``late``: "raise" fails the batch, "drop" passes over it, "mark" emits it beside the levels,
so that a sink can put it aside (``late_points``). A time that comes again is late, too; if ``repeated``, only in a
later micro-batch, so that a point delivered twice isn't counted twice.

A micro-batch is taken in whole columns: the stretches between points are cut at the bucket ends and added up
level by level. A metric's part of one micro-batch is held by one task, so the trigger's size bounds its memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark.config import RollupConfig
from tidemark.errors import OutOfOrder
from tidemark.model import LEVEL_COLUMNS, VALUES

OUTPUT = "metric string, interval bigint, t bigint, mn double, mx double, s double, c bigint, i double, a bigint"
STATE = "previous bigint, open binary"
#: The interval that marks a late point; its value is in ``s``.
LATE = -1
_MERGE = {"mn": np.fmin, "mx": np.maximum, "s": np.add, "c": np.add, "i": np.add, "a": np.add}


def _grouped(start: np.ndarray, rows: dict[str, np.ndarray], held: tuple[int, dict] | None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows in order of ``start`` merged by it, together with what is held of the first one."""
    first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
    out = {c: _MERGE[c].reduceat(x, first) for c, x in rows.items()}
    if held is not None and held[0] == start[0]:
        for c in out:
            out[c][0] = _MERGE[c](out[c][0], held[1][c])
    return start[first], out


def advance(widths: list[int], previous: int, held: list, t: np.ndarray, v: np.ndarray) -> tuple[list, list[pd.DataFrame]]:
    """Takes points in order of time: (the open bucket of each level as (start, values), the closed rows)."""
    held, closed = list(held) or [None] * len(widths), []
    p = np.r_[previous or t[0], t[:-1]]
    w = widths[0]
    n = t // w - p // w + 1
    at = np.repeat(np.arange(len(t)), n)
    b = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p // w, n)) * w
    own, value = b == t[at] // w * w, v[at]
    d = np.minimum(t[at], b + w) - np.maximum(p[at], b)
    rows = {"mn": value, "mx": value, "s": np.where(own, value, 0.0), "c": own.astype(np.int64), "i": value * d, "a": d}
    start, end = b, int(t[-1] // w * w)
    for k, w in enumerate(widths):
        start, rows = _grouped(start // w * w, rows, held[k])
        done = start + w <= end
        held[k] = None if done[-1] else (int(start[-1]), {c: x[-1] for c, x in rows.items()})
        start, rows = start[done], {c: x[done] for c, x in rows.items()}
        if not len(start):
            break
        closed.append(pd.DataFrame({"interval": w, "t": start, **rows}))
        end = int(start[-1] + w)
    return held, closed


def stream_levels(points: DataFrame, config: RollupConfig, late: str = "raise", repeated: bool = False) -> DataFrame:
    """Level rows from a stream of points (metric, t, v), in append mode. Recovery is by the checkpointed state.

    ``repeated``: all points of a time that comes several times in a micro-batch count, the one of the least value with the stretch before them.
    """
    if late not in ("raise", "drop", "mark"):
        raise ValueError(f"late points are to be raised, dropped or marked, not {late!r}")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous, held = (state.get[0], pickle.loads(state.get[1])) if state.exists else (0, [])
        pdf = pd.concat([x[["t", "v"]] for x in frames])
        pdf = pdf.sort_values(["t", "v"]) if repeated else pdf.sort_values("t", kind="stable")
        t, v = pdf["t"].to_numpy(np.int64), pdf["v"].to_numpy(float)
        good = t > max(previous, 0)
        if not repeated:
            good[1:] &= t[1:] != t[:-1]
        if not good.all():
            if late == "raise":
                raise OutOfOrder(f"time {t[~good][0]} of {key[0]} is not after {previous}")
            if late == "mark":
                x = v[~good]
                yield pd.DataFrame({"metric": key[0], "interval": LATE, "t": t[~good], "mn": x, "mx": x, "s": x, "c": 1, "i": 0.0, "a": 0})[LEVEL_COLUMNS]
            t, v = t[good], v[good]
        if len(t):
            held, closed = advance(config.levels, previous, held, t, v)
            state.update((int(t[-1]), pickle.dumps(held)))
            for rows in closed:
                yield rows.assign(metric=key[0])[LEVEL_COLUMNS]
        elif not state.exists:
            state.update((previous, pickle.dumps(held)))

    return points.select("metric", "t", "v").where("metric is not null and t is not null and v is not null").groupBy("metric").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def level_rows(out: DataFrame) -> DataFrame:
    """The level rows of a stream with marked late points."""
    return out.where(F.col("interval") != LATE).select("metric", "interval", "t", *VALUES)


def late_points(out: DataFrame) -> DataFrame:
    """metric, t, v: the late points of a stream that marks them."""
    return out.where(F.col("interval") == LATE).select("metric", "t", F.col("s").alias("v"))
