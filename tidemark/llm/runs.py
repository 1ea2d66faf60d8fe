"""Repeated consecutive events: symbol strings and a backreference regex.

Each task walks its slice of the ordered readings. A reading that continues its predecessor (same metric, value
within the deadband, time within the interval) is canonicalised to its predecessor's symbol, any other takes the
next symbol of a cycle, as a Unicode code point. The symbols of a batch are concatenated, the regex
``(.)\\1{2,}`` finds the repetitions, and spans map back to timestamps. A run that is still open at the end of a
batch is carried on as its start and count, so memory doesn't depend on a run's length. A task emits the first
and last run of its slice whatever their length; those few rows are joined across slices afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metric_configs import ConfigTable, load_configs
from tidemark.operators.series import blocks, ordered_versions, usable

#: The block of code points that symbols are taken from in turn: no surrogates, no line ends.
FIRST_SYMBOL, SYMBOLS = 0x4E00, 20_000
REPEATED = re.compile(r"(.)\1{2,}", re.S)
LEADING = re.compile(r"(.)\1*", re.S)
_SCHEMA = "metric string, t_start bigint, t_end bigint, n bigint, v_start double, v_end double, deadband double, gap bigint, left_open boolean, right_open boolean"


def symbols(continues: np.ndarray) -> str:
    """The symbol string of events: an event that continues the one before shares its symbol, neighbours else differ."""
    order = np.cumsum(~continues)
    return (FIRST_SYMBOL + order % SYMBOLS).astype("<u4").tobytes().decode("utf-32-le")


class _Open:
    """The run that the next reading may continue."""

    def __init__(self, metric, t0, t1, n, v0, v1, deadband, gap, left_open):
        self.metric, self.t0, self.t1, self.n, self.v0, self.v1, self.deadband, self.gap, self.left_open = metric, t0, t1, n, v0, v1, deadband, gap, left_open

    def row(self, right_open: bool) -> tuple:
        return (self.metric, self.t0, self.t1, self.n, self.v0, self.v1, self.deadband, self.gap, self.left_open, right_open)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _pieces(table: ConfigTable, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Open | None = None
        first = True
        for b in blocks(batches):
            ok = usable(b.v)
            if not ok.any():
                continue
            code, t, v = b.code[ok], b.t[ok], b.v[ok]
            found = [table.find(m) or {} for m in b.names]
            deadband = np.array([float(c.get("deadband") or 0.0) for c in found])
            gap = np.array([int(c.get("interval_min") or -1) for c in found])
            n = len(t)
            cont = np.zeros(n, bool)
            c = code[1:]
            cont[1:] = (c == code[:-1]) & (np.abs(v[1:] - v[:-1]) <= deadband[c]) & (t[1:] - t[:-1] <= gap[c])
            if held is not None and held.metric == b.names[code[0]]:
                cont[0] = abs(v[0] - held.v1) <= held.deadband and t[0] - held.t1 <= held.gap
            text = symbols(cont)
            rows: list[tuple] = []
            begin = 0
            if cont[0]:
                begin = LEADING.match(text).end()
                held.n, held.t1, held.v1 = held.n + begin, int(t[begin - 1]), float(v[begin - 1])
            if begin < n:
                if held is not None and (held.n >= least or held.left_open):
                    rows.append(held.row(False))
                tail = n - LEADING.match(text[::-1]).end()
                if first and begin == 0 and tail > 0:  # the slice's first run may go on in the slice before
                    begin = LEADING.match(text).end()
                    k = code[0]
                    rows.append((b.names[k], int(t[0]), int(t[begin - 1]), begin, float(v[0]), float(v[begin - 1]), deadband[k], int(gap[k]), True, False))
                for m in REPEATED.finditer(text, begin, tail):
                    i, j = m.span()
                    if j - i >= least:
                        k = code[i]
                        rows.append((b.names[k], int(t[i]), int(t[j - 1]), j - i, float(v[i]), float(v[j - 1]), deadband[k], int(gap[k]), False, False))
                k = code[tail]
                held = _Open(b.names[k], int(t[tail]), int(t[-1]), n - tail, float(v[tail]), float(v[-1]), float(deadband[k]), int(gap[k]), first and tail == 0)
            first = False
            if rows:
                yield _emit(rows)
        if held is not None:
            yield _emit([held.row(True)])

    return run


def runs(points: DataFrame, configs: DataFrame, least: int = 3) -> DataFrame:
    """Longest runs of at least ``least`` (3 or more) usable readings, each within deadband and interval_min of the one before.

    Returns metric, t_start, t_end, n, duration_ns, v_start, v_end.

    Nulls: rows without metric, t or v, or with t <= 0, aren't readings; NaN, infinite and absurd values are passed
    over. Of repeated or restated rows the last by (arrived_at, point_id) counts. A metric without a configuration
    has no runs. Empty input gives no rows; further columns are ignored.
    """
    if least < 3:
        raise ValueError("least must be 3 or more")
    pieces = ordered_versions(points).mapInArrow(_pieces(load_configs(configs), least), _SCHEMA)
    # Pieces open at an end belong to one group a metric (at most two a task), every other piece is its own group.
    pieces = pieces.withColumn("own", F.when(F.col("left_open") | F.col("right_open"), F.lit(0)).otherwise(F.col("t_start")))
    w = Window.partitionBy("metric", "own").orderBy("t_start")
    goes_on = (
        F.col("left_open") & F.lag("right_open").over(w)
        & (F.abs(F.col("v_start") - F.lag("v_end").over(w)) <= F.col("deadband"))
        & (F.col("t_start") - F.lag("t_end").over(w) <= F.col("gap"))
    )
    pieces = pieces.withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    pieces = pieces.withColumn("run", F.sum("begins").over(w))
    return (
        pieces.groupBy("metric", "own", "run")
        .agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.sum("n").alias("n"), F.min_by("v_start", "t_start").alias("v_start"), F.max_by("v_end", "t_end").alias("v_end"))
        .where(F.col("n") >= least)
        .select("metric", "t_start", "t_end", "n", (F.col("t_end") - F.col("t_start")).alias("duration_ns"), "v_start", "v_end")
    )
