"""Implausible readings: an isolation forest per source on local and seasonal features, and physical limits.

1. Each task walks its sorted slice of the readings and describes every reading by level (distance from the
   median of the readings around it), difference (how far it stands off the readings before and after), course
   (distance from the slow course of the metric at that time) and run length, all in units of the usual change
   from reading to reading at that time, on monotone steps of half a power of two. The descriptions depend on the nearest
   ``HALO`` readings only; for the readings nearest to a slice's ends they are made in a second step from
   both neighbouring slices, so that results don't depend on how the rows were cut.
2. For metrics that span ``PHASED`` days or more, season is added: the distance from what the metric has at that hour of the day, in
   units of its spread at that hour. (Shorter series have no profile by hour; there the course has to do.)
3. All readings of a source are counted by description. The forest of the source is grown and evaluated on these
   counts, so every reading has part in it and gets the score of its description, and the largest source costs
   no more than any other. A reading with a score below ``MIN_SCORE`` is no spike, whatever else holds: the forest
   proposes few of the readings, and not even most of those that stand off by half of what a spike does.
4. Explicit rules: impossible (not usable or beyond the limits of the metric's configuration) and frozen (at
   least ``FROZEN`` equal readings in a row in a metric of which such stretches are less than a fifth) hold by themselves.
   Of the forest's proposals, spikes are those that the exact check confirms: the kind of metric, the stand-off, and the return.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.forest import forest_scores
from tidemark.operators.metric_configs import ConfigTable, load_configs
from tidemark.operators.series import ordered_versions, stretches, usable
from tidemark.sources.shared import materialize

#: Readings of context on either side of a reading that is described.
HALO = 200
#: Readings in a row with exactly the same value that count as frozen.
FROZEN = 25
#: Times the usual change by which a spike stands off.
STAND_OFF = 12.0
#: Of the stand-off, the most that the readings before and after a spike may differ by.
RETURN = 0.3
#: The score from which the forest proposes a reading as a spike.
MIN_SCORE = 0.57
#: Days from which a metric has a profile by hour of the day.
PHASED = 2
#: Consecutive changes within the deadband that make a nearly constant stretch.
STEADY = 4
#: Changes that the usual change is the median of, at most, and the least that it takes.
CHANGES, LEAST_CHANGES = 61, 8

IMPOSSIBLE, IS_FROZEN, OFF = 1, 2, 4
#: The features of a description, four bits each: level, difference, course, run length, season.
FEATURES = (0, 4, 8, 12, 16)
HOUR_NS, DAY_NS = 3_600_000_000_000, 86_400_000_000_000
_SCHEMA = "metric string, t bigint, v double, cell int, flags int, kind int, slice int, part int"


def _run_ids(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between neighbours: the run of each item, and the length of each run."""
    ids = np.r_[0, np.cumsum(~same)]
    return ids, np.bincount(ids)


def _usual_change(w: np.ndarray, deadband: float) -> np.ndarray:
    """For each change between neighbours, the median of the ``CHANGES`` nearest ones; frozen and nearly constant stretches are left out. NaN where there are too few."""
    d = np.abs(np.diff(w))
    small = d <= deadband
    ids, length = _run_ids(small[1:] & small[:-1])
    keep = np.flatnonzero((d > 0) & ~(small & (length[ids] >= STEADY)))
    out = np.full(len(d), np.nan)
    if len(keep) < LEAST_CHANGES:
        return out
    half = CHANGES // 2
    med = pd.Series(d[keep]).rolling(CHANGES, center=True, min_periods=LEAST_CHANGES).median().to_numpy()
    at = np.minimum(np.searchsorted(keep, np.arange(len(d))), len(keep) - 1)
    near = np.abs(keep[at] - np.arange(len(d))) <= HALO - half
    return np.where(near, med[at], np.nan)


def _spikes(w: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each reading, the most times the usual change by which an excursion of one to three readings that it is part of stands off, and whether that is a spike by the exact rule."""
    n = len(w)
    best, exact = np.zeros(n), np.zeros(n, bool)
    for length in (1, 2, 3):
        if n < length + 2:
            break
        i = np.arange(1, n - length)
        before, after = w[i - 1], w[i + length]
        off = np.full(len(i), np.inf)
        for k in range(length):
            off = np.minimum(off, np.minimum(np.abs(w[i + k] - before), np.abs(w[i + k] - after)))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.nan_to_num(off / change[i - 1], nan=0.0, posinf=0.0)
        spike = (ratio >= STAND_OFF) & (np.abs(after - before) <= RETURN * off)
        for k in range(length):
            np.maximum.at(best, i + k, ratio)
            exact[(i + k)[spike]] = True
    return best, exact


def _steps(x: np.ndarray) -> np.ndarray:
    return np.minimum(2 * np.log2(1 + np.nan_to_num(x, nan=0.0, posinf=1e9)), 15).astype(np.int32)


def describe(t: np.ndarray, v: np.ndarray, config: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """The description (four codes of four bits) and the flags of each reading of a stretch of a metric's series."""
    config = config or {}
    lo, hi = config.get("lo"), config.get("hi")
    bad = ~usable(v)
    bad |= v < (-np.inf if lo is None or np.isnan(lo) else lo)
    bad |= v > (np.inf if hi is None or np.isnan(hi) else hi)
    flags = np.where(bad, IMPOSSIBLE, 0).astype(np.int32)
    ids, length = _run_ids(v[1:] == v[:-1])
    run = length[ids]
    flags |= np.where(run >= FROZEN, IS_FROZEN, 0).astype(np.int32)
    cell = np.full(len(v), 0xFFF, np.int32)
    good = np.flatnonzero(~bad)
    if len(good):
        w = v[good]
        level = course = best = np.zeros(len(w))
        if len(w) > 1:
            change = _usual_change(w, float(config.get("deadband") or 0.0))
            at = np.r_[change[:1], change]  # of the change that leads to the reading
            series = pd.Series(w)
            with np.errstate(divide="ignore", invalid="ignore"):
                level = np.abs(w - series.rolling(31, center=True, min_periods=1).median().to_numpy()) / at
                course = np.abs(w - series.rolling(181, center=True, min_periods=1).median().to_numpy()) / at
            best, exact = _spikes(w, change)
            if config.get("kind") in ("gauge", "counter"):
                flags[good[exact]] |= OFF
        cell[good] = _steps(level) | _steps(best) << 4 | _steps(course) << 8
    cell |= np.log2(np.minimum(run, 32)).astype(np.int32) << 12
    return cell, flags


def _edges(n: int, open_start: bool, open_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which readings of a stretch are undecided, and which go to the second step with them."""
    undecided, sent = np.zeros(n, bool), np.zeros(n, bool)
    if open_start:
        undecided[:HALO] = sent[: 2 * HALO] = True
    if open_end:
        undecided[max(0, n - HALO) :] = True
        sent[max(0, n - 2 * HALO) :] = True
    return undecided, sent


def _rows(metric: str, t, v, cell, flags, kind, at: int, part) -> pa.RecordBatch:
    n = len(t)
    ints = (pa.array(np.broadcast_to(np.asarray(x, np.int32), n)) for x in (cell, flags, kind, at, part))
    return pa.RecordBatch.from_arrays([pa.array([metric], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(t), pa.array(v), *ints], names=["metric", "t", "v", "cell", "flags", "kind", "slice", "part"])


def _describe_slice(table: ConfigTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()  # slices are ranges of (metric, t) in the order of their numbers
        name, part = None, 0
        for s in stretches(batches, HALO):
            if s.metric != name:
                name, part = s.metric, 0
            cell, flags = describe(s.t, s.v, table.find(s.metric))
            undecided, sent = _edges(len(s.t), s.open_start, s.open_end)
            done = ~undecided
            done[: s.lo] = done[s.hi :] = False
            if done.any():
                yield _rows(s.metric, s.t[done], s.v[done], cell[done], flags[done], 0, at, 0)
            if sent.any():
                # a row that doesn't follow on the row sent before it begins a new contiguous piece; part 0 goes on from the slice before
                parts = part + np.cumsum(sent & ~np.r_[s.open_start, sent[:-1]])
                part = int(parts[-1])
                kind = np.where(undecided, 1, 2)
                yield _rows(s.metric, s.t[sent], s.v[sent], cell[sent], flags[sent], kind[sent], at, parts[sent])

    return run


def describe_readings(points: DataFrame, configs: DataFrame) -> DataFrame:
    """Every reading of the series with its description (without season) and flags: metric, t, v, cell, flags. Writes a table in the shared folder."""
    table = load_configs(configs)
    out = ordered_versions(points).mapInArrow(_describe_slice(table), _SCHEMA)
    out = materialize(out.withColumn("edge", F.col("kind") > 0), "described", ("edge",))
    # the few rows at the ends of slices: contiguous pieces of at most a few HALO readings each, numbered by one row a slice
    ends = out.where("edge")
    before = Window.partitionBy("metric").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cuts = ends.groupBy("metric", "slice").agg(F.max("part").alias("parts")).select("metric", "slice", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("first"))
    ends = ends.join(cuts, ["metric", "slice"]).withColumn("piece", F.col("first") + F.col("part"))

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        cell, flags = describe(pdf["t"].to_numpy(), pdf["v"].to_numpy(float), table.find(pdf["metric"].iloc[0]))
        return pdf.assign(cell=cell, flags=flags)[(pdf["kind"] == 1).to_numpy()][["metric", "t", "v", "cell", "flags"]]

    decided = ends.groupBy("metric", "piece").applyInPandas(decide, "metric string, t bigint, v double, cell int, flags int")
    return out.where("not edge").select("metric", "t", "v", "cell", "flags").unionByName(decided)


def with_season(described: DataFrame) -> DataFrame:
    """The descriptions with their season: the distance from the mean at that hour of the day in standard deviations, 0 for metrics of less than ``PHASED`` days.

    The profiles, 24 rows a metric, are written to the shared folder, so that they are broadcast only if they are known to be small.
    """
    hour = F.expr(f"t % {DAY_NS} div {HOUR_NS}")
    good = F.col("flags").bitwiseAND(F.lit(IMPOSSIBLE)) == 0
    by = described.groupBy("metric", hour.alias("hour")).agg(F.avg(F.when(good, F.col("v"))).alias("usual"), F.stddev_pop(F.when(good, F.col("v"))).alias("spread"), F.min("t").alias("a"), F.max("t").alias("b"))
    days = (F.max("b").over(Window.partitionBy("metric")) - F.min("a").over(Window.partitionBy("metric"))) / DAY_NS
    profile = materialize(by.withColumn("days", days).where((F.col("days") >= PHASED) & (F.col("spread") > 0)).select("metric", "hour", "usual", "spread"), "profile")
    z = F.abs(F.col("v") - F.col("usual")) / F.col("spread")
    code = F.when(z.isNull(), 0).when(F.isnan(z) | (z > 200), 15).otherwise(F.least(F.floor(2 * F.log2(1 + z)), F.lit(15))).cast("int")
    out = described.withColumn("hour", hour).join(profile, ["metric", "hour"], "left")
    return out.select("metric", "t", "v", F.col("cell").bitwiseOR(F.shiftleft(code, 16)).alias("cell"), "flags")


def _score_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests for each metric of a slice of (metric, cell, n) that is sorted by metric; a metric has a bounded number of descriptions."""

    def score(metric: str, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        x = np.stack([cell >> s & 15 for s in FEATURES], axis=1).astype(float)
        s = forest_scores(x, n.astype(float), zlib.crc32(metric.encode()))
        return pa.RecordBatch.from_arrays([pa.array([metric] * len(cell)), pa.array(cell, pa.int32()), pa.array(s)], ["metric", "cell", "score"])

    name, cells, counts = None, [], []
    for batch in batches:
        metrics = batch.column("metric").to_pylist()
        cell, n = batch.column("cell").to_numpy(), batch.column("n").to_numpy()
        i = 0
        while i < len(metrics):
            j = i
            while j < len(metrics) and metrics[j] == metrics[i]:
                j += 1
            if metrics[i] != name:
                if cells:
                    yield score(name, np.concatenate(cells), np.concatenate(counts))
                name, cells, counts = metrics[i], [], []
            cells.append(cell[i:j])
            counts.append(n[i:j])
            i = j
    if cells:
        yield score(name, np.concatenate(cells), np.concatenate(counts))


def forest_by_source(described: DataFrame) -> DataFrame:
    """The score of each description that a source has: metric, cell, score."""
    counts = described.groupBy("metric", "cell").agg(F.count(F.lit(1)).alias("n"))
    tasks = int(described.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: the work is in Python, few bytes mean much of it
    return counts.repartition(tasks, "metric").sortWithinPartitions("metric", "cell").mapInArrow(_score_slice, "metric string, cell int, score double")


def frozen_metrics(described: DataFrame) -> DataFrame:
    """The metrics of whose series frozen stretches are less than a fifth (those without any are left out): metric."""
    share = F.avg((F.col("flags").bitwiseAND(F.lit(IS_FROZEN)) > 0).cast("double"))
    return described.groupBy("metric").agg(share.alias("share")).where("share > 0 and share < 0.2").select("metric")


def score_readings(points: DataFrame, configs: DataFrame) -> DataFrame:
    """Every reading of the series with the score of its source's forest: metric, t, v, score, flags."""
    described = with_season(describe_readings(points, configs))
    return described.join(forest_by_source(described), ["metric", "cell"]).select("metric", "t", "v", "score", "flags")


def implausible_readings(points: DataFrame, configs: DataFrame) -> DataFrame:
    """The implausible readings: metric, t, v, score, impossible, frozen, spike.

    Nulls: rows without metric, t or v, or with t <= 0, aren't readings. Of repeated or restated rows the last by
    (arrived_at, point_id) counts. A metric without a configuration has no limits, a deadband of 0 and no spikes.
    Empty input gives no rows; a metric with fewer than ``LEAST_CHANGES`` changes has no spikes; further columns are ignored.
    """
    described = with_season(describe_readings(points, configs))
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) > 0
    flagged = described.where("flags > 0")
    out = (
        flagged.join(forest_by_source(described), ["metric", "cell"])
        .join(frozen_metrics(described).withColumn("__freezes", F.lit(True)), "metric", "left")
        .select(
            "metric", "t", "v", "score", has(IMPOSSIBLE).alias("impossible"),
            (has(IS_FROZEN) & F.coalesce("__freezes", F.lit(False))).alias("frozen"),
            (has(OFF) & (F.col("score") >= MIN_SCORE)).alias("spike"),
        )
    )
    return out.where("impossible or frozen or spike")
