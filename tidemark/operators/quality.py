"""Checking, repairing, thinning and copying of series. Rows, raw and of levels, have their stored position ``pos`` in the metric (and level)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DAY, RollupConfig
from tidemark.functions.ordered import with_running_max
from tidemark.operators.rollup import pyramid

ABSURD = 1e20
#: 2000-01-01: earlier first points are suspect.
GENESIS = 10_957 * DAY
#: What a fast check reads of each metric.
FAST_ROWS = 4096
#: Stored rows that share a task.
CHUNK = 1 << 20


def _value_issue(c: str) -> Column:
    v = F.col(c)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, "non_finite").when(v < -ABSURD, "too_small").when(v > ABSURD, "too_large")


def fast_part(rows: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """The last ``FAST_ROWS`` stored rows of each metric; each task keeps no more before the exchange."""
    w = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= FAST_ROWS).drop("__r")


def check_raw(rows: DataFrame, fast: bool = False) -> DataFrame:
    """metric, pos, t, issue: non_finite, too_small, too_large; non_monotonic (before the greatest time so far), duplicate (equal to it)."""
    rows = fast_part(rows) if fast else rows
    seen = with_running_max(rows.select("metric", "pos", "t", "v"), "pos", "t", CHUNK)
    order = F.when(F.col("t") < F.col("before"), "non_monotonic").when(F.col("t") == F.col("before"), "duplicate")
    issues = F.explode(F.array_compact(F.array(_value_issue("v"), order)))
    return seen.select("metric", "pos", "t", issues.alias("issue"))


def stored_ends(points: DataFrame) -> DataFrame:
    """metric, first, last: the times of the first and the last stored point, whatever their order."""
    return points.groupBy("metric").agg(F.min_by("t", "pos").alias("first"), F.max_by("t", "pos").alias("last"))


def check_levels(levels: DataFrame, ends: DataFrame, fast: bool = False) -> DataFrame:
    """metric, interval, pos, t, issue of all levels at once; ``ends`` is (metric, first, last) of the stored points.

    bogus_time: the row at position k doesn't start k widths after the bucket of the first point. non_monotonic and duplicate: against
    the greatest time stored before. non_finite: any of the values. last_row: the last stored row isn't the last closed bucket.
    """
    keys = ("metric", "interval")
    rows = fast_part(levels, keys) if fast else levels
    size = levels.groupBy(*keys).agg(F.max("pos").alias("__last"))
    seen = with_running_max(rows, "pos", "t", CHUNK, keys).join(ends, "metric").join(size, [*keys])
    bad = F.lit(False)
    for c in ("mn", "mx", "s", "i"):
        bad = bad | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    found = [
        F.when((F.col("pos") == F.col("__last")) & F.expr("t + interval <> last - last % interval"), "last_row"),
        F.when(F.expr("t <> first - first % interval + pos * interval"), "bogus_time"),
        F.when(F.col("t") < F.col("before"), "non_monotonic").when(F.col("t") == F.col("before"), "duplicate"),
        F.when(bad, "non_finite"),
    ]
    return seen.select("metric", "interval", "pos", "t", F.explode(F.array_compact(F.array(*found))).alias("issue"))


def check_metrics(points: DataFrame, levels: DataFrame, config: RollupConfig, now: int, fast: bool = False, headers: DataFrame | None = None) -> DataFrame:
    """metric, interval (0 for raw), pos, t, issue: all checks of all metrics.

    A metric without points has the issue empty_raw and no further ones. The walk up the levels ends with the first one
    in whose width the first and the last point share a bucket: it has to be without rows (not_empty), and wider ones aren't looked at.
    Below it each level is checked row by row, and may not be without rows (empty). ``headers`` (metric, interval, header_interval) are the widths that
    the files of levels are named by and say themselves (header_interval).
    """
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    ends = stored_ends(points)
    stop = F.coalesce(*(F.when(F.expr(f"first - first % {w} = last - last % {w}"), F.lit(w)) for w in config.levels), F.lit(1 << 62))
    ends = ends.withColumn("stop", stop.cast("bigint"))
    whole = [
        F.when(F.col("first") > F.col("last"), "first_after_last"),
        F.when((F.col("first") < GENESIS) | (F.col("first") > now), "first_out_of_time"),
        F.when((F.col("last") < GENESIS) | (F.col("last") > now), "last_out_of_time"),
    ]
    own = levels.where(F.col("interval").isin(*config.levels))
    walked = own.join(ends.select("metric", "stop"), "metric").where("interval < stop").drop("stop")
    per_level = own.groupBy("metric", "interval").agg(F.min("t").alias("t"))
    due = ends.select("metric", "stop", F.explode(F.array(*(F.lit(w).cast("bigint") for w in config.levels))).alias("interval"))
    parts = [
        check_raw(points, fast).select("metric", zero.alias("interval"), "pos", "t", "issue"),
        ends.select("metric", zero.alias("interval"), none.alias("pos"), F.col("first").alias("t"), F.explode(F.array_compact(F.array(*whole))).alias("issue")),
        check_levels(walked, ends.select("metric", "first", "last"), fast),
        per_level.join(ends.select("metric", F.col("stop").alias("interval")), ["metric", "interval"]).select("metric", "interval", none.alias("pos"), "t", F.lit("not_empty").alias("issue")),
        due.where("interval < stop").join(per_level, ["metric", "interval"], "left_anti").select("metric", "interval", none.alias("pos"), none.alias("t"), F.lit("empty").alias("issue")),
        levels.select("metric").distinct().join(ends, "metric", "left_anti").select("metric", zero.alias("interval"), none.alias("pos"), none.alias("t"), F.lit("empty_raw").alias("issue")),
    ]
    if headers is not None:
        wrong = headers.where("interval <> header_interval").join(ends, "metric").where("interval <= stop")
        parts.append(wrong.select("metric", "interval", none.alias("pos"), none.alias("t"), F.lit("header_interval").alias("issue")))
    return reduce(DataFrame.unionByName, parts)


def corrupt_metrics(points: DataFrame, levels: DataFrame, config: RollupConfig, now: int) -> DataFrame:
    """The metrics that a fast check finds fault with; backups are passed over."""
    kept = points.where(~F.col("metric").rlike(r"\.backup-\d+$"))
    return check_metrics(kept, levels.where(~F.col("metric").rlike(r"\.backup-\d+$")), config, now, fast=True).select("metric").distinct()


@dataclass(frozen=True)
class RepairRules:
    """What to drop: values beyond the limits, and points in any of the closed intervals; whether to take absolute values, and to keep points of a time that comes repeatedly."""

    drop_above: float | None = None
    drop_below: float | None = None
    intervals: list[tuple[int, int]] = field(default_factory=list)
    absolute: bool = False
    repeated: bool = False


def monotonic(rows: DataFrame, repeated: bool = False) -> DataFrame:
    """Drops every row whose time isn't after all times stored before it (``repeated``: nor the greatest of them)."""
    kept = with_running_max(rows.select("metric", "pos", "t", "v"), "pos", "t", CHUNK)
    after = F.col("t") >= F.coalesce("before", F.lit(1)) if repeated else F.col("t") > F.coalesce("before", F.lit(0))
    return kept.where(after).drop("before")


def repair(rows: DataFrame, rules: RepairRules) -> DataFrame:
    """The rows that pass the rules. Rows dropped for their value or time don't advance the order that later rows have to keep."""
    v, t = F.col("v"), F.col("t")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    if rules.drop_above is not None:
        ok = ok & (v <= rules.drop_above)
    if rules.drop_below is not None:
        ok = ok & (v >= rules.drop_below)
    for a, b in rules.intervals:
        ok = ok & ~t.between(a, b)
    kept = monotonic(rows.where(ok), rules.repeated)
    return kept.withColumn("v", F.abs("v")) if rules.absolute else kept


def repair_and_roll(rows: DataFrame, rules: RepairRules, config: RollupConfig) -> tuple[DataFrame, DataFrame]:
    """The repaired points and their rebuilt levels."""
    kept = repair(rows, rules)
    return kept, pyramid(kept, config)


def clone(rows: DataFrame, config: RollupConfig) -> tuple[DataFrame, DataFrame]:
    """The points in order and their levels under other settings."""
    kept = monotonic(rows)
    return kept, pyramid(kept, config)


#: Cooldowns that share a task when points are thinned out: a task holds their points.
THROTTLE_SPAN = 16


def throttle(points: DataFrame, cooldown: int) -> DataFrame:
    """Keeps a point if it is more than ``cooldown`` after the last one kept (0 before the first). Of points with one time the one of the least value counts.

    Whether a point is kept depends on the ones kept before it, but only through the last of them. So each metric is
    cut into chunks of time. Where a chunk's points are kept follows from the first one kept in it, and from where that is hardly for long: walks
    that begin at different points soon meet. A first pass walks each chunk from every point within a cooldown of its begin,
    merging walks that meet, and gives for every entry the last point kept (``exits``). A second pass, over one row a chunk, follows these from
    chunk to chunk; the third walks each chunk once from its true entry. Chunks, not metrics, are what a task gets whole.
    """
    rows = points.where("metric is not null and t > 0").select("metric", "t", "v")
    if cooldown <= 0:  # every later point is kept
        return rows.groupBy("metric", "t").agg(F.min("v").alias("v"))
    span = cooldown * THROTTLE_SPAN
    rows = rows.withColumn("chunk", F.expr(f"t div {span}")).repartition("metric", "chunk")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(pdf["t"].to_numpy())
        follow = np.searchsorted(t, t + cooldown, side="right")  # the next one kept after each
        last = np.empty(len(t), np.int64)
        for k in range(len(t) - 1, -1, -1):
            last[k] = k if follow[k] == len(t) else last[follow[k]]
        # entries: the first point at or after each time that the last one kept before the chunk can ask for
        entry = t <= pdf["chunk"].iloc[0] * span + cooldown
        if not entry.all():
            entry[np.argmin(entry)] = True  # and the first one beyond
        entries, out = t[entry], t[last[entry]]
        end = np.r_[out[1:] != out[:-1], True]  # of entries with one exit the last
        return pd.DataFrame({"metric": pdf["metric"].iloc[0], "chunk": pdf["chunk"].iloc[0], "entries": [entries[end].tolist()], "exits": [out[end].tolist()]})

    paths = rows.groupBy("metric", "chunk").applyInPandas(exits, "metric string, chunk bigint, entries array<bigint>, exits array<bigint>")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = None, 0
        for batch in batches:
            after = []
            for row in batch.to_pylist():
                if row["metric"] != name:
                    name, last = row["metric"], 0
                after.append(last)
                k = int(np.searchsorted(row["entries"], last + cooldown, side="right"))
                if k < len(row["entries"]):
                    last = row["exits"][k]
            yield pa.RecordBatch.from_arrays([batch.column("metric"), batch.column("chunk"), pa.array(after, pa.int64())], ["metric", "chunk", "after"])

    paths = paths.repartition("metric").sortWithinPartitions("metric", "chunk").mapInArrow(chain, "metric string, chunk bigint, after bigint")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "v"])
        t, after = pdf["t"].to_numpy(), int(pdf["after"].iloc[0])
        keep, i = np.zeros(len(t), bool), int(np.searchsorted(t, after + cooldown, side="right"))
        while i < len(t):
            keep[i] = True
            i = int(np.searchsorted(t, t[i] + cooldown, side="right"))
        return pdf.loc[keep, ["metric", "t", "v"]]

    return rows.join(paths, ["metric", "chunk"]).groupBy("metric", "chunk").applyInPandas(walk, "metric string, t bigint, v double")
