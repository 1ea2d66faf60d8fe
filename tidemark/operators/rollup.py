"""The write side: points into dense levels of closed buckets, and levels into wider ones.

A point's value covers the time before it, back to the point before. The stretch is cut at the bucket ends it
crosses; its own bucket also gets the point's count and sum. A bucket exists once a point lies at or after its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import RollupConfig
from tidemark.functions.ordered import with_previous
from tidemark.model import LEVEL_COLUMNS, VALUES, merged

#: Buckets of the lowest level that share a task, and that one step of the cutting of a long gap yields at most.
CHUNK = 4096


def lowest_level(points: DataFrame, interval: int, starts: DataFrame | None = None) -> DataFrame:
    """The closed buckets of width ``interval`` from points (metric, t, v).

    ``starts`` (metric, start) are metrics whose buckets up to ``start`` are closed already: the first point's
    stretch then begins there, and buckets before it don't appear. Times must be positive. Of points with one time all count,
    and the one of the least value takes the stretch before them.
    Null metrics are a metric of their own only in windows, not in joins, and are left out, as are null times.
    """
    seg = with_previous(points.where("metric is not null and t is not null").select("metric", "t", "v"), interval * CHUNK, then=("v",))
    if starts is not None:
        seg = seg.join(starts.select("metric", "start"), "metric", "left").withColumn("p", F.coalesce("p", "start", "t"))
    else:
        seg = seg.withColumn("p", F.coalesce("p", "t"))
    # a gap of any length is cut in two steps, so that no row holds more than its chunks or a chunk's buckets
    wide = interval * CHUNK
    cut = seg.withColumn("__chunk", F.explode(F.expr(f"sequence(p - p % {wide}, t - t % {wide}, {wide}L)")))
    cut = cut.withColumn("b", F.explode(F.expr(f"sequence(greatest(p - p % {interval}, __chunk), least(t - t % {interval}, __chunk + {wide - interval}), {interval}L)")))
    own = F.col("b") == F.expr(f"t - t % {interval}")
    d = F.least("t", F.col("b") + interval) - F.greatest("p", "b")
    return (
        cut.where(F.col("b") + interval <= F.col("last"))
        .groupBy("metric", F.col("b").alias("__b"))
        .agg(
            F.min("v").alias("mn"), F.max("v").alias("mx"), F.sum(F.when(own, F.col("v")).otherwise(0.0)).alias("s"),
            F.count(F.when(own, 1)).alias("c"), F.sum(F.col("v") * d).alias("i"), F.sum(d).alias("a"),
        )
        .select("metric", F.lit(interval).cast("bigint").alias("interval"), F.col("__b").alias("t"), *VALUES)
    )


def next_level(level: DataFrame, interval: int, last: DataFrame) -> DataFrame:
    """The closed buckets of width ``interval`` from a narrower level; ``last`` is (metric, last), the last point's time."""
    up = level.groupBy("metric", F.expr(f"t - t % {interval}").alias("__b")).agg(*merged())
    up = up.join(last, "metric").where(F.col("__b") + interval <= F.col("last"))
    return up.select("metric", F.lit(interval).cast("bigint").alias("interval"), F.col("__b").alias("t"), *VALUES)


def last_times(points: DataFrame) -> DataFrame:
    return points.where("metric is not null").groupBy("metric").agg(F.max("t").alias("last"))


def pyramid(points: DataFrame, config: RollupConfig, up_to: int | None = None) -> DataFrame:
    """All levels (or those of at most ``up_to``), each from the one below, so that each has a factor less to read."""
    last = last_times(points)
    widths = [w for w in config.levels if up_to is None or w <= up_to]
    level = lowest_level(points, widths[0])
    out = level
    for width in widths[1:]:
        level = next_level(level, width, last)
        out = out.unionByName(level)
    return out.select(*LEVEL_COLUMNS)


def one_level(points: DataFrame, config: RollupConfig, interval: int) -> DataFrame:
    """One level, through those below it."""
    if interval not in config.levels:
        raise ValueError(f"{interval} is no level")
    last, level = last_times(points), lowest_level(points, config.interval_min)
    for width in config.levels[1:]:
        if width <= interval:
            level = next_level(level, width, last)
    return level


def extend_pyramid(levels: DataFrame, points: DataFrame, config: RollupConfig, kept: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The rows to add to ``levels`` when ``points`` (all that there are, or all since the lowest level's last closed bucket) has grown.

    Each level goes on from its last closed bucket, so nothing before that is read or written again.
    ``kept`` may store what all levels are made from, the lowest one and the last times, so that the points are cut once only.
    """
    last = kept(last_times(points))
    ends = levels.groupBy("metric", "interval").agg((F.max("t") + F.max("interval")).alias("start"))
    end_of = lambda w: ends.where(F.col("interval") == w).select("metric", "start")
    low = config.interval_min
    tail = points.join(end_of(low), "metric", "left").where("start is null or t >= start").drop("start")
    new = kept(lowest_level(tail, low, end_of(low)).join(end_of(low), "metric", "left").where("start is null or t >= start").drop("start"))
    out, child = new, new
    for below, width in zip(config.levels, config.levels[1:], strict=False):
        # the child's rows, old and new, since this level's last closed bucket
        rows = levels.where(F.col("interval") == below).unionByName(child)
        rows = rows.join(end_of(width), "metric", "left").where("start is null or t >= start").drop("start")
        child = next_level(rows, width, last)
        out = out.unionByName(child)
    return out.select(*LEVEL_COLUMNS)
