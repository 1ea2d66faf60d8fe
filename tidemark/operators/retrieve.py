"""Reading at a wanted resolution. All operators work on any number of metrics with one configuration at once.

The plans are made before any data is read: which level a metric is answered from follows from the widths and
from one count a level, and the answer is a single DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import RollupConfig
from tidemark.functions.ordered import with_previous
from tidemark.model import LEVEL_COLUMNS, VALUES, merged
from tidemark.operators.aggregate import aggregate
from tidemark.operators.scans import CLOSED, EXTENDED, OPEN, Scopes, check_range, level_scan, raw_scan


def retrieve_points(points: DataFrame, begin: int, end: int, scope: Scopes = (CLOSED, EXTENDED)) -> DataFrame:
    """Raw points in time order."""
    return raw_scan(points, begin, end, scope).orderBy("metric", "t")


def points_as_rows(points: DataFrame, chunk: int) -> DataFrame:
    """Each point as a row of interval 0; ``a`` reaches back to the point before it among those given, 0 for the first."""
    d = F.col("t") - F.coalesce("p", "t")
    return with_previous(points.select("metric", "t", "v"), chunk).select(
        "metric", F.lit(0).cast("bigint").alias("interval"), "t", F.col("v").alias("mn"), F.col("v").alias("mx"), F.col("v").alias("s"),
        F.lit(1).cast("bigint").alias("c"), (F.col("v") * d).alias("i"), d.alias("a"),
    )


def chosen_level(levels: DataFrame, config: RollupConfig, begin: int, end: int, limit: int, scope: Scopes) -> DataFrame:
    """Rows of the widest level of at most ``limit`` that has any in the range, metric by metric; never raw points."""
    top = config.level_for(min(limit, config.interval_max))
    widths = [w for w in config.levels if top is not None and w <= top]
    if not widths:
        return levels.where("false")
    scans = [level_scan(levels, w, begin, end, scope).select(*LEVEL_COLUMNS) for w in widths]
    if len(widths) == 1:
        return scans[0]
    # levels partitioned by interval: each scan reads its own files, and the choice is one maximum a metric
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    best = out.groupBy("metric").agg(F.max("interval").alias("interval"))
    return out.join(best, ["metric", "interval"]).select(*LEVEL_COLUMNS)


def retrieve_rows(points: DataFrame, levels: DataFrame, config: RollupConfig, begin: int, end: int, interval_max: int, scope: Scopes = (EXTENDED, OPEN)) -> DataFrame:
    """Rows of width at most ``interval_max``; below the lowest level, each raw point as a row of interval 0."""
    check_range(begin, end, scope)
    if interval_max < config.interval_min:
        return points_as_rows(raw_scan(points, begin, end, scope), config.interval_min * 4096)
    return chosen_level(levels, config, begin, end, interval_max, scope)


def retrieve_samples(points: DataFrame, levels: DataFrame, config: RollupConfig, begin: int, end: int, min_samples: int, scope: Scopes = (EXTENDED, OPEN)) -> DataFrame:
    """Rows fine enough for at least ``min_samples`` of them in the range."""
    if begin > end:
        raise ValueError("the range begins after its end")
    if min_samples <= 0:
        raise ValueError("min_samples must be positive")
    return retrieve_rows(points, levels, config, begin, end, (end - begin) // min_samples, scope)


def smooth_points(points: DataFrame, begin: int, end: int, width: int) -> DataFrame:
    """Points of a scan in windows of ``width`` that start at ``begin``; the last window is clipped at ``end``.

    The first window's covered time goes back to a point before ``begin``, if the scan has one. Windows after the
    last point don't appear.
    """
    if begin >= end:
        return points.where("false").select("metric", F.lit(0).cast("bigint").alias("interval"), F.lit(0).cast("bigint").alias("t"), *[F.lit(0).cast("bigint" if c in "ca" else "double").alias(c) for c in VALUES])
    seq = with_previous(points.select("metric", "t", "v"), width * 4096)
    # of the points at or after the end only the first one counts
    seq = seq.where((F.col("t") >= begin) & (F.coalesce("p", F.lit(begin)) < end)).withColumn("p", F.coalesce("p", F.lit(begin)))
    own = F.col("t") < end
    k0 = F.expr(f"CASE WHEN p < {begin} THEN 0 ELSE (p - {begin}) div {width} END")
    k1 = F.expr(f"CASE WHEN t < {end} THEN (t - {begin}) div {width} ELSE ({end} - 1 - {begin}) div {width} END")
    cut = seq.withColumn("k1", k1).withColumn("k", F.explode(F.sequence(k0, F.col("k1"))))
    ws = F.lit(begin) + F.col("k") * width
    mine = own & (F.col("k") == F.col("k1"))
    d = F.when(mine, F.col("t")).otherwise(F.least(ws + width, F.lit(end))) - F.when(F.col("k") == 0, F.col("p")).otherwise(F.greatest("p", ws))
    return (
        cut.groupBy("metric", "k")
        .agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.sum(F.when(mine, F.col("v")).otherwise(0.0)).alias("s"), F.count(F.when(mine, 1)).alias("c"), F.sum(F.col("v") * d).alias("i"), F.sum(d).alias("a"))
        .select("metric", F.lit(width).cast("bigint").alias("interval"), (F.lit(begin) + F.col("k") * width).cast("bigint").alias("t"), *VALUES)
    )


def smooth_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Merges every ``limit div interval`` consecutive rows of a level, from the first row given. Adds ``span_ns``, the width that a row stands for."""
    first = rows.groupBy("metric", "interval").agg(F.min("t").alias("__first"))
    n = F.greatest(F.expr(f"{limit} div interval"), F.lit(1))
    out = rows.join(first, ["metric", "interval"]).withColumn("__n", n)
    out = out.withColumn("__g", F.expr("(t - __first) div (interval * __n)"))
    return out.groupBy("metric", "interval", "__n", "__g").agg(F.min("t").alias("__t"), *merged()).select(
        "metric", "interval", F.col("__t").alias("t"), *VALUES, (F.col("interval") * F.col("__n")).alias("span_ns"),
    )


def retrieve_flex(points: DataFrame, levels: DataFrame, config: RollupConfig, begin: int, end: int, limit: int, scope: Scopes = (CLOSED, EXTENDED), smooth: bool = True) -> tuple[str, DataFrame]:
    """The answer in the form that suits ``limit``: (kind, rows), kind being single, points or rows.

    limit < 0: one row for the whole range. Below the lowest level: raw points, or windows of ``limit`` for
    metrics whose points lie closer than that (as rows, with interval 0 for the single points of the others). Else rows of a level, merged up to ``limit``,
    or the settings' widest interval if that is less, if ``smooth``.
    """
    check_range(begin, end, scope)
    if limit < 0:
        one = aggregate(points, begin, end)
        return "single", one.select("metric", F.lit(end - begin).cast("bigint").alias("interval"), F.lit(begin).cast("bigint").alias("t"), *VALUES)
    if limit < config.interval_min:
        found = raw_scan(points, begin, end, scope)
        if not smooth or limit == 0:
            return "points", found.select("metric", "t", "v")
        # one decision a metric: too dense if (end - begin) div n < limit
        size = found.groupBy("metric").agg((F.expr(f"{end - begin} div count(1)") < limit).alias("dense"))
        found = found.join(size, "metric")
        sparse = points_as_rows(found.where("not dense"), config.interval_min * 4096)
        return "points", smooth_points(found.where("dense"), begin, end, limit).unionByName(sparse)
    rows = chosen_level(levels, config, begin, end, limit, scope)
    return "rows", smooth_rows(rows, min(limit, config.interval_max) if smooth else 1)
