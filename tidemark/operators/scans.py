"""Scans by time with a scope at either end, over any number of metrics at once."""

from __future__ import annotations

import enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scope(enum.Enum):
    OPEN = "open"
    CLOSED = "closed"
    EXTENDED = "extended"
    INFINITY = "infinity"


OPEN, CLOSED, EXTENDED, INFINITY = Scope.OPEN, Scope.CLOSED, Scope.EXTENDED, Scope.INFINITY
Scopes = tuple[Scope, Scope]


def check_range(begin: int, end: int, scope: Scopes) -> None:
    if begin > end and INFINITY not in scope:
        raise ValueError(f"the range begins at {begin}, after its end {end}")


def _sides(begin: int, end: int, scope: Scopes) -> tuple[Column, Column]:
    """Plain comparisons for either side. An extended side has the open one: the point or row that it adds comes by itself."""
    t = F.col("t")
    left = {CLOSED: t >= begin, OPEN: t > begin, EXTENDED: t > begin, INFINITY: F.lit(True)}[scope[0]]
    right = {CLOSED: t <= end, OPEN: t < end, EXTENDED: t < end, INFINITY: F.lit(True)}[scope[1]]
    return left, right


def _outermost(rows: DataFrame, which: str) -> DataFrame:
    """The first ("min_by") or last ("max_by") row of each metric; each task keeps one a metric before the exchange."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy("metric").agg(getattr(F, which)(whole, "t").alias("__row")).select(*(F.col(f"__row.{c}").alias(c) for c in rows.columns))


def raw_scan(points: DataFrame, begin: int, end: int, scope: Scopes = (CLOSED, EXTENDED)) -> DataFrame:
    """Points (metric, t, v, ...) in a range.

    Extended reaches back to the last point at or before the begin (the first point if there is none), and on to the first point at or
    after the end (the last point if there is none). The answer is a union: what lies inside, by two comparisons with literals, and
    for each extended side the outermost point of each metric among those beyond it, by one comparison. All of these
    reach the scan, and nothing is joined.
    """
    check_range(begin, end, scope)
    left, right = _sides(begin, end, scope)
    out = points.where(left & right)
    before, after = F.col("t") <= begin, F.col("t") >= end
    if scope == (EXTENDED, EXTENDED) and begin == end:  # one point may be both
        whole = F.struct(*(F.col(c) for c in points.columns))
        ends = points.groupBy("metric").agg(F.array_distinct(F.array_compact(F.array(F.max_by(F.when(before, whole), F.when(before, F.col("t"))), F.min_by(F.when(after, whole), F.when(after, F.col("t")))))).alias("__rows"))
        return ends.select(F.explode("__rows").alias("__row")).select(*(F.col(f"__row.{c}").alias(c) for c in points.columns))
    # what lies beyond one side is within the other, except where an empty range leaves out its only time
    if scope[0] is EXTENDED:
        edge = _outermost(points.where(before), "max_by")
        out = out.unionByName(edge.where(right) if scope[1] is OPEN and begin == end else edge)
    if scope[1] is EXTENDED:
        edge = _outermost(points.where(after), "min_by")
        out = out.unionByName(edge.where(left) if scope[0] is OPEN and begin == end else edge)
    return out


def level_scan(levels: DataFrame, interval: int, begin: int, end: int, scope: Scopes = (EXTENDED, OPEN)) -> DataFrame:
    """Rows of one level in a range, compared by their starts; extended is the row that holds the begin or end, at the end also a metric's first row if all lie after it."""
    check_range(begin, end, scope)
    rows = levels.where(F.col("interval") == interval)
    left = _sides(begin - interval, end, scope)[0] if scope[0] is EXTENDED else _sides(begin, end, scope)[0]
    right = F.col("t") < end + interval if scope[1] is EXTENDED else _sides(begin, end, scope)[1]
    out = rows.where(left & right)
    if scope[1] is EXTENDED:
        out = out.unionByName(_outermost(rows, "min_by").where((F.col("t") >= end + interval) & left))
    return out


def count(points: DataFrame, begin: int | None = None, end: int | None = None, scope: Scopes = (CLOSED, EXTENDED)) -> DataFrame:
    """metric, n: the points in a range, or all; metrics without any have no row."""
    rows = points if begin is None else raw_scan(points, begin, end, scope)
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


def time_range(points: DataFrame) -> DataFrame:
    """metric, first, last."""
    return points.groupBy("metric").agg(F.coalesce(F.min("t"), F.lit(0)).alias("first"), F.coalesce(F.max("t"), F.lit(0)).alias("last"))


def metric_names(points: DataFrame) -> DataFrame:
    return points.select("metric").distinct().orderBy("metric")


def point_before_or_on(points: DataFrame, t: int) -> DataFrame:
    """metric, t, v of the last point at or before t."""
    return points.where(F.col("t") <= t).groupBy("metric").agg(F.max("t").alias("__t"), F.max_by("v", "t").alias("v")).select("metric", F.col("__t").alias("t"), "v")


def point_on_or_after(points: DataFrame, t: int) -> DataFrame:
    """metric, t, v of the first point at or after t."""
    return points.where(F.col("t") >= t).groupBy("metric").agg(F.min("t").alias("__t"), F.min_by("v", "t").alias("v")).select("metric", F.col("__t").alias("t"), "v")


def last_points(points: DataFrame) -> DataFrame:
    return points.groupBy("metric").agg(F.max("t").alias("__t"), F.max_by("v", "t").alias("v")).select("metric", F.col("__t").alias("t"), "v")


def last_rows(levels: DataFrame, interval: int) -> DataFrame:
    """The last closed bucket of each metric in a level."""
    rows = levels.where(F.col("interval") == interval)
    return rows.groupBy("metric").agg(F.max_by(F.struct(*levels.columns), "t").alias("r")).select("r.*")
