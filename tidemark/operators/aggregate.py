"""One aggregate for a range: from the points, or from as few level rows as the grid allows and the points at the edges.

Every scan has its bounds as literals, so that it reads the part of the tables that lies in the range (and, for what
comes just before and after it, one value a metric). What is particular to a metric, where its points begin and end, is
dealt with by arithmetic on a few small frames with one row a metric.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import RollupConfig, grid_ceil, interval_begin
from tidemark.functions.ordered import with_previous
from tidemark.model import VALUES, merged
from tidemark.operators.scans import time_range
from tidemark.sources.shared import materialize

IDENTITY = {"mn": float("inf"), "mx": float("-inf"), "s": 0.0, "c": 0, "i": 0.0, "a": 0}


def _check(begin: int, end: int) -> None:
    if begin >= end:
        raise ValueError(f"the range begins at {begin}, not before its end {end}")


def _or_identity(columns: dict[str, Column]) -> list[Column]:
    return [F.coalesce(columns[c], F.lit(x)).cast("bigint" if c in "ca" else "double").alias(c) for c, x in IDENTITY.items()]


def aggregate(points: DataFrame, begin: int, end: int) -> DataFrame:
    """metric and the six columns over [begin, end) by the points alone; the identity where no point is in reach.

    A metric whose points begin or end within the range is counted from its first point on, and up to its last
    one, which is then the end and doesn't count. Three scans: the range itself, whether there is any point before it, and the first one after it.
    """
    _check(begin, end)
    points = points.select("metric", "t", "v")
    t, first = F.col("t"), F.col("p").isNull()
    near = with_previous(points.where((t >= begin) & (t < end)), max(1, (end - begin) // 64), then=("v",))
    inside = near.groupBy("metric").agg(
        F.min("v").alias("mn"), F.max("v").alias("mx"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("c"),
        F.sum(F.when(t < F.col("last"), F.col("v"))).alias("s_but_last"), F.count(F.when(t < F.col("last"), 1)).alias("c_but_last"), F.sum(F.when(~first, F.col("v") * (t - F.col("p")))).alias("i"), F.sum(F.when(~first, t - F.col("p"))).alias("a"),
        F.min("t").alias("t0"), F.max(F.when(first, F.col("v"))).alias("v0"), F.max("t").alias("t1"),
    )
    before = points.where(t < begin).groupBy("metric").agg(F.lit(True).alias("earlier"))
    after = points.where(t >= end).groupBy("metric").agg(F.min_by("v", "t").alias("next")).withColumn("later", F.lit(True))
    out = inside.join(before, "metric", "full").join(after, "metric", "full")
    some, earlier, later = F.col("c").isNotNull(), F.coalesce("earlier", F.lit(False)), F.coalesce("later", F.lit(False))
    lead = F.when(some & earlier, F.col("t0") - begin).otherwise(0)  # from the begin to the first point, if its value holds from there
    tail = F.when(later & (some | earlier), F.lit(end) - F.coalesce(F.when(some, F.col("t1")), F.lit(begin))).otherwise(0)  # from the last point to the end, by the next value
    reached = F.when(later & (some | earlier), F.col("next"))
    return out.select("metric", *_or_identity({
        "mn": F.least("mn", reached), "mx": F.greatest("mx", reached),
        "s": F.when(later, F.col("s")).otherwise(F.col("s_but_last")), "c": F.when(later, F.col("c")).otherwise(F.col("c_but_last")),
        "i": F.coalesce("i", F.lit(0.0)) + F.coalesce(F.col("v0") * lead, F.lit(0.0)) + F.coalesce(reached * tail, F.lit(0.0)), "a": F.coalesce("a", F.lit(0)) + lead + tail,
    }))


def aggregate_rows(levels: DataFrame, interval: int, begin: int, end: int) -> DataFrame:
    """metric and the six columns over the rows of one level that start in [begin, end)."""
    return levels.where((F.col("interval") == interval) & (F.col("t") >= begin) & (F.col("t") < end)).groupBy("metric").agg(*merged())


def _edge_frame(ends: DataFrame, kind: str, keep: Column, start: Column, stop: Column, held: DataFrame | None) -> DataFrame:
    """The edges of one kind: metric, kind, from, to, earlier (is there a point before), held (the next value, where a level knows it)."""
    out = ends.where(keep).select("metric", F.lit(kind).alias("kind"), start.cast("bigint").alias("from"), stop.cast("bigint").alias("to"), (F.col("first") < start).alias("earlier"))
    if held is None:
        return out.withColumn("held", F.lit(None).cast("double"))
    return out.join(held, "metric", "left")


def _edges(near: DataFrame, edges: DataFrame) -> DataFrame:
    """metric and the six columns of each edge, from the points near it (metric, kind, t, v) through the first one at or after its end.

    An edge is at most two buckets of the lowest level wide, so its points are ordered in one task. One exchange: every
    edge joins its points as a row without time, and so is there without points, too.
    """
    about = ["from", "to", "earlier", "held"]
    rows = near.join(edges, ["metric", "kind"]).where(F.col("t") >= F.col("from")).select("metric", "kind", *about, "t", "v")
    rows = rows.unionByName(edges.select("metric", "kind", *about, F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("double").alias("v")))
    rows = rows.withColumn("p", F.lag("t").over(Window.partitionBy("metric", "kind").orderBy("t", "v")))
    t, v, d = F.col("t"), F.col("v"), F.col("t") - F.col("p")
    own, beyond = t < F.col("to"), t >= F.col("to")
    out = rows.groupBy("metric", "kind", *about).agg(
        F.min(F.when(own, v)).alias("mn"), F.max(F.when(own, v)).alias("mx"), F.sum(F.when(own, v)).alias("s"), F.count(F.when(own, 1)).alias("c"), F.sum(F.when(own, v * d)).alias("i"), F.sum(F.when(own, d)).alias("a"),
        F.min(F.when(own, t)).alias("t0"), F.min_by(v, F.when(own, F.struct(t, v))).alias("v0"), F.max(F.when(own, t)).alias("t1"), F.min_by(v, F.when(beyond, F.struct(t, v))).alias("next"),
    )
    some, reached = F.col("c") > 0, F.coalesce("next", "held")
    lead = F.when(some & F.col("earlier"), F.col("t0") - F.col("from")).otherwise(0)
    tail = F.when(reached.isNull(), 0).when(some, F.col("to") - F.col("t1")).when(F.col("earlier"), F.col("to") - F.col("from")).otherwise(0)
    return out.select("metric", *_or_identity({
        "mn": F.least("mn", reached), "mx": F.greatest("mx", reached), "s": F.col("s"), "c": F.col("c"),
        "i": F.coalesce("i", F.lit(0.0)) + F.coalesce(F.col("v0") * lead, F.lit(0.0)) + F.coalesce(reached * tail, F.lit(0.0)), "a": F.coalesce("a", F.lit(0)) + lead + tail,
    }))


def aggregate_hierarchical(points: DataFrame, levels: DataFrame, config: RollupConfig, begin: int, end: int, ends: DataFrame | None = None) -> DataFrame:
    """The same as ``aggregate``, from the levels: at most two pieces of each level, and points only at the two edges.

    The levels cover [lo, hi), the grid points inside the range, for every metric up to its last closed bucket.
    Points are read in [begin, lo + width) and in [hi, hi + 2·width): what lies in the edges, and the first point
    beyond each. Where there is none in that reach, the next bucket has no points, and holds the value of the
    next one. A metric whose points end within the range has its end there: its last bucket's points are read.
    ``ends`` (metric, first, last) says where points begin and end; a store knows it, else one scan finds it.
    """
    _check(begin, end)
    width = config.interval_min
    lo, hi = grid_ceil(begin, width), interval_begin(end, width)
    if lo + 2 * width > hi:  # hardly a bucket inside
        return aggregate(points, begin, end)
    points, t = points.select("metric", "t", "v"), F.col("t")
    ends = materialize(time_range(points), "ends") if ends is None else ends.select("metric", "first", "last")
    first, last = F.col("first"), F.col("last")

    # rows of levels: inside the range, and no wider row around them that is inside it and closed
    used = F.lit(False)
    for w, up in zip(config.levels, [*config.levels[1:], None], strict=True):
        parent = F.expr(f"t - t % {up} >= {lo} and t - t % {up} + {up} <= least({end}, last)") if up else F.lit(False)
        used = used | ((F.col("interval") == w) & F.expr(f"t + {w} <= {end}") & ~parent)
    inside = levels.where(F.col("interval").isin(*config.levels) & (t >= lo) & (t < hi)).select("metric", "interval", "t", *VALUES)
    parts = inside.join(ends.select("metric", "last"), "metric").where(used).select("metric", *VALUES)

    held = lambda at: levels.where((F.col("interval") == width) & (t == at) & (F.col("c") == 0)).select("metric", F.col("mn").alias("held"))
    frames, near = [], []
    if begin < lo:
        frames.append(_edge_frame(ends, "left", (last >= lo) & (first < lo), F.lit(begin), F.lit(lo), held(lo)))
        near.append(points.where((t >= begin) & (t < lo + width)).withColumn("kind", F.lit("left")))
    if hi < end:
        frames.append(_edge_frame(ends, "right", (last >= end) & (first < end), F.lit(hi), F.lit(end), held(hi + width)))
        near.append(points.where((t >= hi) & (t < hi + 2 * width)).withColumn("kind", F.lit("right")))
    # where points end within the range: from the last grid point before, or in the left edge from the begin
    start = F.when(last >= lo, F.greatest(last - last % width, F.lit(lo))).otherwise(F.lit(begin))
    ended = _edge_frame(ends, "tail", (last < end) & (last >= begin), start, last, None)
    low, high = ended.agg(F.min("from"), F.max("to")).first()
    if low is not None:
        frames.append(ended)
        near.append(points.where((t >= low) & (t <= high)).withColumn("kind", F.lit("tail")))
    if frames:
        parts = parts.unionByName(_edges(reduce(DataFrame.unionByName, near), reduce(DataFrame.unionByName, frames)))
    nothing = ends.select("metric", *_or_identity({c: F.lit(None) for c in VALUES}))
    return parts.unionByName(nothing).groupBy("metric").agg(*merged())
