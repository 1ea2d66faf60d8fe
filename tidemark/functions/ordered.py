"""Neighbours and running maxima along a long order, without a window over a whole metric.

The order is cut into chunks of the ordering value. Windows run within (key, chunk); what a chunk has to know of
the chunks before it comes from one row a chunk, so a metric with a third of all rows is spread over its chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(points: DataFrame, chunk: int, t: str = "t", keys: tuple[str, ...] = ("metric",), then: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``p``, the time of the point before (null for the first), and ``last``, the last time of the key. Points of one time are in order of ``then``."""
    points = points.withColumn("__chunk", F.expr(f"{t} div {chunk}"))
    ends = points.groupBy(*keys, "__chunk").agg(F.max(t).alias("__end"))
    over = Window.partitionBy(*keys)
    ends = ends.withColumn("__before", F.lag("__end").over(over.orderBy("__chunk"))).withColumn("last", F.max("__end").over(over)).drop("__end")
    w = Window.partitionBy(*keys, "__chunk").orderBy(t, *then)
    out = points.withColumn("__lag", F.lag(t).over(w)).join(ends, [*keys, "__chunk"])
    return out.withColumn("p", F.coalesce("__lag", "__before")).drop("__chunk", "__lag", "__before")


def with_running_max(rows: DataFrame, order: str, value: str, chunk: int, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Adds ``before``, the greatest ``value`` of all rows before this one in ``order`` (null for the first)."""
    rows = rows.withColumn("__chunk", F.expr(f"{order} div {chunk}"))
    tops = rows.groupBy(*keys, "__chunk").agg(F.max(value).alias("__top"))
    up_to = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("__earlier", F.max("__top").over(up_to)).drop("__top")
    w = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__own", F.max(value).over(w)).join(tops, [*keys, "__chunk"])
    return out.withColumn("before", F.greatest("__own", "__earlier")).drop("__chunk", "__own", "__earlier")


def with_position(rows: DataFrame, order: str, chunk: int, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Adds ``pos``, how many rows of the key come before this one in ``order``."""
    rows = rows.withColumn("__chunk", F.expr(f"{order} div {chunk}"))
    sizes = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    out = rows.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(order)) - 1).join(sizes, [*keys, "__chunk"])
    return out.withColumn("pos", F.col("__base") + F.col("__own")).drop("__chunk", "__own", "__base")
