"""Schemas, and the aggregate of a stretch of time as six columns.

mn, mx: least and greatest value; s, c: sum and number of the points; i: integral in value·ns, where a value
holds for the time *before* its point; a: time covered in ns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("metric", T.StringType()), T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])
VALUES = ["mn", "mx", "s", "c", "i", "a"]
_AGGREGATE = [T.StructField(n, T.LongType() if n in "ca" else T.DoubleType()) for n in VALUES]
LEVEL = T.StructType([T.StructField("metric", T.StringType()), T.StructField("interval", T.LongType()), T.StructField("t", T.LongType()), *_AGGREGATE])
LEVEL_COLUMNS = [f.name for f in LEVEL]


def merged() -> list[Column]:
    """Aggregations that merge rows with the six columns; the identity for no rows."""
    return [
        F.coalesce(F.min("mn"), F.lit(float("inf"))).alias("mn"), F.coalesce(F.max("mx"), F.lit(float("-inf"))).alias("mx"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("c"),
        F.coalesce(F.sum("i"), F.lit(0.0)).alias("i"), F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("a"),
    ]


def mean_sum() -> Column:
    """Mean of the points; NaN if there are none."""
    return F.when(F.col("c") != 0, F.col("s") / F.when(F.col("c") != 0, F.col("c"))).otherwise(F.lit(float("nan")))


def mean_integral() -> Column:
    """Time-weighted mean; NaN if no time is covered."""
    return F.when(F.col("a") != 0, F.col("i") / F.when(F.col("a") != 0, F.col("a"))).otherwise(F.lit(float("nan")))


def mean() -> Column:
    """The time-weighted mean where time is covered, else the mean of the points."""
    return F.when(F.col("a") != 0, mean_integral()).otherwise(mean_sum())
