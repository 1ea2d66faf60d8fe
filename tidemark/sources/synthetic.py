"""A made-up metric of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dummy_points(spark: SparkSession, n: int = 600_000_000, metric: str = "dummy") -> DataFrame:
    """``n`` points of value 42, 50 ms apart, from 1 ms on."""
    return spark.range(n).select(F.lit(metric).alias("metric"), ((F.col("id") * 50 + 1) * 1_000_000).alias("t"), F.lit(42.0).alias("v"))
