"""Irregular readings onto a regular grid: compact-kernel weighted local linear regression at each slot's middle.

Readings are indexed by slot, ``k = t div interval``. With an Epanechnikov kernel whose half-width is
``radius + 1/2`` slots, the support around the middle of slot k is exactly the slots k-radius .. k+radius. The
kernel is a polynomial, so each slot's readings enter the regression at any nearby middle through a few moments
of (distance, value) only. The readings are exchanged once, by ranges of (metric, t), so that all versions of one
share a task and a slot of a fast metric may be cut across tasks; moments are summed within each task
before the next exchange. Each occupied slot then hands its moments to the 2·radius+1 grid points it influences,
and no reading is ever compared with another.

A grid point gets the estimate, the effective support (Σw)²/Σw² of the readings under the kernel, the part of it
that lies in the slot itself (``own_support``), and marks: ``missing`` where the own support is below
``least_own`` readings, and ``filled`` where it is missing but the support is enough for an estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metric_configs import attach_configs
from tidemark.operators.series import is_usable

DAY_NS = 86_400_000_000_000


def current_usable(points: DataFrame) -> DataFrame:
    """The usable current readings."""
    w = Window.partitionBy("metric", "t").orderBy(F.col("arrived_at").desc_nulls_last(), F.col("point_id").desc_nulls_last())
    return points.withColumn("__rank", F.row_number().over(w)).where((F.col("__rank") == 1) & is_usable()).drop("__rank")


def regrid(points: DataFrame, configs: DataFrame, radius: int = 2, min_support: float = 2.0, least_own: float = 1.0) -> DataFrame:
    """One row per metric, UTC day and slot between the day's first and last occupied slot.

    Returns metric, t (slot start), interval_min, n (usable readings in the slot), value, support, own_support, missing, filled. ``value`` is
    the local linear estimate at the slot's middle (the local mean where all the readings under the kernel share
    one time) and null where ``support`` is below ``min_support``, except that a slot with a reading of its own always has a value.
    One reading alone has a support of 1, so with ``least_own`` of 1 a slot is missing if it has none; a higher one asks for more.

    Nulls: rows without metric, t or v, with t <= 0, or of a metric without a configuration are no readings; NaN,
    infinite and absurd values aren't usable. Of repeated or restated rows the last by (arrived_at, point_id) counts.
    Empty input gives no rows; further columns are ignored.
    """
    base = attach_configs(points.select("metric", "t", "v", "arrived_at", "point_id"), configs, ["interval_min"])
    base = base.where("t > 0 and metric is not null and interval_min > 0").withColumn("slot", F.expr("t div interval_min"))
    readings = current_usable(base.repartitionByRange("metric", "t"))

    # distance from the slot's middle in slots, and moments of it
    x = F.expr("(cast(t - slot * interval_min as double) / interval_min) - 0.5")
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(F.pow("x", F.lit(float(p)))).alias(f"m{p}") for p in range(1, 5)]
    sums += [F.sum(F.col("v") * F.pow("x", F.lit(float(p)))).alias(f"y{p}") for p in range(4)]
    slots = readings.withColumn("x", x).groupBy("metric", "slot", "interval_min").agg(*sums)

    # a day holds at most a day's slots, however many readings: a bounded group
    slots = slots.withColumn("day", F.expr(f"slot * interval_min div {DAY_NS}"))
    w = Window.partitionBy("metric", "day").orderBy("slot")
    slots = slots.withColumn("until", F.coalesce(F.lead("slot").over(w) - 1, F.col("slot")))

    # each occupied slot yields the grid points up to the next one of its day, and a part for each it influences
    target = F.concat(
        F.transform(F.sequence("slot", "until"), lambda k: F.struct(k.alias("k"), F.lit(True).alias("grid"))),
        F.transform(F.sequence(F.col("slot") - radius, F.col("slot") + radius), lambda k: F.struct(k.alias("k"), F.lit(False).alias("grid"))),
    )
    parts = slots.withColumn("to", F.explode(target)).select(
        "metric", "interval_min", F.col("to.k").alias("k"), F.col("to.grid").alias("grid"),
        (F.col("slot") - F.col("to.k")).cast("double").alias("s"), "n", *(f"m{p}" for p in range(1, 5)), *(f"y{p}" for p in range(4)),
    )
    # moments about the target's middle, d = x + s, by the binomial rule
    m = [F.col("n").cast("double"), *(F.col(f"m{p}") for p in range(1, 5))]
    y = [F.col(f"y{p}") for p in range(4)]
    s = F.col("s")
    d1 = m[1] + s * m[0]
    d2 = m[2] + 2 * s * m[1] + s * s * m[0]
    d3 = m[3] + 3 * s * m[2] + 3 * s * s * m[1] + s * s * s * m[0]
    d4 = m[4] + 4 * s * m[3] + 6 * s * s * m[2] + 4 * s * s * s * m[1] + s * s * s * s * m[0]
    e1 = y[1] + s * y[0]
    e2 = y[2] + 2 * s * y[1] + s * s * y[0]
    e3 = y[3] + 3 * s * y[2] + 3 * s * s * y[1] + s * s * s * y[0]
    h2 = float((radius + 0.5) ** 2)
    part = lambda c: F.sum(F.when(~F.col("grid"), c))
    points_ = parts.groupBy("metric", "interval_min", "k").agg(
        F.max("grid").alias("on_grid"),
        F.coalesce(F.sum(F.when(~F.col("grid") & (s == 0), F.col("n"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~F.col("grid") & (s == 0), y[0])), F.lit(0.0)).alias("own"),
        part(m[0] - d2 / h2).alias("w0"), part(d1 - d3 / h2).alias("w1"), part(d2 - d4 / h2).alias("w2"),
        part(y[0] - e2 / h2).alias("v0"), part(e1 - e3 / h2).alias("v1"),
        part(m[0] - 2 * d2 / h2 + d4 / (h2 * h2)).alias("ww"),
        F.sum(F.when(~F.col("grid") & (s == 0), m[0] - d2 / h2)).alias("o0"), F.sum(F.when(~F.col("grid") & (s == 0), m[0] - 2 * d2 / h2 + d4 / (h2 * h2))).alias("oo"),
    ).where("on_grid")
    effective = lambda w, ww: F.when(F.col(ww) > 1e-12, F.col(w) * F.col(w) / F.col(ww)).otherwise(F.lit(0.0))
    missing = F.col("own_support") < least_own - 1e-6
    det = F.expr("w0 * w2 - w1 * w1")
    fit = F.when(det > F.expr("1e-6 * w0 * w0"), F.expr("(w2 * v0 - w1 * v1)") / F.when(det > 0, det)).when(F.col("w0") > 1e-12, F.expr("v0 / nullif(w0, 0)"))
    enough = F.col("support") >= min_support - 1e-6
    return (
        points_.withColumn("support", effective("w0", "ww"))
        .withColumn("own_support", effective("o0", "oo"))
        .withColumn("fit", fit)
        .select(
            "metric", F.expr("k * interval_min").alias("t"), "interval_min", "n",
            F.when(enough, F.col("fit")).when(F.col("n") > 0, F.col("own") / F.col("n")).alias("value"), "support", "own_support",
            missing.alias("missing"), (missing & enough & F.col("fit").isNotNull()).alias("filled"),
        )
    )
