"""Rolling totals over trailing days: each daily total is handed to every date it influences, then calendar rows are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
#: Days of one metric that share a task before the exchange by date.
SPAN = 128


def daily_totals(levels: DataFrame) -> DataFrame:
    """The current day-level rows: metric, day (days since the epoch), s, c, i (null as 0)."""
    rows = levels.where((F.col("interval_ns") == DAY_NS) & F.col("metric").isNotNull() & F.col("t").isNotNull())
    rows = rows.withColumn("day", F.expr(f"t div {DAY_NS}")).withColumn("span", F.expr(f"day div {SPAN}"))
    # Versions of a day share its span, so the exchange is by (metric, span) and neighbouring days meet in one task.
    rows = rows.repartition("metric", "span")
    newest = F.max(F.struct("written_at", "row_id", *(F.coalesce(F.col(x), F.lit(0).cast(k)).alias(x) for x, k in (("s", "double"), ("c", "bigint"), ("i", "double")))))
    return rows.groupBy("metric", "span", "day").agg(newest.alias("now")).select("metric", "day", "now")


def trailing_totals(levels: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """For each metric and day from its first to its last active day (c > 0), totals and averages over trailing periods.

    Returns metric, day, t (day start) and for each period P: s_P, c_P, i_P (totals over the day and the P-1
    before), s_avg_P, c_avg_P, i_avg_P (per calendar day), mean_P (s_P / c_P, null without readings).

    Days without a row or readings appear with what the days before them give, or zeros. Of repeated or restated
    rows the last by (written_at, row_id) counts. Null totals count as 0; rows without metric, t or of another
    interval are ignored, metrics without an active day have no rows, further columns are ignored.
    """
    longest = max(periods)
    daily = daily_totals(levels)
    # The explode multiplies by the period, and the totals combine again before the exchange as neighbours share a task.
    reach = daily.select("metric", "now.s", "now.c", "now.i", "day", F.explode(F.sequence(F.col("day"), F.col("day") + (longest - 1))).alias("date"))
    totals = []
    for p in periods:
        inside = F.col("date") - F.col("day") < p
        totals += [F.sum(F.when(inside, F.col(x)).otherwise(F.lit(0).cast(k))).alias(f"{x}_{p}") for x, k in (("s", "double"), ("c", "bigint"), ("i", "double"))]
    rolled = reach.groupBy("metric", "date").agg(*totals)

    extent = daily.where("now.c > 0").groupBy("metric").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    calendar = extent.select("metric", F.explode(F.sequence("first", "last")).alias("date"))
    out = calendar.join(rolled, ["metric", "date"], "left")
    columns = ["metric", F.col("date").alias("day"), (F.col("date") * DAY_NS).alias("t")]
    for p in periods:
        s, c, i = (F.coalesce(F.col(f"{x}_{p}"), F.lit(0).cast(k)) for x, k in (("s", "double"), ("c", "bigint"), ("i", "double")))
        columns += [s.alias(f"s_{p}"), c.alias(f"c_{p}"), i.alias(f"i_{p}"), (s / p).alias(f"s_avg_{p}"), (c / p).alias(f"c_avg_{p}"), (i / p).alias(f"i_avg_{p}")]
        columns += [F.when(c > 0, s / F.when(c > 0, c)).alias(f"mean_{p}")]
    return out.select(*columns)
