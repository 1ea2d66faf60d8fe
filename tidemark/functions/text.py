"""Readable forms of durations, times, aggregates and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import mean


def duration_text(ns: Column | str) -> Column:
    """Seconds with nanoseconds, as in 90.000000000s."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    sign = F.when(ns < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.abs(ns)
    return F.concat(sign, (whole - whole % 1_000_000_000).cast("decimal(38,0)").cast("string").substr(F.lit(1), F.greatest(F.length(whole.cast("string")) - 9, F.lit(0))), F.when(whole < 1_000_000_000, F.lit("0")).otherwise(F.lit("")), F.lit("."), F.lpad((whole % 1_000_000_000).cast("string"), 9, "0"), F.lit("s"))


def time_text(t: Column | str) -> Column:
    """UTC date and time with nanoseconds."""
    t = F.col(t) if isinstance(t, str) else t
    seconds = ((t - F.pmod(t, F.lit(1_000_000_000))) / 1_000_000_000).cast("bigint")
    stamp = F.date_format(F.from_unixtime(seconds, "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(stamp, F.lit("."), F.lpad(F.pmod(t, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


def aggregate_text() -> Column:
    """min, max, mean, count and covered time of the six columns."""
    return F.format_string("min: %s, max: %s, mean: %s, count: %s, active: %s", F.col("mn").cast("string"), F.col("mx").cast("string"), mean().cast("string"), F.col("c").cast("string"), duration_text("a"))


def row_text() -> Column:
    return F.concat(F.lit("["), time_text("t"), F.lit(" + "), duration_text("interval"), F.lit("] "), aggregate_text())
