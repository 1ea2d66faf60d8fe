"""Queries of the operators in this subpackage, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.leakage import leaked_items
from tidemark.llm.mixing import mix, reached_shares, token_sizes
from tidemark.llm.quantiles import daily_sketches, merge_sketches, percentiles, quantiles_of
from tidemark.llm.runs import runs
from tidemark.llm.textstats import text_statistics
from tidemark.operators.regrid import current_usable

PROBABILITIES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each metric."""
    return percentiles(_table(spark, sf, "raw_points"), ["metric"], PROBABILITIES)


def p3_families(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each family of metrics and day, from the daily sketches of its metrics."""
    parts = daily_sketches(_table(spark, sf, "raw_points")).withColumn("family", F.substring_index("metric", ".", 2))
    return quantiles_of(merge_sketches(parts, ["family", "day"]), ["family", "day"], PROBABILITIES)


def p3_within(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each percentile of each metric lies within its bound: its rank among all usable current readings, counted exactly."""
    points = _table(spark, sf, "raw_points")
    names = [f"p{100 * p:g}" for p in PROBABILITIES]
    found = percentiles(points, ["metric"], PROBABILITIES)
    v = F.col("v")
    current = current_usable(points.where("t > 0 and metric is not null").repartitionByRange("metric", "t")).select("metric", "v")
    slack = lambda n: F.abs(F.col(n)) * 2.0**-20 + 1e-300  # noqa: E731  the values' own error
    near = current.join(found, "metric").groupBy("metric", "n", "rank_error").agg(
        F.count(F.lit(1)).alias("exact"), *(F.avg((v < F.col(n) - slack(n)).cast("double")).alias(f"{n}_below") for n in names), *(F.avg((v <= F.col(n) + slack(n)).cast("double")).alias(f"{n}_upto") for n in names)
    )
    one = [F.struct(F.lit(p).alias("p"), ((F.col(f"{n}_below") <= p + F.col("rank_error")) & (F.col(f"{n}_upto") >= p - F.col("rank_error"))).alias("within")) for p, n in zip(PROBABILITIES, names, strict=True)]
    return near.select("metric", (F.col("n") == F.col("exact")).alias("n_right"), F.explode(F.array(*one)).alias("x")).select("metric", "n_right", "x.p", "x.within")


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs(_table(spark, sf, "raw_points"), _table(spark, sf, "metric_configs")).select("metric", "t_start", "t_end", "n", "duration_ns")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs(_table(spark, sf, "raw_points"), _table(spark, sf, "metric_configs")).select("metric", "t_start", "t_end")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_sample(spark: SparkSession, sf: str) -> DataFrame:
    return mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    targets = _table(spark, sf, "mix_targets")
    return reached_shares(mix(_table(spark, sf, "documents"), targets), targets)


def p8_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the sample keeps its rules, for each source with a target: no copy twice, no document more often than allowed, and tokens
    that differ by no more than a document from the target's share (of what the sources give that aren't used up), or all that it may give."""
    documents, targets = _table(spark, sf, "documents"), _table(spark, sf, "mix_targets")
    sample = mix(documents, targets)
    by = sample.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("copy").alias("different"), F.sum("tokens").alias("tokens"))
    by = by.groupBy("source").agg(F.max("copies").alias("most"), F.max(F.col("copies") - F.col("different")).alias("twice"), F.sum("tokens").alias("tokens"))
    largest = F.max("largest").over(Window.partitionBy())
    held = token_sizes(documents).groupBy("source").agg(F.sum("tokens").alias("held"), F.max("tokens").alias("largest"))
    rows = targets.where("source is not null").join(by, "source", "left").join(held, "source", "left").fillna(0, ["most", "twice", "tokens", "held"])
    rows = rows.withColumn("used_up", F.col("tokens") >= F.col("held") * F.col("max_repeats") * 0.999)
    rest = F.sum(F.when(~F.col("used_up"), F.col("tokens"))).over(Window.partitionBy()) / F.sum(F.when(~F.col("used_up"), F.col("target_share"))).over(Window.partitionBy())  # one row a target
    return rows.select("source", (F.col("twice") == 0).alias("no_copy_twice"), (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), (F.col("used_up") | (F.abs(F.col("tokens") - rest * F.col("target_share")) <= 2 * largest)).alias("share_met"))


def p8_shards(spark: SparkSession, sf: str) -> DataFrame:
    """How many shards don't lie whole in one partition, and how many rows aren't in the order of their shard's key."""
    sample = mix(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets")).withColumn("at", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    order = F.lag("shuffle_key").over(Window.partitionBy("shard").orderBy("row"))
    by = sample.withColumn("falls", F.coalesce(F.col("shuffle_key") < order, F.lit(False))).groupBy("shard").agg(F.count_distinct("at").alias("parts"), F.count_if("falls").alias("falls"))
    return by.agg(F.count_if(F.col("parts") > 1).alias("split_shards"), F.coalesce(F.sum("falls"), F.lit(0)).alias("rows_out_of_order"))


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_statistics(_table(spark, sf, "documents"))


def p9_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that SQL can count too."""
    rounded = (F.round(c, 6).alias(c) for c in ("digit_ratio", "punctuated_lines", "duplicate_lines"))
    return text_statistics(_table(spark, sf, "documents")).select("doc_id", "n_chars", "n_lines", *rounded)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return text_statistics(_table(spark, sf, "documents")).where("not_prose").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_percentiles, p3_families, p3_within, p4_found, p4_runs, p7_found, p8_sample, p8_shares, p8_rules, p8_shards, p9_found, p9_counts, p9_statistics)}


_RUNS = """
    WITH current AS (
      SELECT metric, t, v FROM (
        SELECT metric, t, v, row_number() OVER (PARTITION BY metric, t ORDER BY arrived_at DESC, point_id DESC) AS rn FROM raw_points)
      WHERE rn = 1 AND t > 0 AND v IS NOT NULL AND isfinite(v) AND abs(v) <= 1e20),
    configured AS (
      SELECT c.metric, c.t, c.v, coalesce(e.interval_min, p.interval_min) AS interval_min, coalesce(e.deadband, p.deadband) AS deadband
      FROM current c
      LEFT JOIN metric_configs e ON e.cfg_name = c.metric AND NOT e.is_prefix
      LEFT JOIN metric_configs p ON p.is_prefix AND starts_with(c.metric, p.cfg_name || '.')),
    linked AS (
      SELECT *, CASE WHEN abs(v - lag(v) OVER w) <= deadband AND t - lag(t) OVER w <= interval_min THEN 0 ELSE 1 END AS begins
      FROM configured WINDOW w AS (PARTITION BY metric ORDER BY t)),
    grouped AS (SELECT *, sum(begins) OVER (PARTITION BY metric ORDER BY t) AS run FROM linked)
    SELECT metric, min(t) AS t_start, max(t) AS t_end{more} FROM grouped GROUP BY metric, run HAVING count(*) >= 3
"""


# What ends a line, and what is white space at its ends, as in Python.
_LINE_END = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COUNTS = rf"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split_regex(text, '{_LINE_END}')), '^{_SPACE}+', ''), '{_SPACE}+$', '') AS line FROM docs),
    kept AS (SELECT doc_id, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY doc_id, line),
    counted AS (
      SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, sum(CASE WHEN regexp_matches(line, '[.!?"''…:;)”。]$') THEN n ELSE 0 END) / sum(n) AS punctuated_lines,
        sum((n - 1) * length(line)) / sum(n * length(line)) AS duplicate_lines FROM kept GROUP BY doc_id)
    SELECT d.doc_id, length(text) AS n_chars, coalesce(n_lines, 0) AS n_lines, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) AS digit_ratio,
      round(coalesce(punctuated_lines, 0), 6) AS punctuated_lines, round(coalesce(duplicate_lines, 0), 6) AS duplicate_lines
    FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Percentiles within a bound, alignments, samples and text rules have no SQL: their tests compare with brute force. What has to hold for all percentiles and samples has."""
    usable = "SELECT metric FROM (SELECT metric, v, row_number() OVER (PARTITION BY metric, t ORDER BY arrived_at DESC, point_id DESC) AS rn FROM raw_points WHERE t > 0) WHERE rn = 1 AND v IS NOT NULL AND isfinite(v) AND abs(v) <= 1e20"
    return {
        "p3_within": f"SELECT DISTINCT metric, true AS n_right, p, true AS within FROM ({usable}), (SELECT CAST(unnest({PROBABILITIES}) AS DOUBLE) AS p)",
        "p8_rules": "SELECT source, true AS no_copy_twice, true AS within_repeats, true AS share_met FROM mix_targets WHERE source IS NOT NULL",
        "p9_counts": _COUNTS,
        "p8_shards": "SELECT CAST(0 AS BIGINT) AS split_shards, CAST(0 AS BIGINT) AS rows_out_of_order",
        "p4_found": _RUNS.format(more=""),
        "p4_runs": _RUNS.format(more=", count(*) AS n, max(t) - min(t) AS duration_ns"),
    }
