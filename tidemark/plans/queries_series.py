"""Queries of the core operators for training data, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.anomalies import implausible_readings, score_readings
from tidemark.operators.incremental import TableRuns
from tidemark.operators.regrid import regrid
from tidemark.operators.trailing import trailing_totals
from tidemark.sources.shared import shared_path

VALUES = ["mn", "mx", "s", "c", "i", "a"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The results of the next run, from its committed batch. What came before is taken over from the log into a new manifest."""
    raw = _table(spark, sf, "raw_points").withColumn("arrived", F.col("arrived_at"))
    level = _table(spark, sf, "level_rows").withColumn("arrived", F.col("written_at"))
    job = TableRuns(spark, shared_path(spark, "ingest"))
    batch = job.run({"raw": (raw, ["metric", "t"], "point_id", ["v"]), "level": (level, ["metric", "interval_ns", "t"], "row_id", VALUES)}, _table(spark, sf, "ingest_runs"))
    return job.results(batch) if batch else spark.createDataFrame([], "feed string, row_id bigint")


def _digits(column: str, n: int):
    """So many digits of a number, off the ties: sums differ by the order of addition."""
    c = F.col(column)
    return F.when(c.isNull() | (c == 0), c).otherwise(F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))) + 0.33 * 10.0 ** -n, n - 1)).alias(column)


def _digits_sql(column: str, n: int) -> str:
    return f"CASE WHEN {column} IS NULL OR {column} = 0 THEN {column} ELSE round({column} / pow(10.0, floor(log10(abs({column})))) + {0.33 * 10.0**-n!r}, {n - 1}) END AS {column}"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return regrid(_table(spark, sf, "raw_points"), _table(spark, sf, "metric_configs"))


def p2_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid with estimates, support and marks."""
    return _grid(spark, sf).select("metric", "t", "n", _digits("value", 3), F.round("support", 5).alias("support"), "missing", "filled")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The slots of the grid that have no support of their own."""
    return _grid(spark, sf).where("missing").select("metric", "t")


def p5_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = trailing_totals(_table(spark, sf, "level_rows"))
    return totals.select("metric", "t", "c_7", "c_30", _digits("s_7", 7), _digits("s_30", 7), _digits("i_30", 7), F.round("c_avg_7", 6).alias("c_avg_7"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return trailing_totals(_table(spark, sf, "level_rows")).where("c_7 = 0 and c_30 > 0").select("metric", "t")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return implausible_readings(_table(spark, sf, "raw_points"), _table(spark, sf, "metric_configs")).select("metric", "t")


def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading with the score of its source's forest."""
    return score_readings(_table(spark, sf, "raw_points"), _table(spark, sf, "metric_configs"))


def p6_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What is implausible by the rules alone."""
    rows = implausible_readings(_table(spark, sf, "raw_points"), _table(spark, sf, "metric_configs"))
    return rows.where("impossible or frozen").select("metric", "t", "impossible", "frozen")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_grid, p5_found, p5_totals, p6_found, p6_rules, p6_scores)}


_CURRENT = """current AS (
      SELECT metric, t, v FROM (
        SELECT metric, t, v, row_number() OVER (PARTITION BY metric, t ORDER BY arrived_at DESC, point_id DESC) AS rn FROM raw_points)
      WHERE rn = 1 AND t > 0 AND v IS NOT NULL AND isfinite(v) AND abs(v) <= 1e20)"""

_CALENDAR = """
    WITH current AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, t ORDER BY written_at DESC, row_id DESC) AS rn
                     FROM level_rows WHERE interval_ns = 86400000000000) WHERE rn = 1),
    extent AS (SELECT metric, min(t) AS a, max(t) AS b FROM current WHERE c > 0 GROUP BY metric),
    calendar AS (SELECT metric, unnest(range(a, b + 1, 86400000000000)) AS t FROM extent),
    totals AS (
      SELECT k.metric, k.t,
        CAST(coalesce(sum(r.c) FILTER (WHERE r.t > k.t - 7 * 86400000000000), 0) AS BIGINT) AS c_7, CAST(coalesce(sum(r.c), 0) AS BIGINT) AS c_30,
        coalesce(sum(r.s) FILTER (WHERE r.t > k.t - 7 * 86400000000000), 0) AS s_7, coalesce(sum(r.s), 0) AS s_30, coalesce(sum(r.i), 0) AS i_30
      FROM calendar k LEFT JOIN current r ON r.metric = k.metric AND r.t <= k.t AND r.t > k.t - 30 * 86400000000000
      GROUP BY k.metric, k.t)
"""


def oracle_sql() -> dict[str, str]:
    """Forests have no SQL: their tests compare with brute force."""
    differs = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in VALUES)
    return {
        "p1_found": f"""
            WITH marks AS (SELECT feed, recorder_id, max(upto) AS mark FROM ingest_runs WHERE run_status = 'ok' GROUP BY feed, recorder_id),
            versions AS (
              SELECT 'raw' AS feed, point_id AS row_id, recorder_id, arrived_at AS arrived, lag(1) OVER w IS NULL OR v IS DISTINCT FROM lag(v) OVER w AS changed
              FROM raw_points WINDOW w AS (PARTITION BY metric, t ORDER BY arrived_at, point_id)
              UNION ALL
              SELECT 'level', row_id, recorder_id, written_at, lag(1) OVER w IS NULL OR {differs}
              FROM level_rows WINDOW w AS (PARTITION BY metric, interval_ns, t ORDER BY written_at, row_id))
            SELECT v.feed, v.row_id FROM versions v LEFT JOIN marks m ON m.feed = v.feed AND m.recorder_id = v.recorder_id
            WHERE v.changed AND (m.mark IS NULL OR v.arrived > m.mark)""",
        "p2_found": f"""
            WITH {_CURRENT},
            slots AS (
              SELECT DISTINCT c.metric, coalesce(e.interval_min, p.interval_min) AS w, c.t // coalesce(e.interval_min, p.interval_min) AS k
              FROM current c
              LEFT JOIN metric_configs e ON e.cfg_name = c.metric AND NOT e.is_prefix
              LEFT JOIN metric_configs p ON p.is_prefix AND starts_with(c.metric, p.cfg_name || '.')),
            days AS (SELECT metric, w, k * w // 86400000000000 AS day, unnest(range(min(k), max(k) + 1)) AS k FROM slots GROUP BY metric, w, k * w // 86400000000000)
            SELECT d.metric, d.k * d.w AS t FROM days d ANTI JOIN slots s ON s.metric = d.metric AND s.k = d.k""",
        # the regression by plain weighted sums over the readings near each grid point
        "p2_grid": f"""
            WITH {_CURRENT},
            readings AS (
              SELECT c.metric, c.t, c.v, coalesce(e.interval_min, p.interval_min) AS w, c.t // coalesce(e.interval_min, p.interval_min) AS k
              FROM current c
              LEFT JOIN metric_configs e ON e.cfg_name = c.metric AND NOT e.is_prefix
              LEFT JOIN metric_configs p ON p.is_prefix AND starts_with(c.metric, p.cfg_name || '.')),
            grid AS (SELECT metric, w, unnest(range(min(k), max(k) + 1)) AS k FROM readings GROUP BY metric, w, k * w // 86400000000000),
            near AS (SELECT metric, t, v, w, k AS own, k + unnest([-2, -1, 0, 1, 2]) AS k FROM readings),
            weighed AS (SELECT g.metric, g.w, g.k, n.v, n.own, CAST(n.t - g.k * g.w AS DOUBLE) / g.w - 0.5 AS d FROM grid g LEFT JOIN near n ON n.metric = g.metric AND n.k = g.k),
            sums AS (
              SELECT metric, w, k, count(*) FILTER (own = k) AS n, sum(v) FILTER (own = k) AS mine, coalesce(sum(1 - d * d / 6.25), 0) AS w0, sum((1 - d * d / 6.25) * d) AS w1, sum((1 - d * d / 6.25) * d * d) AS w2,
                sum((1 - d * d / 6.25) * v) AS v0, sum((1 - d * d / 6.25) * d * v) AS v1, coalesce(sum((1 - d * d / 6.25) * (1 - d * d / 6.25)), 0) AS ww
              FROM weighed GROUP BY metric, w, k),
            fits AS (
              SELECT metric, k * w AS t, n, mine, CASE WHEN ww > 1e-12 THEN w0 * w0 / ww ELSE 0 END AS support,
                CASE WHEN w0 * w2 - w1 * w1 > 1e-6 * w0 * w0 THEN (w2 * v0 - w1 * v1) / (w0 * w2 - w1 * w1) WHEN w0 > 1e-12 THEN v0 / w0 END AS fit FROM sums),
            out AS (SELECT metric, t, n, CASE WHEN support >= 2 - 1e-6 THEN fit WHEN n > 0 THEN mine / n END AS value, round(support, 5) AS support, n = 0 AS missing, n = 0 AND support >= 2 - 1e-6 AND fit IS NOT NULL AS filled FROM fits)
            SELECT metric, t, n, {_digits_sql("value", 3)}, support, missing, filled FROM out""",
        "p6_rules": """
            WITH series AS (
              SELECT metric, t, v FROM (
                SELECT metric, t, v, row_number() OVER (PARTITION BY metric, t ORDER BY arrived_at DESC, point_id DESC) AS rn FROM raw_points)
              WHERE rn = 1 AND t > 0 AND v IS NOT NULL),
            configured AS (
              SELECT c.metric, c.t, c.v, coalesce(e.lo, p.lo) AS lo, coalesce(e.hi, p.hi) AS hi FROM series c
              LEFT JOIN metric_configs e ON e.cfg_name = c.metric AND NOT e.is_prefix
              LEFT JOIN metric_configs p ON p.is_prefix AND starts_with(c.metric, p.cfg_name || '.') AND e.cfg_name IS NULL),
            linked AS (SELECT *, CASE WHEN v = lag(v) OVER w AND NOT isnan(v) THEN 0 ELSE 1 END AS begins FROM configured WINDOW w AS (PARTITION BY metric ORDER BY t)),
            runs AS (SELECT *, sum(begins) OVER (PARTITION BY metric ORDER BY t) AS run FROM linked),
            sized AS (SELECT *, count(*) OVER (PARTITION BY metric, run) >= 25 AS still FROM runs),
            shares AS (SELECT *, avg(CASE WHEN still THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY metric) < 0.2 AS freezes FROM sized),
            flagged AS (SELECT metric, t, NOT isfinite(v) OR abs(v) > 1e20 OR coalesce(v < lo, false) OR coalesce(v > hi, false) AS impossible, still AND freezes AS frozen FROM shares)
            SELECT metric, t, impossible, frozen FROM flagged WHERE impossible OR frozen""",
        "p5_found": _CALENDAR + "SELECT metric, t FROM totals WHERE c_7 = 0 AND c_30 > 0",
        "p5_totals": _CALENDAR + f"""SELECT metric, t, c_7, c_30, {", ".join(_digits_sql(c, 7) for c in ("s_7", "s_30", "i_30"))}, round(c_7 / 7.0, 6) AS c_avg_7 FROM totals""",
    }
