"""Queries of the time-series operators over the whole events and orders tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DAY, SECOND, RollupConfig
from tidemark.functions.ordered import with_position
from tidemark.functions.text import duration_text, row_text, time_text
from tidemark.model import LEVEL, LEVEL_COLUMNS, RAW, mean, mean_integral, mean_sum
from tidemark.operators import aggregate as agg
from tidemark.operators import quality, retrieve, rollup, scans
from tidemark.operators.scans import CLOSED, EXTENDED, INFINITY, OPEN
from tidemark.sources.binary import describe_files, read_records, write_records
from tidemark.sources.catalog import Catalog
from tidemark.sources.shared import shared_dir, shared_path
from tidemark.sources.synthetic import dummy_points

HOUR = 3600 * SECOND
CONFIG = RollupConfig(HOUR, 24 * DAY, 24)
WEEKS = RollupConfig(7 * DAY, 343 * DAY, 7)
#: 2024-01-05 03:30 and 2024-01-20 17:45; a narrow range; before all data
B, E = 1_704_425_400 * SECOND, 1_705_772_700 * SECOND
NB, NE = 1_704_700_000 * SECOND, 1_704_703_000 * SECOND
EARLY = 1_600_000_000 * SECOND
LATE = 1_900_000_000 * SECOND
SPLIT = 1_705_000_000 * SECOND
COOLDOWN = 2 * HOUR
DENSE = 3000 * SECOND
#: 1995-06-01
MIDDLE = 801_964_800 * SECOND
NAMES = {"open": OPEN, "closed": CLOSED, "extended": EXTENDED, "infinity": INFINITY}


# --- tables -------------------------------------------------------------------------------------------------------


def _nanos(column: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) * 1000")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("metric"), _nanos("ts").alias("t"), F.col("value").alias("v"))


def user_points(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("metric"), _nanos("ts").alias("t"), F.col("value").alias("v"))


def order_points(spark: SparkSession, sf: str) -> DataFrame:
    """Ties within a day are added up first: times must be unique."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(_nanos("o_orderdate").alias("t"), "o_totalprice")
    return orders.groupBy("t").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v")).select(F.lit("orders").alias("metric"), "t", "v")


def faulty_points(spark: SparkSession, sf: str) -> DataFrame:
    """The events with faults: values that aren't readings, and times that go back."""
    v = F.expr("CASE WHEN event_id % 97 = 0 THEN double('NaN') WHEN event_id % 89 = 0 THEN 1e21D WHEN event_id % 83 = 0 THEN -1e21D WHEN event_id % 71 = 0 THEN -value ELSE value END")
    t = F.when(F.col("event_id") % 79 == 0, F.col("t") - 6 * HOUR).otherwise(F.col("t"))
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", _nanos("ts"))
    return rows.select(F.col("event_type").alias("metric"), F.col("event_id").alias("pos"), t.alias("t"), v.alias("v"))


YEARS = RollupConfig(7 * DAY, 7 * 7**4 * DAY, 7)


def _top_row(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("orders", 7 * 7**4 * DAY, 0, 1.0, 1.0, 1.0, 1, 1.0, 1, 0)], "metric string, interval bigint, t bigint, mn double, mx double, s double, c bigint, i double, a bigint, pos bigint")


def _headers(spark: SparkSession) -> DataFrame:
    """What the files of levels say their widths are: one is wrong, and one of a width that the walk doesn't come to."""
    return spark.createDataFrame([("orders", 7 * DAY, 7 * DAY), ("orders", 49 * DAY, 50 * DAY), ("orders", 2 * 7**5 * DAY, 1)], "metric string, interval bigint, header_interval bigint")


RULES = quality.RepairRules(drop_above=150.0, drop_below=-50.0, intervals=[(NB, NE), (SPLIT, SPLIT + 2 * HOUR)], absolute=True)


_stores: dict[tuple[str, ...], str] = {}


def _store(spark: SparkSession, sf: str) -> str:
    """The events and their pyramid as stored tables, built once in an application: raw points and levels (a folder an interval) in order of metric and time, and where points begin and end."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        at, rows = shared_path(spark, "pyramid"), points(spark, sf)
        rollup.pyramid(rows, CONFIG).repartition("interval").sortWithinPartitions("interval", "metric", "t").write.partitionBy("interval").parquet(f"{at}/levels")
        rows.repartitionByRange("metric", "t").sortWithinPartitions("metric", "t").write.parquet(f"{at}/raw")
        scans.time_range(rows).coalesce(1).write.parquet(f"{at}/ends")
        _stores[key] = at
    return _stores[key]


def _levels(spark, sf) -> DataFrame:
    """The stored levels."""
    return spark.read.schema(LEVEL).parquet(f"{_store(spark, sf)}/levels").select(*LEVEL_COLUMNS)


def _raw(spark, sf) -> DataFrame:
    """The stored points."""
    return spark.read.schema(RAW).parquet(f"{_store(spark, sf)}/raw")


def _ends(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{_store(spark, sf)}/ends")


def _positioned(levels: DataFrame) -> DataFrame:
    """Level rows with their stored position, here that in order of time."""
    return with_position(levels, "t", DAY * 365, ("metric", "interval"))


def _faulty_levels(spark, sf) -> DataFrame:
    """The stored levels with faults: rows that are left out, repeated, moved to another place or not finite. The daily level of one metric is empty, one metric has no points."""
    rows = _positioned(_levels(spark, sf)).where(f"not (interval = {HOUR} and pos % 50 = 7) and not (interval = {DAY} and metric = 'view')")
    rows = rows.withColumn("pos", F.when((F.col("interval") == DAY) & (F.col("pos") % 9 < 2), F.col("pos") + 1 - 2 * (F.col("pos") % 9)).otherwise(F.col("pos")))
    rows = rows.withColumn("s", F.when((F.col("interval") == HOUR) & (F.col("pos") % 61 == 5), float("inf")).otherwise(F.col("s")))
    extra = rows.where(f"interval = {24 * DAY}").limit(0).unionByName(rows.where(f"interval = {DAY} and metric = 'click'").withColumn("metric", F.lit("orphan")))
    return rows.unionByName(extra)


def shaped(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of rows as they are compared: sums rounded beyond the order of addition."""
    columns = [c for c in ("metric", "interval", "t") if c in rows.columns]
    return rows.select(*columns, "mn", "mx", F.round("s", 4).alias("s"), "c", F.round(F.col("i") / 1e9, 2).alias("i_s"), "a", *more)


# --- queries ------------------------------------------------------------------------------------------------------


def _rollup(interval):
    return lambda spark, sf: shaped(rollup.one_level(points(spark, sf), CONFIG, interval))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.streaming.rollup import stream_levels

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select(F.col("event_type").alias("metric"), _nanos("ts").alias("t"), F.col("value").alias("v"))
    at = shared_path(spark, "stream")
    query = stream_levels(rows, CONFIG, repeated=True).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return shaped(spark.read.parquet(f"{at}/rows"))


def _restarted(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that is stopped between two deliveries and goes on from its checkpoint. The second delivery has all points from SPLIT on, and those of two days before, which are late."""
    from tidemark.streaming.rollup import stream_levels

    at, all_ = shared_path(spark, "restarted"), points(spark, sf)
    for part in (all_.where(F.col("t") < SPLIT), all_.where(F.col("t") >= SPLIT - 2 * DAY)):
        part.write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(all_.schema).parquet(f"{at}/in")
        query = stream_levels(rows, CONFIG, "mark").writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
        query.awaitTermination()
    return spark.read.parquet(f"{at}/rows")


def _stream_restarted(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.streaming.rollup import level_rows

    return shaped(level_rows(_restarted(spark, sf)))


def _stream_late(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.streaming.rollup import late_points

    return late_points(_restarted(spark, sf))


def _stream_order(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a stream that is told to raise fails on a late point."""
    from pyspark.errors import StreamingQueryException

    from tidemark.streaming.rollup import stream_levels

    at, all_ = shared_path(spark, "order"), points(spark, sf)
    outcome = []
    for name, part in (("in order", all_.where(F.col("t") < SPLIT)), ("late", all_.where(F.col("t").between(SPLIT - 2 * DAY, SPLIT)))):
        part.write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(all_.schema).parquet(f"{at}/in")
        query = stream_levels(rows, CONFIG).writeStream.format("noop").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            outcome.append((name, "taken"))
        except StreamingQueryException as e:
            outcome.append((name, "OutOfOrder" if "OutOfOrder" in str(e) else str(e)))
    return spark.createDataFrame(outcome, "delivery string, outcome string")


def _incremental(spark, sf) -> DataFrame:
    """Levels of the first part of the points, gone on with when all are there."""
    all_ = points(spark, sf)
    old = rollup.pyramid(all_.where(F.col("t") < SPLIT), CONFIG)
    return shaped(old.unionByName(rollup.extend_pyramid(old, all_, CONFIG)))


def _files(spark: SparkSession, sf: str) -> str:
    """The events and their hourly level as binary files, written once in an application."""
    key = (spark.sparkContext.applicationId, sf, "files")
    if key not in _stores:
        at, rows = shared_path(spark, "records"), points(spark, sf)
        write_records(rows, at, CONFIG)
        write_records(_levels(spark, sf), at, CONFIG, HOUR)
        _stores[key] = at
    return _stores[key]


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The levels of a stored metric that was inserted in two parts."""
    import uuid

    config = {"type": "file", "path": f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", "metrics": {"orders": {"prefix": True, **WEEKS.to_dict()}}}
    metric = Catalog.from_config(spark, config)["orders.total"]
    rows = order_points(spark, sf)
    metric.insert(rows.where(F.col("t") < MIDDLE))
    metric.insert(rows.where(F.col("t") >= MIDDLE))
    return shaped(metric.levels()).withColumn("i_s", F.round("i_s", 0))  # integrals of whole days are whole numbers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "rollup_hourly": _rollup(HOUR),
        "rollup_daily": _rollup(DAY),
        "rollup_24d": _rollup(24 * DAY),
        "rollup_pyramid": lambda s, d: shaped(rollup.pyramid(points(s, d), CONFIG)),
        "stored_pyramid": lambda s, d: shaped(_levels(s, d)),
        "rollup_by_user": lambda s, d: shaped(rollup.one_level(user_points(s, d), CONFIG, DAY)),
        "rollup_orders_weekly": lambda s, d: shaped(rollup.one_level(order_points(s, d), WEEKS, 49 * DAY)),
        "rollup_incremental": _incremental,
        "range_per_metric": lambda s, d: scans.time_range(_raw(s, d)),
        "count_all": lambda s, d: scans.count(_raw(s, d)),
        "metric_names": lambda s, d: scans.metric_names(points(s, d)),
        "last_point": lambda s, d: scans.last_points(_raw(s, d)),
        "last_row": lambda s, d: shaped(scans.last_rows(_levels(s, d), DAY)),
        "point_before_or_on": lambda s, d: scans.point_before_or_on(_raw(s, d), B),
        "point_on_or_after": lambda s, d: scans.point_on_or_after(_raw(s, d), B),
        "retrieve_min_samples": lambda s, d: shaped(retrieve.retrieve_samples(_raw(s, d), _levels(s, d), CONFIG, B, E, 100)),
        "retrieve_raw_rows": lambda s, d: shaped(retrieve.retrieve_rows(_raw(s, d), _levels(s, d), CONFIG, B, E, HOUR - 1, (CLOSED, EXTENDED))),
        "flex_raw": lambda s, d: retrieve.retrieve_flex(_raw(s, d), _levels(s, d), CONFIG, B, E, 60 * SECOND, smooth=False)[1],
        "flex_level": lambda s, d: shaped(retrieve.retrieve_flex(_raw(s, d), _levels(s, d), CONFIG, B, E, 5 * HOUR, (EXTENDED, OPEN), smooth=False)[1]),
        "flex_smooth_level": lambda s, d: shaped(retrieve.retrieve_flex(_raw(s, d), _levels(s, d), CONFIG, B, E, 5 * HOUR, (EXTENDED, OPEN))[1], "span_ns"),
        "flex_single": lambda s, d: shaped(retrieve.retrieve_flex(_raw(s, d), _levels(s, d), CONFIG, B, E, -1)[1]),
        "flex_fallback": lambda s, d: shaped(retrieve.retrieve_flex(_raw(s, d), _levels(s, d), CONFIG, E, LATE, 365 * DAY, (CLOSED, EXTENDED), smooth=False)[1]),
        "flex_clamped": lambda s, d: shaped(retrieve.retrieve_flex(_raw(s, d), _levels(s, d), CONFIG, EARLY, LATE, 365 * DAY, (EXTENDED, OPEN))[1], "span_ns"),
        "flex_dense": lambda s, d: shaped(retrieve.retrieve_flex(_raw(s, d), _levels(s, d), CONFIG, B, E, DENSE)[1]),
        "smooth_raw": lambda s, d: shaped(retrieve.smooth_points(scans.raw_scan(_raw(s, d), B, E, (EXTENDED, EXTENDED)), B, E, 5000 * SECOND)),
        "smooth_levels": lambda s, d: shaped(retrieve.smooth_rows(scans.level_scan(_levels(s, d), HOUR, B, E), 7 * HOUR), "span_ns"),
        "aggregate_range": lambda s, d: shaped(agg.aggregate(_raw(s, d), B, E)),
        "aggregate_hierarchical": lambda s, d: shaped(agg.aggregate_hierarchical(_raw(s, d), _levels(s, d), CONFIG, B, E, _ends(s, d))),
        "aggregate_narrow": lambda s, d: shaped(agg.aggregate_hierarchical(_raw(s, d), _levels(s, d), CONFIG, NB, NE, _ends(s, d))),
        "aggregate_clamped": lambda s, d: shaped(agg.aggregate_hierarchical(_raw(s, d), _levels(s, d), CONFIG, EARLY, LATE)),
        "aggregate_by_user": lambda s, d: shaped(agg.aggregate_hierarchical(user_points(s, d), rollup.pyramid(user_points(s, d), CONFIG), CONFIG, B, E)),
        "aggregate_before_data": lambda s, d: shaped(agg.aggregate(_raw(s, d), EARLY, EARLY + DAY)),
        "aggregate_rows": lambda s, d: shaped(agg.aggregate_rows(_levels(s, d), DAY, B, E)),
        "means": lambda s, d: agg.aggregate(_raw(s, d), B, E).select("metric", F.round(mean_sum(), 6).alias("mean_sum"), F.round(mean_integral(), 6).alias("mean_integral"), F.round(mean(), 6).alias("mean")),
        "check_raw_issues": lambda s, d: quality.check_raw(faulty_points(s, d)),
        "check_raw_fast": lambda s, d: quality.check_raw(faulty_points(s, d), fast=True),
        "check_level_rows": lambda s, d: quality.check_levels(_faulty_levels(s, d), _ends(s, d)),
        "check_level_fast": lambda s, d: quality.check_levels(_faulty_levels(s, d), _ends(s, d), fast=True),
        "check_metrics": lambda s, d: quality.check_metrics(faulty_points(s, d), _faulty_levels(s, d), CONFIG, LATE).fillna(-1, ["pos", "t"]),
        "check_metrics_walk": lambda s, d: quality.check_metrics(order_points(s, d).withColumn("pos", F.col("t")), _positioned(rollup.pyramid(order_points(s, d), WEEKS)).unionByName(_top_row(s)), YEARS, LATE, headers=_headers(s)).fillna(-1, ["pos", "t"]),
        "corrupt_metrics": lambda s, d: quality.corrupt_metrics(faulty_points(s, d), _positioned(_levels(s, d)), CONFIG, LATE),
        "repair_filtered": lambda s, d: quality.repair(faulty_points(s, d), RULES).select("metric", "pos", "t", "v"),
        "repair_rollup": lambda s, d: shaped(quality.repair_and_roll(faulty_points(s, d), RULES, RollupConfig(DAY, DAY, 2))[1]),
        "clone_rebucket": lambda s, d: shaped(quality.clone(faulty_points(s, d).where("abs(v) <= 1e20 and not isnan(v)"), RollupConfig(5 * HOUR, 5 * HOUR, 5))[1]),
        "clone_points": lambda s, d: quality.clone(faulty_points(s, d), RollupConfig(5 * HOUR, 5 * HOUR, 5))[0].select("metric", "pos", "t", "v"),
        "throttle_by_user": lambda s, d: quality.throttle(user_points(s, d), 50 * HOUR),
        "throttle_cooldown": lambda s, d: quality.throttle(points(s, d), COOLDOWN),
        "synthetic_dummy": lambda s, d: dummy_points(s, 100_000),
        "row_text": lambda s, d: rollup.one_level(points(s, d), CONFIG, DAY).select("metric", "t", row_text().alias("text")),
        "row_times": lambda s, d: _levels(s, d).select("metric", "interval", "t", duration_text("interval").alias("width"), time_text("t").alias("begins")),
        "stream_rollup": _stream,
        "stream_restarted": _stream_restarted,
        "stream_late": _stream_late,
        "stream_order": _stream_order,
        "binary_points": lambda s, d: read_records(s, _files(s, d)).select("metric", "t", "v"),
        "binary_level": lambda s, d: shaped(read_records(s, _files(s, d), HOUR)),
        "binary_headers": lambda s, d: describe_files(s, _files(s, d)).select("metric", "interval", "interval_min", "interval_factor", "interval_max", "entries", "first", "last"),
        "catalog_levels": _stored,
    }
    for a, x in NAMES.items():
        for b, y in NAMES.items():
            q[f"count_scope_{a}_{b}"] = lambda s, d, z=(x, y): scans.count(_raw(s, d), B, E, z)
            q[f"retrieve_raw_{a}_{b}"] = lambda s, d, z=(x, y): retrieve.retrieve_points(_raw(s, d), NB, NE + 3 * HOUR, z).select("metric", "t", "v")
            q[f"retrieve_level_{a}_{b}"] = lambda s, d, z=(x, y): shaped(scans.level_scan(_levels(s, d), HOUR, NB, NE + 30 * HOUR, z))
    return q


# --- SQL ----------------------------------------------------------------------------------------------------------

_RAW = "raw AS (SELECT event_type AS metric, epoch_us(ts) * 1000 AS t, value AS v FROM events)"
_USERS = "raw AS (SELECT CAST(user_id AS VARCHAR) AS metric, epoch_us(ts) * 1000 AS t, value AS v FROM events)"
_ORDERS = "raw AS (SELECT 'orders' AS metric, epoch_us(o_orderdate) * 1000 AS t, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY o_orderdate)"
_FAULTY = f"""faulty AS (SELECT event_type AS metric, event_id AS pos, epoch_us(ts) * 1000 - CASE WHEN event_id % 79 = 0 THEN {6 * HOUR} ELSE 0 END AS t,
  CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 89 = 0 THEN 1e21 WHEN event_id % 83 = 0 THEN -1e21 WHEN event_id % 71 = 0 THEN -value ELSE value END AS v FROM events)"""
_REPAIRED = f"""fit AS (SELECT *, max(t) OVER (PARTITION BY metric ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM faulty
    WHERE NOT isnan(v) AND v <= 150 AND v >= -50 AND NOT t BETWEEN {NB} AND {NE} AND NOT t BETWEEN {SPLIT} AND {SPLIT + 2 * HOUR}),
  kept AS (SELECT metric, pos, t, abs(v) AS v FROM fit WHERE t > coalesce(before, 0))"""
_ROUNDED = "mn, mx, round(s, 4) AS s, c, round(i / 1e9, 2) AS i_s, a"


def _level(w: int, source: str = "raw", name: str = "level") -> str:
    return f"""{name}_seg AS (SELECT metric, t, v, coalesce(lag(t) OVER (PARTITION BY metric ORDER BY t), t) AS p, max(t) OVER (PARTITION BY metric) AS last FROM {source}),
  {name}_cut AS (SELECT *, unnest(range(p - p % {w}, t - t % {w} + 1, {w})) AS b FROM {name}_seg),
  {name} AS (SELECT metric, CAST({w} AS BIGINT) AS interval, b AS t, min(v) AS mn, max(v) AS mx, sum(CASE WHEN b = t - t % {w} THEN v ELSE 0 END) AS s,
    count(*) FILTER (b = t - t % {w}) AS c, sum(v * (least(t, b + {w}) - greatest(p, b))) AS i, CAST(sum(least(t, b + {w}) - greatest(p, b)) AS BIGINT) AS a
    FROM {name}_cut WHERE b + {w} <= last GROUP BY metric, b)"""


def _raw_where(b: int, e: int, x: str, y: str) -> str:
    left = {"open": f"t > {b}", "closed": f"t >= {b}", "extended": f"(nt IS NULL OR nt > {b})", "infinity": "true"}[x]
    right = {"open": f"t < {e}", "closed": f"t <= {e}", "extended": f"(pt IS NULL OR pt < {e})", "infinity": "true"}[y]
    return f"{left} AND {right}"


_NEIGHBOURS = "near AS (SELECT *, lag(t) OVER (PARTITION BY metric ORDER BY t) AS pt, lead(t) OVER (PARTITION BY metric ORDER BY t) AS nt FROM raw)"


def _level_where(b: int, e: int, w: int, x: str, y: str) -> str:
    left = {"open": f"t > {b}", "closed": f"t >= {b}", "extended": f"t + {w} > {b}", "infinity": "true"}[x]
    right = {"open": f"t < {e}", "closed": f"t <= {e}", "extended": f"(t < {e} + {w} OR t = (SELECT min(f.t) FROM level f WHERE f.metric = level.metric))", "infinity": "true"}[y]
    return f"{left} AND {right}"


def _aggregate(b: int, e: int) -> str:
    return f"""bounds AS (SELECT metric, min(t) AS f, max(t) AS l FROM raw GROUP BY metric),
  clamped AS (SELECT metric, CASE WHEN {e} > f AND {b} <= l THEN greatest({b}, f) END AS b, CASE WHEN {e} > f AND {b} <= l THEN least({e}, l) END AS e FROM bounds),
  rows_ AS (SELECT n.metric, t, v, pt AS p, b, e FROM near n JOIN clamped k ON k.metric = n.metric WHERE t >= b AND (pt IS NULL OR pt < e)),
  total AS (SELECT k.metric, coalesce(min(v), CAST('Infinity' AS DOUBLE)) AS mn, coalesce(max(v), CAST('-Infinity' AS DOUBLE)) AS mx, coalesce(sum(CASE WHEN t < r.e THEN v ELSE 0 END), 0) AS s,
    count(*) FILTER (t < r.e) AS c, coalesce(sum(v * (least(t, r.e) - greatest(coalesce(p, t), r.b))), 0) AS i, CAST(coalesce(sum(least(t, r.e) - greatest(coalesce(p, t), r.b)), 0) AS BIGINT) AS a
    FROM clamped k LEFT JOIN rows_ r ON r.metric = k.metric GROUP BY k.metric)"""


def _check(source: str = "faulty") -> str:
    return f"""seen AS (SELECT *, max(t) OVER (PARTITION BY metric ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
  issues AS (
    SELECT metric, pos, t, CASE WHEN isnan(v) OR isinf(v) THEN 'non_finite' WHEN v < -1e20 THEN 'too_small' WHEN v > 1e20 THEN 'too_large' END AS issue FROM seen
    UNION ALL SELECT metric, pos, t, CASE WHEN t < before THEN 'non_monotonic' WHEN t = before THEN 'duplicate' END FROM seen)"""


def _smooth(n: int) -> str:
    return f"""chosen AS (SELECT * FROM level WHERE {_level_where(B, E, HOUR, "extended", "open")}),
  grouped AS (SELECT *, (row_number() OVER (PARTITION BY metric ORDER BY t) - 1) // {n} AS g FROM chosen),
  merged AS (SELECT metric, interval, min(t) AS t, min(mn) AS mn, max(mx) AS mx, sum(s) AS s, CAST(sum(c) AS BIGINT) AS c, sum(i) AS i, CAST(sum(a) AS BIGINT) AS a FROM grouped GROUP BY metric, interval, g)
  SELECT metric, interval, t, {_ROUNDED}, CAST({n * HOUR} AS BIGINT) AS span_ns FROM merged"""


_LEVEL_ISSUES = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY metric, interval ORDER BY t) - 1 AS pos FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)),
  holed AS (SELECT metric, interval, t, mn, mx, CASE WHEN interval = {HOUR} AND pos % 61 = 5 THEN CAST('Infinity' AS DOUBLE) ELSE s END AS s, i,
    CASE WHEN interval = {DAY} AND pos % 9 < 2 THEN pos + 1 - 2 * (pos % 9) ELSE pos END AS pos
    FROM ordered WHERE NOT (interval = {HOUR} AND pos % 50 = 7) AND NOT (interval = {DAY} AND metric = 'view')),
  placed AS (SELECT h.*, first, last, max(t) OVER (PARTITION BY h.metric, interval ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(pos) OVER (PARTITION BY h.metric, interval) AS top
    FROM holed h JOIN ends ON ends.metric = h.metric),
  named AS (SELECT *, CASE WHEN pos = top AND t + interval <> last - last % interval THEN 'last_row' END AS x1, CASE WHEN t <> first - first % interval + pos * interval THEN 'bogus_time' END AS x2,
    CASE WHEN t < before THEN 'non_monotonic' WHEN t = before THEN 'duplicate' END AS x3, CASE WHEN NOT (isfinite(mn) AND isfinite(mx) AND isfinite(s) AND isfinite(i)) THEN 'non_finite' END AS x4 FROM placed),
  level_issues AS (SELECT metric, interval, pos, t, issue FROM (SELECT metric, interval, pos, t, unnest([x1, x2, x3, x4]) AS issue FROM named) WHERE issue IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    """Row texts and the stream's state have no SQL of their own; the stream's rows are those of the pyramid."""
    level = lambda w, raw=_RAW: f"WITH {raw}, {_level(w)} SELECT metric, interval, t, {_ROUNDED} FROM level"
    pyramid = " UNION ALL ".join(f"SELECT metric, interval, t, {_ROUNDED} FROM l{k}" for k in range(3))
    pyramid = f"WITH {_RAW}, " + ", ".join(_level(w, name=f"l{k}") for k, w in enumerate(CONFIG.levels)) + " " + pyramid
    throttled = lambda raw, cooldown: f"""WITH RECURSIVE {raw}, steps AS (SELECT metric, min(t) AS t FROM raw GROUP BY metric UNION ALL
          SELECT s.metric, (SELECT min(r.t) FROM raw r WHERE r.metric = s.metric AND r.t > s.t + {cooldown}) FROM steps s WHERE s.t IS NOT NULL)
          SELECT r.metric, r.t, min(r.v) AS v FROM steps s JOIN raw r ON r.metric = s.metric AND r.t = s.t GROUP BY r.metric, r.t"""  # noqa: E731
    aggregate = lambda b, e: f"WITH {_RAW}, {_NEIGHBOURS}, {_aggregate(b, e)} SELECT metric, {_ROUNDED} FROM total"
    L, w5 = E, 5000 * SECOND
    three = ", ".join(_level(w, name=f"l{k}") for k, w in enumerate(CONFIG.levels))
    smooth_raw = f"""WITH {_RAW}, {_NEIGHBOURS},
      inb AS (SELECT metric, t, v, coalesce(pt, {B}) AS p FROM near WHERE t >= {B} AND (pt IS NULL OR pt < {L})),
      cut AS (SELECT *, unnest(range(CASE WHEN p < {B} THEN 0 ELSE (p - {B}) // {w5} END, CASE WHEN t < {L} THEN (t - {B}) // {w5} ELSE ({L} - 1 - {B}) // {w5} END + 1)) AS k,
        CASE WHEN t < {L} THEN (t - {B}) // {w5} END AS k1 FROM inb),
      part AS (SELECT metric, k, v, k = k1 IS TRUE AND t < {L} AS mine, CASE WHEN t < {L} AND k = k1 THEN t ELSE least({B} + (k + 1) * {w5}, {L}) END - CASE WHEN k = 0 THEN p ELSE greatest(p, {B} + k * {w5}) END AS d FROM cut),
      win AS (SELECT metric, CAST({w5} AS BIGINT) AS interval, {B} + k * {w5} AS t, min(v) AS mn, max(v) AS mx, sum(CASE WHEN mine THEN v ELSE 0 END) AS s, count(*) FILTER (mine) AS c, sum(v * d) AS i, CAST(sum(d) AS BIGINT) AS a FROM part GROUP BY metric, k)
      SELECT metric, interval, t, {_ROUNDED} FROM win"""
    # too dense: windows, anchored at the begin, of the metrics whose points lie closer than the limit; else the points as rows
    flex_dense = f"""WITH {_RAW}, {_NEIGHBOURS},
      got AS (SELECT metric, t, v, lag(t) OVER (PARTITION BY metric ORDER BY t) AS p, {E - B} // count(*) OVER (PARTITION BY metric) < {DENSE} AS dense FROM near WHERE {_raw_where(B, E, "closed", "extended")}),
      cut AS (SELECT *, coalesce(p, {B}) AS q, unnest(range((coalesce(p, {B}) - {B}) // {DENSE}, CASE WHEN t < {E} THEN (t - {B}) // {DENSE} ELSE ({E} - 1 - {B}) // {DENSE} END + 1)) AS k FROM got WHERE dense AND coalesce(p, {B}) < {E}),
      part AS (SELECT metric, k, v, t < {E} AND k = (t - {B}) // {DENSE} AS mine, CASE WHEN t < {E} AND k = (t - {B}) // {DENSE} THEN t ELSE least({B} + (k + 1) * {DENSE}, {E}) END - greatest(q, {B} + k * {DENSE}) AS d FROM cut),
      win AS (SELECT metric, CAST({DENSE} AS BIGINT) AS interval, {B} + k * {DENSE} AS t, min(v) AS mn, max(v) AS mx, sum(CASE WHEN mine THEN v ELSE 0 END) AS s, count(*) FILTER (mine) AS c, sum(v * d) AS i, CAST(sum(d) AS BIGINT) AS a FROM part GROUP BY metric, k
        UNION ALL SELECT metric, 0, t, v, v, v, 1, v * (t - coalesce(p, t)), t - coalesce(p, t) FROM got WHERE NOT dense)
      SELECT metric, interval, t, {_ROUNDED} FROM win"""
    one = f"WITH {_RAW}, {_NEIGHBOURS}, {_aggregate(B, E)}"
    out = {
        "rollup_hourly": level(HOUR), "rollup_daily": level(DAY), "rollup_24d": level(24 * DAY), "rollup_pyramid": pyramid, "stored_pyramid": pyramid, "rollup_incremental": pyramid, "stream_rollup": pyramid, "stream_restarted": pyramid,
        "stream_late": f"WITH {_RAW} SELECT metric, t, v FROM raw WHERE t >= {SPLIT - 2 * DAY} AND t < {SPLIT}",
        "stream_order": "SELECT 'in order' AS delivery, 'taken' AS outcome UNION ALL SELECT 'late', 'OutOfOrder'",
        "rollup_by_user": level(DAY, _USERS), "rollup_orders_weekly": level(49 * DAY, _ORDERS),
        "range_per_metric": f"WITH {_RAW} SELECT metric, min(t) AS first, max(t) AS last FROM raw GROUP BY metric",
        "count_all": f"WITH {_RAW} SELECT metric, count(*) AS n FROM raw GROUP BY metric",
        "metric_names": f"WITH {_RAW} SELECT DISTINCT metric FROM raw",
        "last_point": f"WITH {_RAW} SELECT metric, max(t) AS t, arg_max(v, t) AS v FROM raw GROUP BY metric",
        "last_row": f"WITH {_RAW}, {_level(DAY)} SELECT metric, interval, t, {_ROUNDED} FROM level QUALIFY t = max(t) OVER (PARTITION BY metric)",
        "point_before_or_on": f"WITH {_RAW} SELECT metric, max(t) AS t, arg_max(v, t) AS v FROM raw WHERE t <= {B} GROUP BY metric",
        "point_on_or_after": f"WITH {_RAW} SELECT metric, min(t) AS t, arg_min(v, t) AS v FROM raw WHERE t >= {B} GROUP BY metric",
        "retrieve_min_samples": f"WITH {_RAW}, {_level(HOUR)} SELECT metric, interval, t, {_ROUNDED} FROM level WHERE {_level_where(B, E, HOUR, 'extended', 'open')}",
        "retrieve_raw_rows": f"""WITH {_RAW}, {_NEIGHBOURS}, got AS (SELECT metric, t, v FROM near WHERE {_raw_where(B, E, 'closed', 'extended')}),
          r AS (SELECT metric, t, v, t - coalesce(lag(t) OVER (PARTITION BY metric ORDER BY t), t) AS d FROM got)
          SELECT metric, CAST(0 AS BIGINT) AS interval, t, v AS mn, v AS mx, round(v, 4) AS s, CAST(1 AS BIGINT) AS c, round(v * d / 1e9, 2) AS i_s, d AS a FROM r""",
        "flex_raw": f"WITH {_RAW}, {_NEIGHBOURS} SELECT metric, t, v FROM near WHERE {_raw_where(B, E, 'closed', 'extended')}",
        "flex_level": f"WITH {_RAW}, {_level(HOUR)} SELECT metric, interval, t, {_ROUNDED} FROM level WHERE {_level_where(B, E, HOUR, 'extended', 'open')}",
        "flex_smooth_level": f"WITH {_RAW}, {_level(HOUR)}, {_smooth(5)}",
        "smooth_levels": f"WITH {_RAW}, {_level(HOUR)}, {_smooth(7)}",
        "flex_single": f"{one} SELECT metric, CAST({E - B} AS BIGINT) AS interval, CAST({B} AS BIGINT) AS t, {_ROUNDED} FROM total",
        "flex_fallback": f"WITH {_RAW}, {_level(DAY)} SELECT metric, interval, t, {_ROUNDED} FROM level WHERE t >= {E}",
        "flex_clamped": f"WITH {_RAW}, {_level(24 * DAY)} SELECT metric, interval, t, {_ROUNDED}, CAST({24 * DAY} AS BIGINT) AS span_ns FROM level",
        "flex_dense": flex_dense,
        "smooth_raw": smooth_raw,
        "aggregate_range": aggregate(B, E), "aggregate_hierarchical": aggregate(B, E), "aggregate_narrow": aggregate(NB, NE), "aggregate_clamped": aggregate(EARLY, LATE), "aggregate_before_data": aggregate(EARLY, EARLY + DAY),
        "aggregate_rows": f"""WITH {_RAW}, {_level(DAY)}, m AS (SELECT metric, min(mn) AS mn, max(mx) AS mx, sum(s) AS s, CAST(sum(c) AS BIGINT) AS c, sum(i) AS i, CAST(sum(a) AS BIGINT) AS a
          FROM level WHERE t >= {B} AND t < {E} GROUP BY metric) SELECT metric, {_ROUNDED} FROM m""",
        "means": f"{one} SELECT metric, round(CASE WHEN c <> 0 THEN s / c ELSE 'NaN' END, 6) AS mean_sum, round(CASE WHEN a <> 0 THEN i / a ELSE 'NaN' END, 6) AS mean_integral, round(CASE WHEN a <> 0 THEN i / a WHEN c <> 0 THEN s / c ELSE 'NaN' END, 6) AS mean FROM total",
        "check_raw_issues": f"WITH {_FAULTY}, {_check()} SELECT * FROM issues WHERE issue IS NOT NULL",
        "check_raw_fast": f"WITH {_FAULTY}, latest AS (SELECT * FROM faulty QUALIFY row_number() OVER (PARTITION BY metric ORDER BY pos DESC) <= 4096), {_check('latest')} SELECT * FROM issues WHERE issue IS NOT NULL",
        "check_level_rows": f"WITH {_RAW}, {three}, ends AS (SELECT metric, min(t) AS first, max(t) AS last FROM raw GROUP BY metric), {_LEVEL_ISSUES} SELECT * FROM level_issues",
        "check_metrics": f"""WITH {_RAW}, {_FAULTY}, {three}, ends AS (SELECT metric, arg_min(t, pos) AS first, arg_max(t, pos) AS last FROM faulty GROUP BY metric), {_LEVEL_ISSUES}, {_check()}
          SELECT metric, CAST(0 AS BIGINT) AS interval, CAST(pos AS BIGINT) AS pos, t, issue FROM issues WHERE issue IS NOT NULL
          UNION ALL SELECT metric, 0, -1, first, 'first_after_last' FROM ends WHERE first > last
          UNION ALL SELECT metric, interval, pos, t, issue FROM level_issues
          UNION ALL SELECT 'view', {DAY}, -1, -1, 'empty' UNION ALL SELECT 'orphan', 0, -1, -1, 'empty_raw'""",
        "check_metrics_walk": f"""WITH {_ORDERS}, ends AS (SELECT min(t) AS first, max(t) AS last FROM raw)
          SELECT 'orders' AS metric, CAST({7**4 * DAY} AS BIGINT) AS interval, CAST(-1 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS t, 'empty' AS issue FROM ends WHERE first // {7**4 * DAY} <> last // {7**4 * DAY}
          UNION ALL SELECT 'orders', {7**5 * DAY}, -1, 0, 'not_empty' FROM ends WHERE first // {7**5 * DAY} = last // {7**5 * DAY}
          UNION ALL SELECT 'orders', 0, -1, first, 'first_out_of_time' FROM ends WHERE first < {quality.GENESIS}
          UNION ALL SELECT 'orders', 0, -1, first, 'last_out_of_time' FROM ends WHERE last < {quality.GENESIS}
          UNION ALL SELECT 'orders', {49 * DAY}, -1, -1, 'header_interval'""",
        "corrupt_metrics": f"WITH {_FAULTY}, latest AS (SELECT * FROM faulty QUALIFY row_number() OVER (PARTITION BY metric ORDER BY pos DESC) <= 4096), {_check('latest')} SELECT DISTINCT metric FROM issues WHERE issue IS NOT NULL",
        "repair_filtered": f"WITH {_FAULTY}, {_REPAIRED} SELECT metric, pos, t, v FROM kept",
        "repair_rollup": f"WITH {_FAULTY}, {_REPAIRED}, {_level(DAY, 'kept')} SELECT metric, interval, t, {_ROUNDED} FROM level",
        "clone_rebucket": f"""WITH {_FAULTY}, fit AS (SELECT *, max(t) OVER (PARTITION BY metric ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM faulty WHERE NOT isnan(v) AND abs(v) <= 1e20),
          kept AS (SELECT metric, t, v FROM fit WHERE t > coalesce(before, 0)), {_level(5 * HOUR, 'kept')} SELECT metric, interval, t, {_ROUNDED} FROM level""",
        "clone_points": f"WITH {_FAULTY}, fit AS (SELECT *, max(t) OVER (PARTITION BY metric ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM faulty) SELECT metric, pos, t, v FROM fit WHERE t > coalesce(before, 0)",
        "throttle_cooldown": throttled(_RAW, COOLDOWN), "throttle_by_user": throttled(_USERS, 50 * HOUR),
        "row_times": f"""WITH {_RAW}, {three}, rows_ AS (SELECT metric, interval, t FROM l0 UNION ALL SELECT metric, interval, t FROM l1 UNION ALL SELECT metric, interval, t FROM l2)
          SELECT metric, interval, t, CAST(interval // {SECOND} AS VARCHAR) || '.000000000s' AS width, strftime(make_timestamp(t // 1000), '%Y-%m-%dT%H:%M:%S') || '.000000000Z' AS begins FROM rows_""",
        "synthetic_dummy": "SELECT 'dummy' AS metric, (50 * range + 1) * 1000000 AS t, CAST(42 AS DOUBLE) AS v FROM range(100000)",
    }
    out["check_level_fast"] = out["check_level_rows"].replace("FROM holed h JOIN", f"FROM (SELECT * FROM holed QUALIFY row_number() OVER (PARTITION BY metric, interval ORDER BY pos DESC) <= {quality.FAST_ROWS}) h JOIN")
    out["aggregate_by_user"] = aggregate(B, E).replace(_RAW, _USERS)
    out["binary_points"] = f"WITH {_RAW} SELECT metric, t, v FROM raw"
    out["binary_level"] = level(HOUR)
    settings = f"CAST({HOUR} AS BIGINT) AS interval_min, CAST(24 AS BIGINT) AS interval_factor, CAST({24 * DAY} AS BIGINT) AS interval_max, count(*) AS entries, min(t) AS first, max(t) AS last"
    out["binary_headers"] = f"WITH {_RAW}, {_level(HOUR)} SELECT metric, CAST(0 AS BIGINT) AS interval, {settings} FROM raw GROUP BY metric UNION ALL SELECT metric, interval, {settings} FROM level GROUP BY metric, interval"
    weeks = " UNION ALL ".join(f"SELECT 'orders.total' AS metric, interval, t, {_ROUNDED} FROM l{k}" for k in range(len(WEEKS.levels)))
    weeks = weeks.replace("round(i / 1e9, 2) AS i_s", "round(i / 1e9, 0) AS i_s")
    out["catalog_levels"] = f"WITH {_ORDERS}, " + ", ".join(_level(w, name=f"l{k}") for k, w in enumerate(WEEKS.levels)) + " " + weeks
    for x in NAMES:
        for y in NAMES:
            out[f"count_scope_{x}_{y}"] = f"WITH {_RAW}, {_NEIGHBOURS} SELECT metric, count(*) AS n FROM near WHERE {_raw_where(B, E, x, y)} GROUP BY metric"
            out[f"retrieve_raw_{x}_{y}"] = f"WITH {_RAW}, {_NEIGHBOURS} SELECT metric, t, v FROM near WHERE {_raw_where(NB, NE + 3 * HOUR, x, y)}"
            out[f"retrieve_level_{x}_{y}"] = f"WITH {_RAW}, {_level(HOUR)} SELECT metric, interval, t, {_ROUNDED} FROM level WHERE {_level_where(NB, NE + 30 * HOUR, HOUR, x, y)}"
    return out

