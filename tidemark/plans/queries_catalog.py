"""Queries of the catalog: settings, modes and guards, and the read operators over a stored catalog of all events, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import RollupConfig
from tidemark.operators.quality import RepairRules
from tidemark.operators.scans import CLOSED, EXTENDED, OPEN
from tidemark.plans import queries_reference as ref
from tidemark.plans.queries_reference import CONFIG, DAY, HOUR, NB, NE, SPLIT, B, E, points, shaped
from tidemark.sources.catalog import Catalog
from tidemark.sources.shared import shared_path

#: Path of each catalog made, and the files and bytes that it has.
_stores: dict[tuple[str, str], tuple[str, tuple[int, int]]] = {}
#: The events' catalog: every event type is a metric below the prefix ``ev``.
ENTRY = {"prefix": True, **CONFIG.to_dict()}


def _config(path: str, **metrics: dict) -> dict:
    return {"type": "file", "path": path, "metrics": metrics}


def _held(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files below a path and their bytes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0, 0
    found = fs.getContentSummary(at)
    return found.getFileCount(), found.getLength()


def _catalog(spark: SparkSession, sf: str) -> Catalog:
    """All events in a catalog, inserted in two parts, all metrics at once; made once in an application, and again if any of it has been deleted since: what is missing would read as empty."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores or _held(spark, _stores[key][0]) != _stores[key][1]:
        path = shared_path(spark, "events")
        catalog = Catalog.from_config(spark, _config(path, ev=ENTRY))
        rows = points(spark, sf).withColumn("metric", F.concat(F.lit("ev."), "metric"))
        catalog.insert(rows.where(F.col("t") < SPLIT), repeated=True)  # as in SQL, each event is a point
        catalog.insert(rows.where(F.col("t") >= SPLIT), repeated=True)
        _stores[key] = path, _held(spark, path)
    return Catalog.from_config(spark, _config(_stores[key][0], ev={**ENTRY, "mode": "R"}))


def _small(spark: SparkSession, name: str, times: list[int]) -> DataFrame:
    return spark.createDataFrame([(name, t, float(t % 7)) for t in times], "metric string, t bigint, v double")


def _outcome(f: Callable) -> str:
    try:
        f()
        return "done"
    except Exception as e:  # noqa: BLE001  its kind is the result
        return type(e).__name__


def catalog_guards(spark: SparkSession, sf: str) -> DataFrame:
    """What is refused, and how: modes, missing and repeated metrics, order of times."""
    meta = {"interval_min": 10, "interval_max": 1000, "interval_factor": 10}
    config = _config(shared_path(spark, "guards"), foo=meta, pre={**meta, "prefix": True}, ro={**meta, "mode": "R"}, wo={**meta, "mode": "W"})
    cat = Catalog.from_config(spark, config)
    foo = cat["foo"]
    cases = [
        ("insert", lambda: foo.insert(_small(spark, "foo", [23, 45]))),
        ("insert the last time again", lambda: foo.insert(_small(spark, "foo", [45]))),
        ("insert an earlier time", lambda: foo.insert(_small(spark, "foo", [44]))),
        ("insert a time twice", lambda: foo.insert(_small(spark, "foo", [60, 60]))),
        ("insert time 0", lambda: cat["pre.zero"].insert(_small(spark, "x", [0]))),
        ("insert under a prefix", lambda: cat["pre.a"].insert(_small(spark, "x", [5]))),
        ("a name that is a prefix and a dot", lambda: cat["pre."]),
        ("a prefix itself", lambda: cat["pre"]),
        ("below a metric that is no prefix", lambda: cat["foo.metric"]),
        ("an unknown metric", lambda: cat["bar"]),
        ("insert into a metric to be read", lambda: cat["ro"].insert(_small(spark, "ro", [5]))),
        ("read a metric to be read", lambda: cat["ro"].count()),
        ("read a metric to be written", lambda: cat["wo"].count()),
        ("write a metric to be written", lambda: cat["wo"].insert(_small(spark, "wo", [5]))),
        ("levels of a metric to be written", lambda: cat["wo"].levels()),
        ("add a metric", lambda: cat.add("new", meta)),
        ("add it again", lambda: cat.add("new", meta)),
        ("add one of the configuration", lambda: cat.add("foo", meta)),
        ("an unknown mode", lambda: cat.add("z", {**meta, "mode": "Z"})),
        ("an unknown type", lambda: Catalog.from_config(spark, {**config, "type": "x"})),
        ("insert many, one without settings", lambda: cat.insert(_small(spark, "pre.b", [5]).union(_small(spark, "bar", [5])))),
        ("insert many, one to be read", lambda: cat.insert(_small(spark, "pre.b", [5]).union(_small(spark, "ro", [5])))),
        ("insert many", lambda: cat.insert(_small(spark, "pre.b", [5, 70]).union(_small(spark, "foo", [46])))),
        ("flush", foo.flush),
    ]
    return spark.createDataFrame([(name, _outcome(f)) for name, f in cases], "action string, outcome string")


def catalog_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Which settings are refused."""
    cases = [(10, 1000, 10), (10, 10, 2), (10, 1000, 1), (0, 1000, 10), (-10, 1000, 10), (15, 1000, 10), (100, 10, 10), (10, 1 << 63, 10)]
    rows = [(str(a), str(b), str(c), _outcome(lambda x=(a, b, c): RollupConfig(*x))) for a, b, c in cases]
    return spark.createDataFrame(rows, "interval_min string, interval_max string, interval_factor string, outcome string")


def catalog_reopened(spark: SparkSession, sf: str) -> DataFrame:
    """A metric opened again: what is stored holds over other settings, RW goes on, W begins anew. Rows: step, points, level rows, interval_min, last time."""
    path, out = shared_path(spark, "reopened"), []
    first, other = {"interval_min": 10, "interval_max": 100, "interval_factor": 10}, {"interval_min": 20, "interval_max": 20, "interval_factor": 2}

    def step(name: str, entry: dict, times: list[int]) -> None:
        Catalog.from_config(spark, _config(path, m=entry))["m"].insert(_small(spark, "m", times))
        m = Catalog.from_config(spark, _config(path, m={"mode": "R"}))["m"]
        out.append((name, m.count(), m.levels().count(), m.meta().interval_min, m.range()[1]))

    step("new", first, [23, 45, 210])
    step("other settings", {**other, "mode": "RW"}, [217, 331])
    step("overwritten", {**other, "mode": "W"}, [7, 41])
    return spark.createDataFrame(out, "step string, n_points bigint, n_rows bigint, interval_min bigint, last bigint")


def catalog_names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _catalog(spark, sf).names()], "metric string")


def catalog_meta(spark: SparkSession, sf: str) -> DataFrame:
    """The settings of each stored metric."""
    return _catalog(spark, sf).metas().withColumnRenamed("name", "metric")


def catalog_many(spark: SparkSession, sf: str) -> DataFrame:
    """The levels of all metrics, as the two insertions left them."""
    return shaped(_catalog(spark, sf).levels())


def _each(spark: SparkSession, sf: str, f: Callable) -> DataFrame:
    """The answers of two stored metrics."""
    catalog = _catalog(spark, sf)
    return f(catalog["ev.click"]).unionByName(f(catalog["ev.view"]))


def catalog_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, lambda m: m.retrieve(NB, NE + 3 * HOUR, (EXTENDED, EXTENDED)))


def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(_each(spark, sf, lambda m: m.retrieve_rows(B, E, min_samples=100)))


def catalog_flex(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(_each(spark, sf, lambda m: m.retrieve_flex(B, E, 5 * HOUR, (EXTENDED, OPEN))[1]), "span_ns")


def catalog_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(_each(spark, sf, lambda m: m.aggregate(B, E)))


def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Points in a range, all points, first and last time of two stored metrics."""
    catalog = _catalog(spark, sf)
    rows = [(m.name, m.count(B, E, (CLOSED, CLOSED)), m.count(), *m.range()) for m in (catalog["ev.click"], catalog["ev.view"])]
    return spark.createDataFrame(rows, "metric string, n_range bigint, n bigint, first bigint, last bigint")


def catalog_repair(spark: SparkSession, sf: str) -> DataFrame:
    """A stored metric is repaired: its points, and those of the backup."""
    cat = Catalog.from_config(spark, _config(shared_path(spark, "repair"), m=CONFIG.to_dict()))
    metric = cat["m"]
    metric.insert(points(spark, sf).where("metric = 'click'"), repeated=True)  # as in SQL, each event is a point
    backup = metric.repair(RepairRules(drop_above=100.0, intervals=[(SPLIT, SPLIT + 2 * DAY)], repeated=True))
    return metric.points().unionByName(cat[backup].points())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (catalog_guards, catalog_settings, catalog_reopened, catalog_names, catalog_meta, catalog_many, catalog_retrieve, catalog_rows, catalog_flex, catalog_aggregate, catalog_counts, catalog_repair)}


_GUARDS = {
    "insert": "done", "insert the last time again": "OutOfOrder", "insert an earlier time": "OutOfOrder", "insert a time twice": "OutOfOrder", "insert time 0": "OutOfOrder",
    "insert under a prefix": "done", "a name that is a prefix and a dot": "done", "a prefix itself": "MissingMetricConfig", "below a metric that is no prefix": "MissingMetricConfig",
    "an unknown metric": "MissingMetricConfig", "insert into a metric to be read": "AccessError", "read a metric to be read": "done", "read a metric to be written": "AccessError",
    "write a metric to be written": "done", "levels of a metric to be written": "AccessError", "add a metric": "done", "add it again": "DuplicateMetric", "add one of the configuration": "DuplicateMetric",
    "an unknown mode": "TidemarkError", "an unknown type": "TidemarkError", "insert many, one without settings": "MissingMetricConfig", "insert many, one to be read": "AccessError", "insert many": "done", "flush": "done",
}


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows)}) AS x({columns})"


def oracle_sql() -> dict[str, str]:
    raw = "raw AS (SELECT 'ev.' || event_type AS metric, epoch_us(ts) * 1000 AS t, value AS v FROM events)"
    two = f"{raw.replace('raw AS', 'every AS')}, raw AS (SELECT * FROM every WHERE metric IN ('ev.click', 'ev.view'))"
    three = ", ".join(ref._level(w, name=f"l{k}") for k, w in enumerate(CONFIG.levels))
    smooth = ref._smooth(5)
    settings = f"CAST({HOUR} AS BIGINT) AS interval_min, CAST({CONFIG.interval_max} AS BIGINT) AS interval_max, CAST(24 AS BIGINT) AS interval_factor"
    return {
        "catalog_guards": _values(list(_GUARDS.items()), "action, outcome"),
        "catalog_settings": _values([("10", "1000", "10", "done"), ("10", "10", "2", "done"), ("10", "1000", "1", "ValueError"), ("0", "1000", "10", "ValueError"), ("-10", "1000", "10", "ValueError"), ("15", "1000", "10", "ValueError"), ("100", "10", "10", "ValueError"), ("10", str(1 << 63), "10", "OverflowError")], "interval_min, interval_max, interval_factor, outcome"),
        "catalog_reopened": "SELECT step, CAST(n_points AS BIGINT) AS n_points, CAST(n_rows AS BIGINT) AS n_rows, CAST(interval_min AS BIGINT) AS interval_min, CAST(last AS BIGINT) AS last FROM (VALUES "
        "('new', 3, 19 + 2, 10, 210), ('other settings', 5, 31 + 3, 10, 331), ('overwritten', 2, 2, 20, 41)) AS x(step, n_points, n_rows, interval_min, last)",
        "catalog_names": f"WITH {raw} SELECT DISTINCT metric FROM raw",
        "catalog_meta": f"WITH {raw} SELECT DISTINCT metric, {settings} FROM raw",
        "catalog_many": f"WITH {raw}, {three} " + " UNION ALL ".join(f"SELECT metric, interval, t, {ref._ROUNDED} FROM l{k}" for k in range(3)),
        "catalog_retrieve": f"WITH {two}, {ref._NEIGHBOURS} SELECT metric, t, v FROM near WHERE {ref._raw_where(NB, NE + 3 * HOUR, 'extended', 'extended')}",
        "catalog_rows": f"WITH {two}, {ref._level(HOUR)} SELECT metric, interval, t, {ref._ROUNDED} FROM level WHERE {ref._level_where(B, E, HOUR, 'extended', 'open')}",
        "catalog_flex": f"WITH {two}, {ref._level(HOUR)}, {smooth}",
        "catalog_aggregate": f"WITH {two}, {ref._NEIGHBOURS}, {ref._aggregate(B, E)} SELECT metric, {ref._ROUNDED} FROM total",
        "catalog_counts": f"WITH {two} SELECT metric, count(*) FILTER (t >= {B} AND t <= {E}) AS n_range, count(*) AS n, min(t) AS first, max(t) AS last FROM raw GROUP BY metric",
        "catalog_repair": f"WITH {ref._RAW}, one AS (SELECT t, v FROM raw WHERE metric = 'click') SELECT 'm.backup-0' AS metric, t, v FROM one UNION ALL SELECT 'm', t, v FROM one WHERE v <= 100 AND NOT t BETWEEN {SPLIT} AND {SPLIT + 2 * DAY}",
    }

