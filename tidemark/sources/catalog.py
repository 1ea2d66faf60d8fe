"""The catalog: named metrics with settings and modes, over Parquet tables.

``<path>/meta/metric=…`` holds a metric's settings as JSON, written once: later configurations don't change them.
``<path>/raw/metric=…`` and ``<path>/levels/interval=…/metric=…`` hold the rows, so that reading one metric or level
prunes the others' files. An insertion, of one metric or of many at once, goes on from the last closed buckets: of what is
stored it reads the levels and the points since then. It writes the levels from the lowest up, and the points last. Each
of these goes on from its own end, so an insertion that failed in between is completed by repeating it as it was.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Mode, RollupConfig
from tidemark.errors import AccessError, DuplicateMetric, MissingMetricConfig, OutOfOrder, TidemarkError
from tidemark.model import LEVEL, RAW, VALUES
from tidemark.operators import aggregate as agg
from tidemark.operators import quality, retrieve, scans
from tidemark.operators.metric_configs import attach_configs
from tidemark.operators.rollup import extend_pyramid
from tidemark.operators.scans import CLOSED, EXTENDED, OPEN
from tidemark.sources.shared import materialize

SETTINGS = ("interval_min", "interval_max", "interval_factor")
# Fixed value: the characters that Spark escapes in the names of partition folders, besides control characters.
_ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f")


def folder(name: str) -> str:
    """The partition folder of a metric, named as Spark names it, so that no name leaves the table's own folder."""
    return "metric=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED or c < " " else c for c in name)


@dataclass(frozen=True)
class Entry:
    mode: Mode
    prefix: bool
    config: RollupConfig

    @classmethod
    def from_dict(cls, d: dict) -> Entry:
        try:
            mode = Mode(d.get("mode", "RW"))
        except ValueError as e:
            raise TidemarkError(f"unknown mode {d['mode']!r}") from e
        return cls(mode, bool(d.get("prefix", False)), RollupConfig.from_dict(d))


class Catalog:
    """``Catalog.from_config(spark, {"type": "file", "path": ..., "metrics": {name: {"mode", "prefix", "interval_min", ...}}})``."""

    def __init__(self, spark: SparkSession, path: str, entries: dict[str, Entry]):
        self.spark, self.path, self.entries = spark, path.rstrip("/"), dict(entries)
        self.opened: dict[str, StoredMetric] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, config: str | dict) -> Catalog:
        """``config``: an object, or the path of a JSON file that Spark can read."""
        if isinstance(config, str):
            config = json.loads("\n".join(r["value"] for r in spark.read.text(config, wholetext=True).toLocalIterator()))
        if config.get("type") != "file":
            raise TidemarkError(f"unknown type {config.get('type')!r}")
        return cls(spark, config["path"], {name: Entry.from_dict(d) for name, d in config.get("metrics", {}).items()})

    def exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def __getitem__(self, name: str) -> StoredMetric:
        if name in self.opened:
            return self.opened[name]
        entry = self.entries.get(name)
        if entry is None or entry.prefix:
            fitting = [p for p, e in self.entries.items() if e.prefix and name.startswith(p + ".")]
            entry = self.entries[max(fitting, key=len)] if fitting else None
        if entry is None:
            raise MissingMetricConfig(name)
        self.opened[name] = StoredMetric(self, name, entry)
        return self.opened[name]

    def add(self, name: str, entry: Entry | dict) -> StoredMetric:
        """Adds a metric at run time; looks for a duplicate before anything is opened."""
        if name in self.opened or name in self.entries:
            raise DuplicateMetric(name)
        self.entries[name] = entry if isinstance(entry, Entry) else Entry.from_dict(entry)
        return self[name]

    def _all(self, kind: str, schema: str) -> DataFrame:
        """A whole table, all metrics."""
        if not self.exists(f"{self.path}/{kind}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")

    def points(self) -> DataFrame:
        """metric, t, v of all stored metrics."""
        return self._all("raw", "t bigint, v double, metric string").select("metric", "t", "v")

    def levels(self) -> DataFrame:
        """The level rows of all stored metrics."""
        return self._all("levels", "t bigint, mn double, mx double, s double, c bigint, i double, a bigint, interval bigint, metric string").select(*(f.name for f in LEVEL))

    def metas(self) -> DataFrame:
        """name and settings of all stored metrics."""
        schema = "name string, interval_min bigint, interval_max bigint, interval_factor bigint"
        if not self.exists(f"{self.path}/meta"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/meta").select("name", *SETTINGS)

    def insert(self, points: DataFrame, repeated: bool = False) -> None:
        """Appends points (metric, t, v) of any number of metrics, and the level rows that they close, in a few jobs for each different settings.

        Each metric must have a configuration, and be readable and writable (one that is only written is replaced, one at a time, by its own ``insert``).
        A time that comes twice is refused, or if ``repeated`` each of its points is stored and counts; all have to be after those stored before.
        """
        entries = [(name, e.prefix, e.mode.value, *e.config.to_dict().values()) for name, e in self.entries.items()]
        table = self.spark.createDataFrame(entries, "cfg_name string, is_prefix boolean, rw_mode string, interval_min bigint, interval_max bigint, interval_factor bigint")
        found = attach_configs(points.select("metric").distinct(), table, ["rw_mode", *SETTINGS])
        held = self.metas().select(F.col("name").alias("metric"), F.struct(*SETTINGS).alias("held"))
        found = found.join(held, "metric", "left").select("metric", "rw_mode", F.col("held").isNotNull().alias("stored"), *(F.coalesce(f"held.{c}", c).alias(c) for c in SETTINGS))
        found = materialize(found, "metrics")  # read several times; one row a metric
        wrong = found.where("rw_mode is null or rw_mode <> 'RW'").orderBy("metric").first()
        if wrong is not None:
            raise MissingMetricConfig(wrong["metric"]) if wrong["rw_mode"] is None else AccessError(f"{wrong['metric']} has to be readable and writable")
        fresh = found.where("not stored")
        if not fresh.isEmpty():
            fresh.select("metric", F.col("metric").alias("name"), *SETTINGS).write.mode("append").partitionBy("metric").json(f"{self.path}/meta")
        for r in found.select(*SETTINGS).distinct().collect():  # as many as there are different settings
            own = found.where(" and ".join(f"{c} = {r[c]}" for c in SETTINGS)).select("metric")
            self.append(points.select("metric", "t", "v").join(own, "metric", "left_semi"), RollupConfig(*(r[c] for c in SETTINGS)), own, repeated)

    def append(self, new: DataFrame, config: RollupConfig, own: DataFrame, repeated: bool = False) -> None:
        """Appends the points of the metrics ``own``, all of which have these settings."""
        only = lambda df: df.join(own, "metric", "left_semi")
        levels = only(self.levels())
        closed = materialize(levels.where(F.col("interval") == config.interval_min).groupBy("metric").agg((F.max("t") + config.interval_min).alias("start")), "closed")
        # the stored points since the last closed bucket: by one literal for all metrics, then by each metric's own; everything only if a stored metric has no bucket yet
        low = own.join(self.metas().select(F.col("name").alias("metric")), "metric", "left_semi").join(closed, "metric", "left").agg(F.min(F.coalesce("start", F.lit(0)))).first()[0] or 0
        tail = only(self.points().where(F.col("t") >= low)).join(closed, "metric", "left").where("start is null or t >= start").drop("start")
        last = tail.groupBy("metric").agg(F.max("t").alias("last"))
        times = F.count("t") if repeated else F.count_distinct("t")
        size = new.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), times.alias("d"), F.min("t").alias("low")).join(last, "metric", "left")
        wrong = size.where("n <> d or low is null or low <= coalesce(last, 0)").first()
        if wrong is not None:
            raise OutOfOrder(f"times of {wrong['metric']} must rise and be after {wrong['last'] or 0}")
        rows = materialize(extend_pyramid(levels, tail.unionByName(new), config, lambda rows: materialize(rows, "base")), "levels", ("interval",))
        for w in config.levels:
            part = rows.where(F.col("interval") == w).select("metric", "t", *VALUES)
            if not part.isEmpty():
                part.repartition("metric").sortWithinPartitions("metric", "t").write.mode("append").partitionBy("metric").parquet(f"{self.path}/levels/interval={w}")
        new.repartitionByRange("metric", "t").sortWithinPartitions("metric", "t").write.mode("append").partitionBy("metric").parquet(f"{self.path}/raw")

    def names(self) -> list[str]:
        """The metrics that are stored, configured or not, in order."""
        if not self.exists(f"{self.path}/meta"):
            return []
        return [r["name"] for r in self.metas().select("name").distinct().orderBy("name").toLocalIterator()]


class StoredMetric:
    """One metric: its points and levels, read and written as its mode allows."""

    def __init__(self, catalog: Catalog, name: str, entry: Entry):
        self.catalog, self.name, self.mode, self.spark = catalog, name, entry.mode, catalog.spark
        self._fresh = entry.mode is Mode.WRITE  # overwrites what there is at the first insertion
        at = folder(name)
        self._meta, self._raw, self._levels = f"{catalog.path}/meta/{at}", f"{catalog.path}/raw/{at}", catalog.path + "/levels/interval={}/" + at
        if catalog.exists(self._meta) and not self._fresh:
            row = self.spark.read.json(self._meta).first()
            self.config = RollupConfig(row["interval_min"], row["interval_max"], row["interval_factor"])
        elif entry.mode is Mode.READ:
            self.config = entry.config
        else:
            self.config = entry.config
            self.spark.createDataFrame([(name, *entry.config.to_dict().values())], "name string, interval_min bigint, interval_max bigint, interval_factor bigint").coalesce(1).write.mode("overwrite").json(self._meta)

    def _reading(self) -> None:
        if not self.mode.reads:
            raise AccessError(f"{self.name} is for writing only")

    def _table(self, path: str, schema) -> DataFrame:
        if not self.catalog.exists(path):
            return self.spark.createDataFrame([], schema)
        names = [f.name for f in schema if f.name not in ("metric", "interval")]
        out = self.spark.read.schema(", ".join(f"{n} {schema[n].dataType.simpleString()}" for n in names)).parquet(path)
        return out.withColumn("metric", F.lit(self.name))

    def points(self) -> DataFrame:
        self._reading()
        return self._points()

    def _points(self) -> DataFrame:
        return self._table(self._raw, RAW).select("metric", "t", "v")

    def levels(self) -> DataFrame:
        self._reading()
        return self._stored_levels()

    def _stored_levels(self) -> DataFrame:
        out = None
        for w in self.config.levels:
            one = self._table(self._levels.format(w), LEVEL).select("metric", F.lit(w).cast("bigint").alias("interval"), "t", *VALUES)
            out = one if out is None else out.unionByName(one)
        return out

    def insert(self, points: DataFrame, repeated: bool = False) -> None:
        """Appends points (t, v) and the level rows that they close. Times have to rise, from the last one stored on (``repeated``: one may come several times). A metric that is only written is emptied by its first insertion."""
        if not self.mode.writes:
            raise AccessError(f"{self.name} is for reading only")
        if self._fresh:
            for path in (self._raw, *(self._levels.format(w) for w in self.config.levels)):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        new = points.select(F.lit(self.name).alias("metric"), "t", "v")
        self.catalog.append(new, self.config, self.spark.createDataFrame([(self.name,)], "metric string"), repeated)
        self._fresh = False

    def flush(self) -> None:
        """Nothing is ever held back."""

    def retrieve(self, begin: int, end: int, scope: scans.Scopes = (CLOSED, EXTENDED)) -> DataFrame:
        return retrieve.retrieve_points(self.points(), begin, end, scope)

    def retrieve_rows(self, begin: int, end: int, *, interval_max: int | None = None, min_samples: int | None = None, scope: scans.Scopes = (EXTENDED, OPEN)) -> DataFrame:
        if interval_max is not None:
            return retrieve.retrieve_rows(self.points(), self.levels(), self.config, begin, end, interval_max, scope)
        return retrieve.retrieve_samples(self.points(), self.levels(), self.config, begin, end, min_samples, scope)

    def retrieve_flex(self, begin: int, end: int, limit: int, scope: scans.Scopes = (CLOSED, EXTENDED), smooth: bool = True) -> tuple[str, DataFrame]:
        return retrieve.retrieve_flex(self.points(), self.levels(), self.config, begin, end, limit, scope, smooth)

    def aggregate(self, begin: int, end: int) -> DataFrame:
        first, last = self.range()
        if not last:
            return agg.aggregate(self.points(), begin, end)
        return agg.aggregate_hierarchical(self.points(), self.levels(), self.config, begin, end, self.spark.createDataFrame([(self.name, first, last)], "metric string, first bigint, last bigint"))

    def count(self, begin: int | None = None, end: int | None = None, scope: scans.Scopes = (CLOSED, EXTENDED)) -> int:
        row = scans.count(self.points(), begin, end, scope).first()
        return row["n"] if row else 0

    def range(self) -> tuple[int, int]:
        row = scans.time_range(self.points()).first()
        return (row["first"], row["last"]) if row else (0, 0)

    def meta(self) -> RollupConfig:
        return self.config

    def repair(self, rules: quality.RepairRules, order: str = "t") -> str:
        """Writes the repaired points and rebuilt levels in place of the old ones, which stay as ``<name>.backup-<n>``; returns that name."""
        if self.mode is not Mode.READ_WRITE:
            raise AccessError(f"{self.name} has to be readable and writable")
        taken = set(self.catalog.names())
        backup = next(f"{self.name}.backup-{i}" for i in range(1 << 30) if f"{self.name}.backup-{i}" not in taken)
        saved = self.catalog.add(backup, Entry(Mode.READ_WRITE, False, self.config))
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self._raw).getFileSystem(self.spark._jsc.hadoopConfiguration())
        pairs = [(self._raw, saved._raw)] + [(self._levels.format(w), saved._levels.format(w)) for w in self.config.levels]
        for a, b in pairs:
            if self.catalog.exists(a):
                src, dst = self.spark._jvm.org.apache.hadoop.fs.Path(a), self.spark._jvm.org.apache.hadoop.fs.Path(b)
                fs.mkdirs(dst.getParent())
                fs.rename(src, dst)
        kept, levels = quality.repair_and_roll(saved._points().withColumn("pos", F.col(order)), rules, self.config)
        kept.select("t", "v").write.mode("overwrite").parquet(self._raw)
        for w in self.config.levels:
            levels.where(F.col("interval") == w).select("t", *VALUES).write.mode("overwrite").parquet(self._levels.format(w))
        return backup
