"""Which configuration row holds for a metric: its exact name, else the prefix row whose name plus "." starts it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Configurations are templates written by people. Above this many rows the table isn't held on the driver.
MAX_CONFIGS = 100_000


@dataclass(frozen=True)
class ConfigTable:
    """The configurations as Python values, for code that streams over Arrow batches."""

    exact: dict[str, dict]
    prefix: dict[str, dict]

    def find(self, metric: str) -> dict | None:
        """The row for a metric, the longest matching prefix first; None if there is none."""
        if metric in self.exact:
            return self.exact[metric]
        end = metric.rfind(".")
        while end > 0:
            if metric[:end] in self.prefix:
                return self.prefix[metric[:end]]
            end = metric.rfind(".", 0, end)
        return None


def load_configs(configs: DataFrame) -> ConfigTable:
    """Reads the table to the driver after a check of its size (``MAX_CONFIGS`` rows); of repeated names the first in order of all columns counts."""
    rows = configs.where("cfg_name is not null").limit(MAX_CONFIGS + 1).collect()
    if len(rows) > MAX_CONFIGS:
        raise ValueError(f"more than {MAX_CONFIGS} metric configurations")
    exact: dict[str, dict] = {}
    prefix: dict[str, dict] = {}
    for row in sorted(rows, key=repr):
        (prefix if row["is_prefix"] else exact).setdefault(row["cfg_name"], row.asDict())
    return ConfigTable(exact, prefix)


def attach_configs(points: DataFrame, configs: DataFrame, columns: list[str], metric: str = "metric") -> DataFrame:
    """Adds the columns of each row's configuration by broadcast joins on the exact name and on each prefix depth in use.

    Rows without a configuration get nulls. Column names of ``points`` that clash with ``columns`` are replaced.
    """
    table = load_configs(configs)
    depths = sorted({name.count(".") + 1 for name in table.prefix}, reverse=True)
    points = points.drop(*columns)
    one = F.struct(*columns)
    rows = [tuple(row[c] for c in configs.columns) for row in (*table.exact.values(), *table.prefix.values())]
    unique = configs.sparkSession.createDataFrame(rows, configs.schema)

    def side(name: str, where: Column) -> DataFrame:
        return F.broadcast(unique.where(where).select(F.col("cfg_name").alias(f"__k{name}"), one.alias(f"__c{name}")))

    found = []
    out = points.join(side("x", ~F.col("is_prefix")), F.col(metric) == F.col("__kx"), "left")
    found.append(F.col("__cx"))
    for depth in depths:
        at = F.size(F.split("cfg_name", r"\.")) == depth
        key = F.when(F.size(F.split(metric, r"\.")) > depth, F.substring_index(metric, ".", depth))
        out = out.join(side(str(depth), F.col("is_prefix") & at), key == F.col(f"__k{depth}"), "left")
        found.append(F.col(f"__c{depth}"))
    pick = F.coalesce(*found)
    return out.select(*points.columns, *(pick[c].alias(c) for c in columns))
