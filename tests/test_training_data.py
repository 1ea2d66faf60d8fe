"""The core operators for training data: edge cases, and brute force where there is no SQL."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies
from tidemark.operators.forest import forest_scores
from tidemark.operators import incremental
from tidemark.operators.incremental import STEPS, FolderRuns, Stopped, TableRuns
from tidemark.operators.metric_configs import ConfigTable, attach_configs, load_configs
from tidemark.operators.regrid import regrid
from tidemark.operators.trailing import DAY_NS, trailing_totals

POINTS = "point_id bigint, metric string, t bigint, v double, recorder_id int, arrived_at timestamp_ntz"
CONFIGS = "cfg_name string, is_prefix boolean, interval_min bigint, kind string, lo double, hi double, deadband double"
T0 = dt.datetime(2024, 1, 1)
NAN = float("nan")


def make(spark, rows):
    """rows: (metric, t, v), arriving in order."""
    return spark.createDataFrame([(i, m, t, v, 1, T0 + dt.timedelta(seconds=i)) for i, (m, t, v) in enumerate(rows)], POINTS)


@pytest.fixture(scope="module")
def configs(spark):
    return spark.createDataFrame([("a", True, 10, "gauge", 0.0, 1000.0, 0.5), ("a.b", False, 20, "gauge", None, None, 0.5), ("a.c", True, 30, "state", None, 5.0, 0.5)], CONFIGS).cache()


def test_configs(spark, configs):
    table = load_configs(configs)
    assert [(table.find(m) or {}).get("interval_min") for m in ("a.b", "a.b.x", "a.c.x", "a.x", "ab", "a")] == [20, 10, 30, 10, None, None]
    got = attach_configs(spark.createDataFrame([(m,) for m in ("a.b", "a.b.x", "a.c.x", "a.x", "ab", "a", None)], "metric string").withColumn("interval_min", F.lit("clash")), configs.union(configs), ["interval_min"])
    assert {r.metric: r.interval_min for r in got.collect()} == {"a.b": 20, "a.b.x": 10, "a.c.x": 30, "a.x": 10, "ab": None, "a": None, None: None}


# --- 1 --------------------------------------------------------------------------------------------------------------


RUNS = "recorder_id int, feed string, run_status string, upto timestamp_ntz"
at = lambda s: T0 + dt.timedelta(seconds=s)


def table_runs(spark, path):
    job = TableRuns(spark, f"file://{path}")
    return job, lambda raw, runs, **more: job.run({"raw": (raw, ["metric", "t"], "point_id", ["v"])}, runs, **more)


def test_new_or_changed(spark, tmp_path):
    rows = [(1, "m", 5, 1.0, 1, at(1)), (2, "m", 5, 1.0, 1, at(2)), (3, "m", 5, 2.0, 1, at(3)), (4, "m", 0, NAN, 2, at(1)), (5, "m", 0, NAN, 2, at(2)), (6, "m", 7, None, 1, at(3)), (7, "m", 7, None, 1, at(3)), (8, "m", 8, 1.0, None, at(1)), (9, "m", 9, 1.0, 1, None), (10, "m", 9, 1.0, 1, at(9))]
    raw = spark.createDataFrame(rows, POINTS).withColumn("arrived", F.col("arrived_at")).withColumn("size", F.lit("clash"))
    runs = spark.createDataFrame([(1, "raw", "ok", at(2)), (1, "raw", "failed", at(99)), (1, "raw", "ok", None), (1, "raw", "ok", at(1)), (1, "level", "ok", at(99)), (2, "raw", "killed", at(9))], RUNS)
    job, run = table_runs(spark, tmp_path / "a")
    found = lambda batch: sorted(r.row_id for r in job.results(batch).collect())
    batch = run(raw, runs)
    assert found(batch) == [3, 4, 6, 8, 9]
    empty, run_empty = table_runs(spark, tmp_path / "b")
    assert run_empty(raw.where("false"), runs) is None
    # the log goes on: everything is read now, and nothing but rows that no mark can cover is pending
    later = runs.union(spark.createDataFrame([(r, "raw", "ok", at(99)) for r in (1, 2)], RUNS))
    assert found(run(raw, later)) == [8, 9]
    # a late row, in an input that is in the manifest
    late = raw.unionByName(spark.createDataFrame([(11, "m", 5, 7.0, 1, at(100))], POINTS).withColumn("arrived", F.col("arrived_at")).withColumn("size", F.lit("")))
    assert found(run(late, later)) == [8, 9, 11]


def test_size_and_checksum_decide(spark, tmp_path):
    """An input that has the same rows as the manifest says is done; with another number or content it is pending."""
    rows = make(spark, [("m", 1, 1.0), ("m", 2, 2.0)]).withColumn("arrived", F.lit(T0))
    job, _ = table_runs(spark, tmp_path)
    runs = spark.createDataFrame([(1, "raw", "ok", at(5))], RUNS)
    listing = lambda x: TableRuns.listing(TableRuns.keyed(x, runs, "raw"), ["metric", "t", "v"])
    job.adopt(listing(rows))
    assert job.manifest.entries().count() == 1 and job.manifest.pending(listing(rows.orderBy(F.desc("t")))).count() == 0
    for other in (rows.union(rows), rows.withColumn("v", F.col("v") + 1), rows.where("t = 1")):
        assert job.manifest.pending(listing(other)).count() == 1


def test_table_runs_survive_failures(spark, tmp_path):
    raw = make(spark, [("m", k, float(k)) for k in range(1, 9)]).withColumn("arrived", F.col("arrived_at"))
    runs = spark.createDataFrame([(1, "raw", "ok", at(3))], RUNS)
    for step in STEPS:
        job, run = table_runs(spark, tmp_path / step)
        with pytest.raises(Stopped):
            run(raw, runs, stop=step)
        again = run(raw, runs)
        assert (again is None) == (step == "committed")  # done already
        names = [r.batch_id for r in job.manifest.entries().select("batch_id").distinct().collect() if r.batch_id != "log"]
        assert len(names) == 1 and sorted(r.row_id for r in job.results(names[0]).collect()) == [4, 5, 6, 7]


def folder_runs(spark, tmp_path, **more):
    run = FolderRuns(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/manifest", **more)
    write = lambda name, lo, hi: spark.range(lo, hi).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{name}")
    return run, write, lambda: sorted(r.id for r in run.results().collect())


@pytest.mark.parametrize("step", STEPS)
def test_runs_over_a_folder_survive_failures(spark, tmp_path, step):
    run, write, ids = folder_runs(spark, tmp_path)
    same = lambda df: df.select("id", "input")
    write("a", 0, 5)
    with pytest.raises(Stopped):
        run.run(same, stop=step)
    assert run.manifest.entries().count() == (1 if step == "committed" else 0)
    run.run(same)
    assert ids() == list(range(5)) and run.run(same) == []


def test_a_file_that_changes_in_place_is_superseded(spark, tmp_path):
    import os
    import shutil

    run, _, ids = folder_runs(spark, tmp_path)
    same = lambda df: df.select("id", "input")

    def put(name, lo, hi):
        spark.range(lo, hi).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/new")
        part = next(x for x in os.listdir(f"{tmp_path}/new") if x.startswith("part-"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        shutil.copyfile(f"{tmp_path}/new/{part}", f"{tmp_path}/in/{name}.parquet")

    put("with a space", 0, 5)
    assert len(run.run(same)) == 1 and ids() == list(range(5))
    put("with a space", 0, 7)
    assert len(run.run(same)) == 1 and ids() == list(range(7))
    put("b", 7, 9)
    put("with a space", 0, 5)  # back to the first version
    assert len(run.run(same)) == 1 and ids() == [0, 1, 2, 3, 4, 7, 8] and run.run(same) == []
    os.utime(f"{tmp_path}/in/b.parquet", (1, 1))
    assert run.run(same) == []  # read again, and found the same
    with pytest.raises(ValueError, match="input"):
        put("c", 9, 11)
        run.run(lambda df: df.select("id"))


def test_many_files_are_taken_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MAX_INPUTS", 2)
    run, write, ids = folder_runs(spark, tmp_path)
    for k in range(5):
        write(f"f{k}", 3 * k, 3 * k + 3)
    assert len(run.run(lambda df: df.select("id", "input"))) == 3 and ids() == list(range(15))


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_regrid(spark, configs):
    base = 86_400_000_000_000
    pts = make(spark, [("a.x", base + 3, 1.0), ("a.x", base + 3, 5.0), ("a.x", base + 13, 7.0), ("a.x", base + 44, NAN), ("a.x", base + 95, 9.0), ("a.x", 0, 1.0), ("a.x", None, 1.0), (None, base, 1.0), ("zz", base, 1.0), ("a.x", base + 52, None)])
    got = {(r.t - base) // 10: r for r in regrid(pts.withColumn("slot", F.lit(1)), configs).collect()}
    assert sorted(got) == list(range(10))
    assert [k for k in sorted(got) if got[k].missing] == [2, 3, 4, 5, 6, 7, 8] and got[0].n == 1
    assert all(got[k].value is None for k in (4, 5, 6)) and got[9].value == 9.0
    assert regrid(pts.where("false"), configs).count() == 0


def test_regression_equals_brute_force(spark, configs):
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(2000, 150, replace=False)) + 86_400_000_000_000
    v = rng.normal(size=150)
    got = regrid(make(spark, [("a.x", int(a), float(b)) for a, b in zip(t, v, strict=True)]), configs).collect()
    for r in got:
        d = (t - (r.t + 5)) / 10
        slot = t // 10 - r.t // 10
        w = np.where(np.abs(slot) <= 2, 1 - (d / 2.5) ** 2, 0)
        support = w.sum() ** 2 / (w**2).sum() if w.sum() else 0
        assert abs(r.support - support) < 1e-6
        if r.value is not None and support >= 2 and np.ptp(d[w > 0]) > 0.3:
            x = np.stack([np.ones(len(d)), d], 1)
            beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], v * np.sqrt(w), rcond=None)[0]
            assert abs(r.value - beta[0]) < 1e-4 * max(1, np.abs(v).max()) / max(0.05, np.ptp(d[w > 0])) ** 2


# --- 5 --------------------------------------------------------------------------------------------------------------

LEVELS = "row_id bigint, metric string, interval_ns bigint, t bigint, s double, c bigint, i double, written_at timestamp_ntz"


def test_trailing(spark):
    day = lambda d: d * DAY_NS
    rows = [(1, "m", DAY_NS, day(10), 1.0, 1, 2.0, T0), (2, "m", DAY_NS, day(10), 5.0, 2, None, T0), (3, "m", DAY_NS, day(19), 7.0, 1, 1.0, T0), (4, "m", DAY_NS, day(25), 9.0, 0, 1.0, T0), (5, "m", 3600, day(12), 9.0, 9, 1.0, T0), (6, None, DAY_NS, day(1), 1.0, 1, 1.0, T0), (7, "q", DAY_NS, day(1), 1.0, 0, 1.0, T0), (8, "m", DAY_NS, None, 1.0, 1, 1.0, None)]
    levels = spark.createDataFrame(rows, LEVELS).withColumn("day", F.lit("clash"))
    got = {r.day: r for r in trailing_totals(levels).collect()}
    assert sorted(got) == list(range(10, 20))
    assert (got[16].s_7, got[17].s_7, got[17].s_30, got[17].c_30, got[19].s_30) == (5.0, 0.0, 5.0, 2, 12.0)
    assert [d for d in got if got[d].c_7 == 0 and got[d].c_30 > 0] == [17, 18]
    assert got[17].mean_7 is None and got[10].s_avg_7 == 5.0 / 7
    assert trailing_totals(levels.where("false")).count() == 0


# --- 6 --------------------------------------------------------------------------------------------------------------


def wave(n, seed=0):
    return np.round(100 + 20 * np.sin(np.arange(n) / 40) + np.random.default_rng(seed).normal(size=n), 2)


def test_implausible(spark, configs):
    v = wave(900)
    v[100] += 60
    v[200:203] += 50
    v[300:330] = 77.0
    v[400:] += 300  # a lasting step
    v[500:520] += 60  # a longer burst
    v[600], v[601], v[602] = NAN, 1e21, -3.0
    rows = [("a.x", 10 * (k + 1), float(x)) for k, x in enumerate(v)]
    rows += [("a.c.s", 10 * (k + 1), float(k // 40 % 4) if k != 5 else 9.0) for k in range(400)]  # a state: long stretches are normal
    rows += [("a.x", 0, 5.0), ("a.x", None, 5.0), (None, 5, 5.0), ("a.x", 77, None), ("none", 5, 1.0)]
    pts = make(spark, rows).withColumn("score", F.lit("clash"))
    got = {(r.metric, r.t // 10 - 1): r for r in anomalies.implausible_readings(pts, configs).collect()}
    want = {("a.x", k) for k in (100, 200, 201, 202, *range(300, 330), 600, 601, 602)} | {("a.c.s", 5)}
    assert set(got) == want
    assert got["a.x", 100].spike and got["a.x", 310].frozen and got["a.c.s", 5].impossible
    assert anomalies.implausible_readings(pts.where("false"), configs).count() == 0


def test_results_do_not_depend_on_the_cuts(spark, configs):
    """Slices that are shorter than the context they need."""
    v = wave(3000, 1)
    v[::97] += 80
    v[1000:1040] = 5.5
    pts = make(spark, [(m, 10 * (k + 1), float(x)) for m in ("a.x", "a.y") for k, x in enumerate(v)]).cache()
    configs.count()
    results = []
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        results.append(sorted(tuple(r) for r in anomalies.describe_readings(pts, configs).select("metric", "t", "cell", "flags").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = load_configs(configs)
    cell, flags = anomalies.describe(np.arange(3000), v, table.find("a.x"))
    want = sorted((m, 10 * (k + 1), int(cell[k]), int(flags[k])) for m in ("a.x", "a.y") for k in range(3000))
    assert results[0] == want and results[1] == want and results[2] == want


def test_the_forest_proposes(spark, configs, monkeypatch):
    """Without the forest's score there are no spikes; it proposes few readings, all spikes, and by no means all that stand off less."""
    v = wave(4000, 2)
    v[50::100] += 40
    near = np.arange(20, 4000, 100)
    v[near] += np.where(near // 100 % 2, 4, -4)
    pts = make(spark, [("a.x", 10 * (k + 1), float(x)) for k, x in enumerate(v)]).cache()
    rows = {r.t // 10 - 1: r for r in anomalies.score_readings(pts, configs).collect()}
    proposed = {k for k, r in rows.items() if r.score >= anomalies.MIN_SCORE}
    spikes = set(range(50, 4000, 100))
    assert spikes <= proposed and len(proposed) < 0.15 * len(v)
    assert len(set(near.tolist()) - proposed) >= len(near) / 4
    found = lambda: {r.t // 10 - 1 for r in anomalies.implausible_readings(pts, configs).where("spike").collect()}
    assert found() == spikes
    monkeypatch.setattr(anomalies, "MIN_SCORE", 0.99)
    assert found() == set()


def test_season_is_the_hour_of_the_day(spark, configs):
    """Metrics of several days: a reading that is usual at noon stands out at night."""
    step = 600_000_000_000
    t = np.arange(1, 5 * 144)
    v = 500 + 300 * np.sin(t * step % anomalies.DAY_NS / anomalies.DAY_NS * 2 * np.pi) + np.random.default_rng(4).normal(size=len(t))
    v[300] = 1000 - v[300]
    pts = make(spark, [("a.x", int(k * step), float(x)) for k, x in zip(t, v, strict=True)] + [("a.y", int(k * 1000), float(x)) for k, x in zip(t, v, strict=True)])
    got = {(r.metric, r.t): r.cell >> 16 for r in anomalies.with_season(anomalies.describe_readings(pts, configs)).collect()}
    own = [got["a.x", int(k * step)] for k in t]
    assert own[300] >= 3 and np.mean(np.array(own) >= 3) < 0.1
    assert not any(got["a.y", int(k * 1000)] for k in t)  # less than a day: no profile


def test_forest_finds_the_rare():
    x = np.array([[0, 0], [1, 0], [0, 1], [1, 1], [15, 15]], float)
    s = forest_scores(x, np.array([200, 200, 200, 200, 2.0]), 1)
    assert s.argmax() == 4 and s[4] > 0.6 > s[:4].max()
    assert (s == forest_scores(x, np.array([200, 200, 200, 200, 2.0]), 1)).all()
    assert len(forest_scores(x[:1], np.array([5.0]), 1)) == 1
    assert ConfigTable({}, {}).find("x") is None
