"""Catalog, binary files, stream, quality tools and texts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import DAY, SECOND, RollupConfig
from tidemark.errors import AccessError, DuplicateMetric, FormatError, MissingMetricConfig, OutOfOrder, TidemarkError
from tidemark.functions.ordered import with_position
from tidemark.functions.text import duration_text, row_text, time_text
from tidemark.model import RAW
from tidemark.operators import quality, rollup
from tidemark.sources import binary
from tidemark.sources.catalog import Catalog
from tidemark.sources.synthetic import dummy_points

META = {"interval_min": 10, "interval_max": 1000, "interval_factor": 10}


def points(spark, ts, metric="m"):
    return spark.createDataFrame([(metric, t, float(t % 7)) for t in ts], RAW)


def test_catalog(spark, tmp_path):
    config = {"type": "file", "path": f"file://{tmp_path}/db", "metrics": {"foo": META, "prefix": {**META, "prefix": True}, "ro": {**META, "mode": "R"}, "wo": {**META, "mode": "W"}}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    cat = Catalog.from_config(spark, f"file://{tmp_path}/c.json")
    foo = cat["foo"]
    foo.insert(points(spark, [23, 45, 210]))
    assert (foo.count(), foo.range(), foo.levels().count()) == (3, (23, 210), 19 + 2)
    with pytest.raises(OutOfOrder):
        foo.insert(points(spark, [210]))
    again = Catalog.from_config(spark, {**config, "metrics": {"foo": {"interval_min": 20, "interval_max": 20, "interval_factor": 2}}})["foo"]
    assert again.meta() == RollupConfig(10, 1000, 10)  # what is stored holds
    again.insert(points(spark, [1500, 2501]))
    whole = rollup.pyramid(points(spark, [23, 45, 210, 1500, 2501]), RollupConfig(10, 1000, 10))
    rows = lambda df: sorted(tuple(r) for r in df.select("interval", "t", "mn", "mx", "s", "c", "i", "a").collect())
    assert rows(again.levels()) == rows(whole)
    assert [r.t for r in again.retrieve(24, 100).collect()] == [45, 210]
    assert again.aggregate(23, 2501).first().a == 2478
    for name in ("prefix.metric", "prefix.", "prefix.other"):
        cat[name].insert(points(spark, [5]))
    for name in ("invalid.metric", "foo.metric"):
        with pytest.raises(MissingMetricConfig):
            cat[name]
    with pytest.raises(AccessError):
        cat["ro"].insert(points(spark, [5]))
    assert cat["ro"].count() == 0
    with pytest.raises(AccessError):
        cat["wo"].count()
    with pytest.raises(DuplicateMetric):
        cat.add("foo", META)
    assert "prefix.metric" in cat.names() and cat.names() == sorted(cat.names())
    for bad in ({"type": "x"}, {"type": "file", "path": "x", "metrics": {"a": {"mode": "Z"}}}):
        with pytest.raises(TidemarkError):
            Catalog.from_config(spark, bad)
    backup = again.repair(quality.RepairRules(intervals=[(200, 300)]))
    assert backup == "foo.backup-0" and [r.t for r in again.points().orderBy("t").collect()] == [23, 45, 1500, 2501]
    assert "foo.backup-0" in again.catalog.names()


def test_many_metrics_at_once(spark, tmp_path):
    """One insertion for all; names with any characters stay in the store's folder; what failed half-way is completed by doing it again."""
    odd = ["x.a", "x.b/../..", "x.c d=e%", "y.a"]
    config = {"type": "file", "path": f"file://{tmp_path}/db", "metrics": {"x": {**META, "prefix": True}, "y.a": {"interval_min": 20, "interval_max": 20, "interval_factor": 2}, "r": {**META, "mode": "R"}}}
    cat = Catalog.from_config(spark, config)
    every = lambda ts: spark.createDataFrame([(m, t, float(t % 7)) for m in odd for t in ts], RAW)
    cat.insert(every([23, 45, 210]))
    cat.insert(every([220, 531, 1200]))
    for m in odd:
        own = Catalog.from_config(spark, config)[m]
        want = rollup.pyramid(points(spark, [23, 45, 210, 220, 531, 1200], m), RollupConfig(20, 20, 2) if m == "y.a" else RollupConfig(10, 1000, 10))
        assert sorted(map(tuple, own.levels().collect())) == sorted(map(tuple, want.collect())) and own.count() == 6
    assert cat.names() == sorted(odd) and sorted(p.name for p in tmp_path.iterdir()) == ["db"]
    for bad, error in ((points(spark, [5], "z"), MissingMetricConfig), (points(spark, [5], "r"), AccessError), (points(spark, [1200], "x.a"), OutOfOrder), (points(spark, [0], "x.n"), OutOfOrder)):
        with pytest.raises(error):
            cat.insert(bad)
    # levels were written, the points weren't
    import shutil

    shutil.copytree(f"{tmp_path}/db/raw", f"{tmp_path}/raw")
    cat.insert(every([2500, 2501]))
    shutil.rmtree(f"{tmp_path}/db/raw")
    shutil.move(f"{tmp_path}/raw", f"{tmp_path}/db/raw")
    cat.insert(every([2500, 2501]))
    want = rollup.pyramid(points(spark, [23, 45, 210, 220, 531, 1200, 2500, 2501], "x.a"), RollupConfig(10, 1000, 10))
    assert sorted(map(tuple, cat["x.a"].levels().collect())) == sorted(map(tuple, want.collect())) and cat["x.a"].count() == 8


def test_binary_files(spark, tmp_path):
    config = RollupConfig(10, 1000, 10)
    (tmp_path / "m").mkdir()
    raw = np.array([(23, 1.5), (45, 2.5)], binary.POINT)
    path = str(tmp_path / "m/raw.rec")
    binary.write_file(path, config, raw)
    with open(path, "ab") as f:
        f.write(b"half a")
    binary.write_file(str(tmp_path / "m/10.rec"), config, np.array([(20, 1, 2, 3, 1, 4, 10)], binary.ROW), 10)
    assert [tuple(r) for r in binary.read_records(spark, str(tmp_path)).collect()] == [("m", 0, 23, 1.5), ("m", 1, 45, 2.5)]
    assert [tuple(r) for r in binary.read_records(spark, str(tmp_path), 10, "m").collect()] == [("m", 10, 20, 1.0, 2.0, 3.0, 1, 4.0, 10, 0)]
    assert [(r.entries, r.first, r.last) for r in binary.describe_files(spark, str(tmp_path)).orderBy("interval").collect()] == [(2, 23, 45), (1, 20, 20)]
    odd = ["a/b", "..", "%41", "x:y z"]
    binary.write_records(spark.createDataFrame([(m, t, 1.0) for m in odd for t in (5, 7)], RAW), f"file://{tmp_path}/odd", config)
    assert sorted({r.metric for r in binary.read_records(spark, f"file://{tmp_path}/odd").collect()}) == sorted(odd)
    assert [tuple(r) for r in binary.read_records(spark, f"file://{tmp_path}/odd", metric="..").collect()] == [("..", 0, 5, 1.0), ("..", 1, 7, 1.0)]
    assert sorted(r.metric for r in binary.describe_files(spark, f"file://{tmp_path}/odd").collect()) == sorted(odd)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["m", "odd"]
    good = open(path, "rb").read()
    for at, x in ((0, b"X"), (8, b"\0"), (24, b"\7")):
        open(path, "wb").write(good[:at] + x + good[at + 1 :])
        with pytest.raises(FormatError):
            binary.read_header(path)


def test_throttle_and_monotonic(spark):
    pts = points(spark, [10, 12, 21, 22, 40, 51])
    assert [r.t for r in quality.throttle(pts, 10).orderBy("t").collect()] == [12, 40, 51]
    assert [r.t for r in quality.throttle(pts, 9).orderBy("t").collect()] == [10, 21, 40, 51]
    rows = spark.createDataFrame([("m", i, t, v) for i, (t, v) in enumerate([(5, 1.0), (9, float("nan")), (7, 2.0), (7, 3.0), (6, 4.0), (8, -5.0)])], "metric string, pos bigint, t bigint, v double")
    kept = quality.repair(rows, quality.RepairRules(absolute=True)).orderBy("pos").collect()
    assert [(r.t, r.v) for r in kept] == [(5, 1.0), (7, 2.0), (8, 5.0)]  # the dropped 9 doesn't hold back the 7
    assert sorted((r.pos, r.issue) for r in quality.check_raw(rows).collect()) == [(1, "non_finite"), (2, "non_monotonic"), (3, "non_monotonic"), (4, "non_monotonic"), (5, "non_monotonic")]


def test_checks_of_sound_metrics_are_empty(spark):
    day = 11_000 * DAY
    pts = points(spark, [day + k * 700 * SECOND for k in range(300)]).withColumn("pos", F.col("t"))
    config = RollupConfig(3600 * SECOND, DAY, 24)
    levels = with_position(rollup.pyramid(pts, config), "t", DAY, ("metric", "interval"))
    assert quality.check_metrics(pts, levels, config, day + 40 * DAY).count() == 0
    assert quality.corrupt_metrics(pts, levels, config, day - 1).count() == 1  # all in the future


def test_shared_tables(spark, monkeypatch):
    from tidemark.sources import shared

    monkeypatch.setattr(shared, "_made", {})
    got = shared.materialize(spark.range(3), "x")
    assert got.count() == 3 and len(shared._made) == 1
    assert shared.clear(spark) == 1 and shared.clear(spark) == 0

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="share"):
        shared.shared_dir(Cluster)


def test_texts(spark):
    row = spark.createDataFrame([("m", 90 * SECOND, 1_519_130_000 * SECOND + 7, 1.0, 2.0, 3.0, 2, 4.0, 5)], "metric string, interval bigint, t bigint, mn double, mx double, s double, c bigint, i double, a bigint")
    got = row.select(duration_text("interval"), time_text("t"), row_text(), duration_text(F.lit(-5).cast("bigint"))).first()
    assert got[0] == "90.000000000s" and got[1] == "2018-02-20T12:33:20.000000007Z" and got[3] == "-0.000000005s"
    assert got[2].startswith("[2018-02-20T12:33:20.000000007Z + 90.000000000s] min: 1.0, max: 2.0, mean: 0.8, count: 2, active: 0.000000005s")


def test_dummy(spark):
    assert [tuple(r) for r in dummy_points(spark, 2).collect()] == [("dummy", 1_000_000, 42.0), ("dummy", 51_000_000, 42.0)]


@pytest.mark.parametrize("late", ["drop", "mark"])
def test_stream_goes_on_from_its_checkpoint(spark, tmp_path, late):
    from tidemark.streaming.rollup import late_points, level_rows, stream_levels

    config = RollupConfig(10, 100, 10)

    def run(part, late=late):
        points(spark, part).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(RAW).parquet(f"{tmp_path}/in")
        q = stream_levels(s, config, late).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()

    run([23, 45, 210])
    run([220, 209, 531])  # 209 is late
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, level_rows(out).collect())) == sorted(map(tuple, rollup.pyramid(points(spark, [23, 45, 210, 220, 531]), config).collect()))
    assert [r.t for r in late_points(out).collect()] == ([209] if late == "mark" else [])
    with pytest.raises(Exception, match="not after"):
        run([7], "raise")
