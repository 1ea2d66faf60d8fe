"""The write and read operators on a small series whose answers are known, and on random ones against a fold."""

import math
import os
import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.config import SECOND, RollupConfig
from tidemark.model import RAW
from tidemark.operators import aggregate as agg
from tidemark.operators import retrieve, rollup, scans
from tidemark.operators.scans import CLOSED, EXTENDED, INFINITY, OPEN

sys.path.insert(0, os.path.dirname(__file__))
from fold import folded  # noqa: E402

OFFSET = 1_519_130_000
CONFIG = RollupConfig(10 * SECOND, 1000 * SECOND, 10)
SERIES = [(11, -37), (21, -36), (42, -30), (48, -20), (53, -10), (67, 0), (80, -10), *((s, 20) for s in range(101, 200)), (203, 31), (217, 35), (219, 45), (225, 35)]


def at(seconds, ns=0):
    return (OFFSET + seconds) * SECOND + ns


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([("foo", at(t), float(v)) for t, v in SERIES], RAW).cache()


@pytest.fixture(scope="module")
def levels(points):
    return rollup.pyramid(points, CONFIG).cache()


def test_lowest_level(levels):
    rows = {(r.t // SECOND - OFFSET): r for r in levels.where(f"interval = {10 * SECOND}").collect()}
    assert sorted(rows) == list(range(10, 220, 10))
    for t, a, c, i, s, mn, mx in [(10, 9, 1, -324, -37, -37, -36), (20, 10, 1, -306, None, None, None), (30, 10, 0, -300, 0, -30, -30), (40, 10, 2, -200, -50, -30, -10), (210, 10, 2, 370, 80, 35, 45)]:
        r = rows[t]
        assert (r.a, r.c, r.i) == (a * SECOND, c, i * SECOND)
        if s is not None:
            assert (r.s, r.mn, r.mx) == (s, mn, mx)


def test_second_level(levels):
    rows = [tuple(r) for r in levels.where(f"interval = {100 * SECOND}").orderBy("t").select("t", "a", "c", "i", "s", "mn", "mx").collect()]
    assert rows == [(at(0), 89 * SECOND, 7, -890.0 * SECOND, -143.0, -37.0, 20.0), (at(100), 100 * SECOND, 99, 2011.0 * SECOND, 1980.0, 20.0, 31.0)]


@pytest.mark.parametrize(("samples", "n"), [(31, 110), (30, 21), (5, 21), (3, 2)])
def test_samples(points, levels, samples, n):
    assert retrieve.retrieve_samples(points, levels, CONFIG, at(0), at(300), samples).count() == n


def test_rows_and_flex(points, levels):
    one = retrieve.retrieve_rows(points, levels, CONFIG, at(15), at(15), 10 * SECOND)
    assert [r.t for r in one.collect()] == [at(10)]
    kind, rows = retrieve.retrieve_flex(points, levels, CONFIG, at(0), at(300), SECOND)
    assert kind == "points" and rows.count() == 110
    kind, rows = retrieve.retrieve_flex(points, levels, CONFIG, at(0), at(300), 10 * SECOND)
    assert kind == "rows" and rows.count() == 21
    with pytest.raises(ValueError):
        retrieve.retrieve_samples(points, levels, CONFIG, at(0), at(300), 0)
    with pytest.raises(ValueError):
        retrieve.retrieve_rows(points, levels, CONFIG, at(300), at(0), SECOND)


AGGREGATES = [
    (at(20), at(220), 108, -36, 45, 1985, 200 * SECOND, 2153 * SECOND), (at(11), at(225), 109, -37, 45, 1948, 214 * SECOND, 2004 * SECOND),
    (at(1), at(230), 109, -37, 45, 1948, 214 * SECOND, 2004 * SECOND), (at(110), at(130), 20, 20, 20, 400, 20 * SECOND, 400 * SECOND),
    (at(20), at(30), 1, -36, -30, -36, 10 * SECOND, -306 * SECOND), (at(11), at(21), 1, -37, -36, -37, 10 * SECOND, -360 * SECOND),
    (at(21), at(42), 1, -36, -30, -36, 21 * SECOND, -630 * SECOND), (at(12), at(20), 0, -36, -36, 0, 8 * SECOND, -288 * SECOND),
    (at(10), at(20), 1, -37, -36, -37, 9 * SECOND, -324 * SECOND), (at(0), at(10), 0, math.inf, -math.inf, 0, 0, 0), (at(1), at(11), 0, math.inf, -math.inf, 0, 0, 0),
    (at(501), at(504), 0, math.inf, -math.inf, 0, 0, 0), (at(225), at(504), 0, 35, 35, 0, 0, 0), (at(225, -1), at(504), 0, 35, 35, 0, 1, 35), (at(1), at(11, 1), 1, -37, -36, -37, 1, -36),
]


@pytest.mark.parametrize("case", AGGREGATES)
def test_aggregates(points, levels, case):
    b, e, c, mn, mx, s, a, i = case
    for got in (agg.aggregate(points, b, e), agg.aggregate_hierarchical(points, levels, CONFIG, b, e)):
        r = got.first()
        assert (r.c, r.mn, r.mx, r.s, r.a, r.i) == (c, mn, mx, s, a, i)


def test_aggregate_needs_a_range(points):
    with pytest.raises(ValueError):
        agg.aggregate(points, at(10), at(10))


PAIRS = [(x, y) for x in (OPEN, CLOSED, EXTENDED) for y in (OPEN, CLOSED, EXTENDED)]
COUNTS = [
    (at(20), at(220), [108, 108, 109, 108, 108, 109, 109, 109, 110]), (at(11), at(225), [108, 109, 109, 109, 110, 110, 109, 110, 110]), (at(11), at(21), [0, 1, 1, 1, 2, 2, 1, 2, 2]),
    (at(12), at(20), [0, 0, 1, 0, 0, 1, 1, 1, 2]), (at(10), at(20), [1, 1, 2, 1, 1, 2, 1, 1, 2]), (at(0), at(10), [0, 0, 1, 0, 0, 1, 0, 0, 1]), (at(501), at(504), [0, 0, 0, 0, 0, 0, 1, 1, 1]),
    (at(225), at(504), [0, 0, 0, 1, 1, 1, 1, 1, 1]), (at(225, -1), at(504), [1, 1, 1, 1, 1, 1, 2, 2, 2]), (at(1), at(11), [0, 1, 1, 0, 1, 1, 0, 1, 1]), (at(1), at(11, 1), [1, 1, 2, 1, 1, 2, 1, 1, 2]),
]


@pytest.mark.parametrize("case", COUNTS)
def test_counts(points, case):
    b, e, want = case
    assert [sum(r.n for r in scans.count(points, b, e, z).collect()) for z in PAIRS] == want


def test_default_counts_and_range(points):
    n = lambda *x: sum(r.n for r in scans.count(points, *x).collect())
    assert [n(at(x), at(x)) for x in (1, 11, 85, 225, 250)] == [1, 1, 1, 1, 0]
    assert (n(at(1), at(230)), n(at(20), at(30)), n(), n(at(0), at(1), (INFINITY, INFINITY))) == (110, 2, 110, 110)
    with pytest.raises(ValueError):
        n(at(10), at(1))
    assert scans.time_range(points).first()[1:] == (at(11), at(225))


def test_long_gaps_and_empty(spark):
    config = RollupConfig(40 * SECOND, 400_000 * SECOND, 10)
    ts = [1_696_102_100, 1_696_112_100, 1_697_112_100]
    pts = spark.createDataFrame([("bar", t * SECOND, 42.0) for t in ts], RAW)
    levels = rollup.pyramid(pts, config)
    for b, e in ((ts[0], ts[2]), (ts[0] + 1, ts[2] - 1), (ts[1] - 7, ts[1] + 7), (ts[0], ts[0] + 39)):
        assert agg.aggregate_hierarchical(pts, levels, config, b * SECOND, e * SECOND).first().a == (e - b) * SECOND
    empty = spark.createDataFrame([], RAW)
    assert rollup.pyramid(empty, config).count() == 0
    assert retrieve.retrieve_flex(empty, rollup.pyramid(empty, config), config, 0, 10, -1)[1].count() == 0
    long = rollup.lowest_level(spark.createDataFrame([("x", 10, 1.0), ("x", 4 * 200_000 + 10, 1.0)], RAW), 4)
    r = long.selectExpr("count(*) AS n", "min(t) AS a", "max(t) AS b", "sum(a) AS covered").first()
    assert (r.n, r.a, r.b, r.covered) == (200_000, 8, 800_004, 800_008 - 10)


def scans_of(df):
    """The filters on t of each scan of files."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(LessThan|GreaterThan|LessThanOrEqual|GreaterThanOrEqual)\(t,", x) for x in re.findall(r"PushedFilters: \[([^\n]*?)\]", plan)]


def test_both_bounds_reach_every_scan_of_a_range(spark, points, levels, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    points.write.parquet(f"{tmp_path}/raw")
    levels.write.partitionBy("interval").parquet(f"{tmp_path}/levels")
    raw, rows = spark.read.parquet(f"{tmp_path}/raw"), spark.read.parquet(f"{tmp_path}/levels")
    b, e = at(25), at(215)
    both = lambda filters: any(x.startswith("Greater") for x in filters) and any(x.startswith("Less") for x in filters)
    for scope in ((CLOSED, CLOSED), (CLOSED, EXTENDED), (EXTENDED, OPEN), (EXTENDED, EXTENDED)):
        found = scans_of(scans.raw_scan(raw, b, e, scope))
        assert both(found[0]) and len(found) == 1 + scope.count(EXTENDED) and all(found)
    found = scans_of(agg.aggregate(raw, b, e))
    assert all(found) and sum(both(x) for x in found) >= 1  # the others are before the begin and after the end
    ends = spark.createDataFrame([("foo", at(11), at(225))], "metric string, first bigint, last bigint")
    plan = agg.aggregate_hierarchical(raw, rows, CONFIG, b, e, ends)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "PushedFilters" in line]
    of_raw, of_levels = [x for x in reads if "/raw]" in x], [x for x in reads if "/levels]" in x]
    assert of_raw and all("GreaterThanOrEqual(t," in x and "LessThan" in x for x in of_raw)
    assert of_levels and all(("GreaterThanOrEqual(t," in x or "EqualTo(t," in x) and "interval" in x.partition("PartitionFilters")[2].partition("PushedFilters")[0] for x in of_levels)


def test_hierarchical_equals_direct(spark):
    """Many metrics at once: dense and sparse ones, some that begin or end within the range, with points on and off the grid."""
    import random

    r, rows = random.Random(6), []
    for k in range(120):
        t = r.randrange(1, 900)
        for _ in range(r.randrange(1, 60)):
            rows.append((f"m{k}", t, float(r.randrange(-99, 99))))
            t += r.choice([1, 2, 5, 8, 8, 40, 300][: r.randrange(1, 8)])
    config = RollupConfig(8, 128, 4)
    pts = spark.createDataFrame(rows, RAW).cache()
    levels = rollup.pyramid(pts, config).cache()
    flat = lambda df: {x.metric: tuple(x)[1:] for x in df.collect()}
    for b, e in ((1, 2000), (100, 600), (104, 608), (333, 371), (97, 1201), (500, 501), (128, 640), (900, 40_000)):
        want, got = flat(agg.aggregate(pts, b, e)), flat(agg.aggregate_hierarchical(pts, levels, config, b, e))
        assert got == want, (b, e)
        # and the direct one against sums over the points
        for name in ("m0", "m7", "m33"):
            own = [(t, v) for m, t, v in rows if m == name]
            first, last = own[0][0], own[-1][0]
            if e <= first or b > last:
                assert want[name] == (math.inf, -math.inf, 0.0, 0, 0.0, 0)
                continue
            lo, hi = max(b, first), min(e, last)
            assert want[name][3] == sum(lo <= t < hi for t, _ in own) and want[name][5] == hi - lo
            assert want[name][4] == sum(v * max(0, min(t, hi) - max(p, lo)) for (p, _), (t, v) in zip(own, own[1:], strict=False))


streams = st.lists(st.tuples(st.integers(1, 60), st.integers(-9, 9)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(streams, st.sampled_from([4, 8, 12]), st.sampled_from([2, 4]), st.integers(0, 24))
def test_batch_incremental_and_fold_agree(spark, steps, low, factor, cut):
    config = RollupConfig(low, low * factor**2, factor)
    t, series = 0, []
    for d, v in steps:
        t += d
        series.append((t, float(v)))
    pts = spark.createDataFrame([("m", *x) for x in series], RAW)
    flat = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    want = folded(series, config)
    assert flat(rollup.pyramid(pts, config)) == want
    first = spark.createDataFrame([("m", *x) for x in series[: min(cut, len(series))]], RAW)
    old = rollup.pyramid(first, config)
    assert flat(old.unionByName(rollup.extend_pyramid(old, pts, config))) == want


@settings(max_examples=200, deadline=None)
@given(streams, st.sampled_from([4, 8, 12]), st.sampled_from([2, 4]), st.lists(st.integers(0, 25), max_size=4))
def test_stream_and_fold_agree(steps, low, factor, cuts):
    """Whatever the micro-batches."""
    from tidemark.streaming.rollup import advance

    config = RollupConfig(low, low * factor**2, factor)
    t = np.cumsum([d for d, _ in steps])
    v = np.array([x for _, x in steps], float)
    held, previous, got = [], 0, []
    for i, j in zip([0, *sorted(cuts)], [*sorted(cuts), len(t)], strict=True):
        if i < min(j, len(t)):
            held, closed = advance(config.levels, previous, held, t[i:j], v[i:j])
            previous = int(t[i:j][-1])
            got += [tuple(r) for rows in closed for r in rows[["interval", "t", "mn", "mx", "s", "c", "i", "a"]].itertuples(index=False)]
    assert sorted(got) == folded(list(zip(t.tolist(), v.tolist(), strict=True)), config)


def test_fold_by_hand():
    assert folded([(23, 42.0)], RollupConfig(10, 10, 2)) == []
    assert folded([(5, 1.0), (12, 3.0), (20, 5.0)], RollupConfig(10, 20, 2)) == [
        (10, 0, 1.0, 3.0, 1.0, 1, 15.0, 5), (10, 10, 3.0, 5.0, 3.0, 1, 46.0, 10), (20, 0, 1.0, 5.0, 4.0, 2, 61.0, 15)]
