"""Runs and percentiles."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.quantiles import RANK_ERROR, DyadicSketch, decode, encode, percentiles
from tidemark.llm.runs import runs, symbols

POINTS = "point_id bigint, metric string, t bigint, v double, recorder_id int, arrived_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)
NAN = float("nan")


def make(spark, rows):
    return spark.createDataFrame([(i, m, t, v, 1, T0 + dt.timedelta(seconds=i)) for i, (m, t, v) in enumerate(rows)], POINTS)


@pytest.fixture(scope="module")
def configs(spark):
    return spark.createDataFrame([("a", True, 10, 0.5), ("b", False, 10, None)], "cfg_name string, is_prefix boolean, interval_min bigint, deadband double").cache()


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(queries, name)


def test_symbols():
    assert len(set(symbols(np.array([False, True, True])))) == 1
    s = symbols(np.zeros(50_000, bool))
    assert all(a != b for a, b in zip(s, s[1:], strict=False)) and s.isprintable()


def test_runs(spark, configs):
    rows = [("a.x", 10, 1.0), ("a.x", 20, 1.4), ("a.x", 30, 1.8), ("a.x", 41, 1.8), ("a.x", 51, 1.8), ("a.x", 55, NAN), ("a.x", 61, 1.8), ("a.x", 62, 9.0), ("a.x", 62, 1.9), ("a.x", 63, 7.0)]
    rows += [("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0), ("none", 1, 1.0), ("none", 2, 1.0), ("none", 3, 1.0), (None, 1, 1.0), ("a.x", None, 1.0), ("a.x", 0, 1.0), ("a.x", 64, None)]
    pts = make(spark, rows).withColumn("n", F.lit("clash"))
    got = sorted((r.metric, r.t_start, r.t_end, r.n, r.duration_ns) for r in runs(pts, configs).collect())
    assert got == [("a.x", 10, 30, 3, 20), ("a.x", 41, 62, 4, 21), ("b", 1, 3, 3, 2)]
    assert runs(pts.where("false"), configs).count() == 0
    with pytest.raises(ValueError):
        runs(pts, configs, 2)


def test_runs_across_any_cut(spark, configs):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=300) * 9, rng.choice([1, 2, 3, 40], 300))
    rows = [(m, 5 * (k + 1), float(x)) for m in ("a.x", "a.y", "b") for k, x in enumerate(v)]
    pts = make(spark, rows).cache()
    want, i = [], 0
    while i < len(v):
        j = i
        while j + 1 < len(v) and abs(v[j + 1] - v[j]) <= 0.5:
            j += 1
        if j - i >= 2:
            want.append((5 * (i + 1), 5 * (j + 1), j - i + 1))
        i = j + 1
    for n in ("1", "6", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = runs(pts, configs).collect()
        assert sorted((r.t_start, r.t_end, r.n) for r in got if r.metric == "a.x") == want
        assert sorted((r.t_start, r.t_end, r.n) for r in got if r.metric == "a.y") == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rank_error(values, q, p):
    values = np.sort(values)
    tol = abs(q) * 2e-6 + 1e-300
    lo, hi = np.searchsorted(values, q - tol), np.searchsorted(values, q + tol, "right")
    rank = np.ceil(p * len(values))
    return max(0, lo + 1 - rank, rank - hi) / len(values)


def test_encoding_keeps_order():
    v = np.array([-1e20, -3.5, -1e-300, 0.0, 1e-300, 2.0, 2.1, 1e20])
    assert (np.diff(encode(v).astype(np.int64)) > 0).all() or (np.diff(encode(v).astype(np.int64)) >= 0).all()
    assert encode(np.array([0.0])) == encode(np.array([-0.0]))
    assert np.allclose(decode(encode(v[[0, 1, 5, 6, 7]])), v[[0, 1, 5, 6, 7]], rtol=1e-6)


def test_sketch_bound_merge_and_deletion():
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=60_000), rng.lognormal(3, 2, 60_000), rng.integers(0, 50, 60_000).astype(float), np.full(10, 7.0)):
        whole, parts = DyadicSketch(), [DyadicSketch() for _ in range(3)]
        whole.update(values)
        for k, s in enumerate(parts):
            s.update(values[k::3])
            parts[k] = DyadicSketch.from_bytes(s.to_bytes())
        parts[0].merge(parts[1])
        parts[0].merge(parts[2])
        whole.apply()
        parts[0].apply()
        assert (whole.counters == parts[0].counters).all() and (whole.exact == parts[0].exact).all()
        for p in (0.01, 0.25, 0.5, 0.9, 0.999):
            assert rank_error(values, whole.quantiles([p])[0], p) <= RANK_ERROR
    a, b = DyadicSketch(), DyadicSketch()
    a.update(values)
    b.update(values)
    b.update(np.arange(5000.0))
    b.delete(np.arange(5000.0))
    a.apply()
    b.apply()
    assert (a.counters == b.counters).all()
    assert np.isnan(DyadicSketch().quantiles([0.5])[0])


def test_bound_on_few_and_uneven_values():
    """Random quantiles of sets with few different values, whose prefixes are heavy: none is off by more than the bound."""
    rng = np.random.default_rng(9)
    for k in (30, 300, 3000):
        for weights in (np.full(k, 1000), np.maximum(1, 1e6 / np.arange(1, k + 1) ** 1.2).astype(np.int64)):
            for _ in range(12):
                values = np.sort(rng.normal(size=k))
                w = rng.permutation(weights)
                sketch, ends = DyadicSketch(), np.r_[0, np.cumsum(w)] / w.sum()
                sketch.update(values, w)
                ps = rng.random(20)
                q = sketch.quantiles(list(ps))
                lo, hi = np.searchsorted(values, q - np.abs(q) * 2e-6), np.searchsorted(values, q + np.abs(q) * 2e-6, "right")
                assert np.maximum(ends[lo] - ps, ps - ends[hi]).max() <= RANK_ERROR


def test_percentiles(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=3000)
    rows = [("a.b.c", 10**13 * (k % 30) + k + 1, float(x)) for k, x in enumerate(v)]
    rows += [("a.b.c", 1, 999.0), ("a.b.c", 1, float(v[0])), ("a.b.c", 7 * 10**14, NAN), ("a.b.c", 8 * 10**14, 1e21), ("a.b.c", 9 * 10**14, float("inf")), ("a.b.c", 9 * 10**14 + 1, None), (None, 1, 1.0)]
    pts = make(spark, rows).withColumn("sketch", F.lit("clash"))
    for keys in (["metric"], ["family"]):
        r = percentiles(pts, keys, [0.5, 0.99]).first()
        assert r.n == 3000 and rank_error(v, r.p50, 0.5) <= RANK_ERROR and rank_error(v, r.p99, 0.99) <= RANK_ERROR
    assert sum(r.n for r in percentiles(pts, ["metric", "day"], [0.5]).collect()) == 3000
    assert percentiles(pts.where("false"), ["metric"], [0.5]).count() == 0
