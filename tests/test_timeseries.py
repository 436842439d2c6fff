"""Time-series operators against numpy on small series; slices must not change anything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.operators import sliced
from tarmac.operators import timeseries as ts


@pytest.fixture
def series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        t = np.sort(rng.choice(400, 60, replace=False)).astype(float)
        rows += [(s, k, float(x), float(v), float(h)) for k, (x, v, h) in enumerate(zip(t, rng.normal(5, 2, 60), rng.uniform(-10, 10, 60)))]
    return spark.createDataFrame(rows, "session long, row long, t double, v double, h double")


def by_session(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.session, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("width", [7.0, 50.0, 1e9])
def test_interpolation_equals_numpy_at_any_slice_width(series, width):
    grid = ts.uniform_grid(series, "session", "t", 3.7)
    got = by_session(ts.interpolate(series, grid, "session", "t", "v", width=width), "k", "t", "v")
    for s, rows in by_session(series, "t", "v").items():
        x, y = np.array(rows).T
        k, t, v = np.array(got[s]).T
        assert np.allclose(v, np.interp(t, x, y), atol=1e-12) and len(k) == math.floor((x[-1] - x[0]) / 3.7) + 1


def test_outside_is_clamped_or_null(spark):
    points = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 3.0), (1, 20.0, 5.0)], "session long, t double, v double")
    grid = spark.createDataFrame([(1, 0, 5.0), (1, 1, 15.0), (1, 2, 20.0), (1, 3, 99.0), (2, 0, 1.0)], "session long, k long, t double")
    clamped = {(r.session, r.k): r.v for r in ts.interpolate(points, grid, "session", "t", "v").collect()}
    open_ = {(r.session, r.k): r.v for r in ts.interpolate(points, grid, "session", "t", "v", clamp=False).collect()}
    assert clamped == {(1, 0): 1.0, (1, 1): 2.5, (1, 2): 4.0, (1, 3): 4.0, (2, 0): None}
    assert open_ == {(1, 0): None, (1, 1): 2.5, (1, 2): 4.0, (1, 3): None, (2, 0): None}


@pytest.mark.parametrize("width", [5.0, 80.0, 1e9])
def test_running_sum_and_previous(series, width):
    out = sliced.running_sum(series, "session", "t", ["t"], F.col("v"), "s", width)
    prev = sliced.with_previous(series, "session", "t", ["t"], {"v": F.col("v")}, width)
    total, before = by_session(out, "t", "s"), {(r.session, r.t): r.prev_v for r in prev.collect()}
    for s, rows in by_session(series, "t", "v").items():
        t, v = np.array(rows).T
        assert np.allclose([x for _, x in total[s]], np.cumsum(v))
        assert [before[s, x] for x in t] == [None, *v[:-1]]


def test_unwrap_and_derivative(series):
    got = by_session(ts.unwrapped(series, "session", "t", ["t"], F.col("h")), "t", "unwrapped")
    for s, rows in by_session(series, "t", "h").items():
        h = np.array([x for _, x in rows])
        assert np.allclose([x for _, x in got[s]], np.unwrap(h))
    grid = series.withColumnRenamed("row", "k")
    got = by_session(ts.derivative(grid, "session", "t", "k", "v"), "k", "derivative")
    for s, rows in by_session(series, "t", "v").items():
        t, v = np.array(rows).T
        assert np.allclose([x for _, x in got[s]], np.gradient(v, t))


def test_a_rise_by_pi_stays(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, math.pi), (1, 2.0, 0.0)], "session long, t double, a double")
    assert [r.unwrapped for r in ts.unwrapped(df, "session", "t", ["t"], F.col("a")).orderBy("t").collect()] == pytest.approx(np.unwrap([0, math.pi, 0]).tolist())


def test_change_points_and_validity(spark):
    rows = [(1, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (1, 2.0, 0.0, 0.0), (1, 3.0, 1.0, 1.0), (1, 4.0, 1.0, 2.0), (1, 5.0, None, 2.0)]
    out = ts.fixes(spark.createDataFrame(rows, "session long, t double, lat double, lon double"), "session", "t", ["t"], "lat", "lon")
    assert sorted(r.t for r in out.collect()) == [0.0, 4.0]


def test_persistence_needs_contiguity(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 6.0), (1, 3.0, 7.0)], "session long, t double, y double")
    assert [r.y_pred for r in ts.persistence(df, "session", "t", ["t"], "y").orderBy("t").collect()] == [None, 5.0, None]


def test_missing_lag_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0)], "session long, t double")
    lags = spark.createDataFrame([(1, 500.0)], "session long, lag_ms double")
    assert ts.apply_offset(df.filter("session = 1"), lags, "session", "t").first().t == -0.5
    with pytest.raises(Exception, match="no lag"):
        ts.apply_offset(df, lags, "session", "t").collect()


def test_despike_repeats_the_ends(spark):
    v = [1.0, 1.1, 9.0, 1.2, 1.0, 1.1, 1.3]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)], "session long, row long, v double")
    got = {r.row: (r.is_spike, r.clean) for r in ts.despike(df, "session", "row", "v", 2).collect()}
    padded = np.pad(v, 2, mode="edge")
    for k, x in enumerate(v):
        w = padded[k : k + 5]
        m = np.median(w)
        mad = np.median(np.abs(w - m))
        spike = mad > 1e-9 and abs(x - m) > 3 * mad
        assert got[k] == (spike, m if spike else x)


def test_path_ratio_and_geodesics(spark):
    from tarmac.functions import geo

    df = spark.createDataFrame([(1, 0.0, 51.5, -2.5, 10.0), (1, 10.0, 51.501, -2.5, 10.0), (1, 20.0, 51.502, -2.5, 10.0)], "session long, t double, lat double, lon double, v double")
    r = ts.path_ratio(df, "session", "t", ["t"], "lat", "lon", "v").first()
    assert r.path_m == pytest.approx(222.5, rel=1e-3) and r.integral_m == 200 and r.verdict == "ok"
    d = spark.range(1).select(geo.distance(F.lit(51.5), F.lit(-2.5), F.lit(51.501), F.lit(-2.5)).alias("d"), geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e"), geo.distance(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("z")).first()
    assert d.d == pytest.approx(111.2578, abs=1e-3) and d.e == pytest.approx(math.pi / 2) and d.z == 0
