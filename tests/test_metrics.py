"""Facts about metrics, buckets and fits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.functions.angles import wrap
from tarmac.operators import estimators, learning
from tarmac.operators import metrics as m
from tarmac.operators import replay as rp
from tarmac.operators import statistics as st
from tarmac.operators import windowing as wn
from tarmac.views import samples


def test_identities(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0)], "k long, n double, e double")
    assert df.agg(m.crse(F.col("n"), F.col("e")).alias("x")).first().x == pytest.approx(math.hypot(3, 3))
    df = spark.createDataFrame([(0, 3.0), (1, -3.0), (2, None)], "k long, e double")
    r = df.agg(m.cae(F.col("e")).alias("c"), m.crse_scalar(F.col("e")).alias("s"), m.aeps(F.col("e")).alias("a"), m.last_finite(F.col("e"), F.col("k")).alias("l")).first()
    assert (r.c, r.s, r.a, r.l) == (0.0, 6.0, 3.0, -3.0)


def test_buckets(spark):
    v = [0.0, 4.9, 5.0, 14.9, 15.0, 24.9, 25.0, 100.0]
    got = spark.createDataFrame([(x,) for x in v], "v double").select(m.bucket(F.col("v")).alias("b"), "v").orderBy("v").collect()
    assert [r.b for r in got] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_pooled_against_bucket_mean(spark):
    df = spark.range(1040).select(F.when(F.col("id") < 1000, 20.0).otherwise(2.0).alias("y"), F.when(F.col("id") < 1000, 20.0).otherwise(12.0).alias("p"))
    r = m.bucket_mean_mae(df, "y", "p").first()
    assert r.pooled_mae == pytest.approx(400 / 1040) and r.bucket_mean_mae == pytest.approx(5.0)
    small = df.filter("y = 20").limit(100).union(df.filter("y = 2").limit(5))
    assert m.bucket_mean_mae(small, "y", "p").first().bucket_mean_mae == 0
    every = m.bucketed_mae(small, "y", "p").orderBy("bucket").collect()
    assert [r.n for r in every] == [5, 0, 100, 0] and [r.counted for r in every] == [False, False, True, False]
    weights = m.inverse_frequency_weights(df, "y").agg(F.avg("weight").alias("w")).first().w
    assert weights == pytest.approx(1.0)


def test_wrap(spark):
    got = spark.range(1).select(wrap(F.lit(3 * math.pi)).alias("a"), wrap(F.lit(-0.5)).alias("b")).first()
    assert got.a == pytest.approx(-math.pi) and got.b == pytest.approx(-0.5)


def test_mount_yaw_recovers_the_rotation(spark):
    rng = random.Random(1)
    phi, rows = 0.7, []
    for k in range(200):
        f, s = math.cos(k / 5), math.sin(k / 3)
        rows.append((1, f, s, f * math.cos(phi) - s * math.sin(phi) + rng.gauss(0, 0.02), f * math.sin(phi) + s * math.cos(phi) + rng.gauss(0, 0.02), 1.0))
    r = rp.mount_yaw(spark.createDataFrame(rows, "session long, f double, l double, c1 double, c2 double, w double"), "session", "f", "l", "c1", "c2", "w").first()
    assert abs(r.phi - phi) < math.radians(5) and r.observable


def test_folds_match_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(1, k, float(rng.normal(10, 1)), float(rng.uniform(0.1, 30)) if k % 4 else None, float(rng.normal()) if k % 3 else None) for k in range(40)]
    got = [r.fused for r in rp.speed_fusion(spark.createDataFrame(rows, "o long, k long, mu double, sigma double, a_fwd double"), ["o"]).orderBy("k").collect()]
    v, p, want = 0.0, -1.0, []
    for _, _, mu, sigma, a in rows:
        r = min(max(20.0 if sigma is None else sigma, 0.3), 20.0) ** 2
        if p < 0:
            v, p = mu, r
        else:
            if a is not None:
                v, p = v + a, p + 0.5
            g = p / (p + r)
            v, p = v + g * (mu - v), (1 - g) * p
        want.append(max(v, 0.0))
    assert got == pytest.approx(want, abs=1e-9)


def test_correlation_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=80)
    rows = [(1, k, float(x[k]), float(x[k - 4] if k >= 4 else 0)) for k in range(80)]
    best = st.best_lag(st.lag_correlations(spark.createDataFrame(rows, "s long, k long, x double, y double"), "s", "k", "x", "y", list(range(-6, 7))), "s").first()
    assert best.lag == 4 and best.r > 0.8


def test_least_squares_of_three(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 100)
    df = spark.createDataFrame([(1, *map(float, a), float(b)) for a, b in zip(x, y)], "g long, a double, b double, c double, y double")
    r = st.least_squares(df, ["g"], ["a", "b", "c"], "y").first()
    full, *_ = np.linalg.lstsq(np.c_[x, np.ones(100)], y, rcond=None)
    assert [r.b_a, r.b_b, r.b_c] == pytest.approx(full[:3].tolist()) and r.r2 > 0.99


def test_zero_phase_filter():
    b, a = estimators.butterworth(3, 0.1)
    assert b.sum() / a.sum() == pytest.approx(1.0) and np.all(np.abs(np.roots(a)) < 1)
    t = np.arange(300)
    slow, fast = np.sin(2 * np.pi * t / 150), np.sin(2 * np.pi * t / 5)
    assert np.max(np.abs(estimators.zero_phase(slow + fast) - slow)[30:-30]) < 0.05
    assert np.allclose(estimators.zero_phase(np.ones(50)), 1)


def matrix_filter(rows, heading, mount, n, parts):
    """The heading filter by full matrices: state x, y, heading, bias, mount."""
    state, cov, out = np.array([0, 0, heading, 0, mount], float), np.diag([1, 1, n.heading_start**2, n.bias_start**2, n.mount_start**2 if n.estimate_mount else 0.0]), []

    def update(state, cov, miss, h, variance):
        gain = cov @ h / (h @ cov @ h + variance)
        left = np.eye(5) - np.outer(gain, h)
        return state + gain * miss, left @ cov @ left.T + np.outer(gain, gain) * variance

    for rate, metres, a1, a2, still, change in rows:
        for _ in range(parts):
            c, s, dt, d = np.cos(state[2]), np.sin(state[2]), 1 / parts, metres / parts
            jacobian = np.eye(5)
            jacobian[[0, 1, 2], [2, 2, 3]] = [-d * s, d * c, -dt]
            state = state + [d * c, d * s, (rate - state[3]) * dt, 0, 0]
            cov = jacobian @ cov @ jacobian.T + np.diag([(0.4 * c) ** 2, (0.4 * s) ** 2, (n.gyro * dt) ** 2, n.bias_walk**2 * dt, n.mount_walk**2 * dt * n.estimate_mount])
        c, s = np.cos(state[4]), np.sin(state[4])
        if still > 0.5:
            state, cov = update(state, cov, rate - state[3], np.array([0, 0, 0, 1.0, 0]), n.stationary_gyro**2)
        else:
            if metres >= 0.5:
                h = np.array([0, 0, 0, metres, -(a1 * c + a2 * s) * n.estimate_mount])
                state, cov = update(state, cov, a2 * c - a1 * s - metres * (rate - state[3]), h, (n.lateral * (1 + n.turn_inflation * abs(rate))) ** 2)
            if n.use_forward:
                c, s = np.cos(state[4]), np.sin(state[4])
                state, cov = update(state, cov, a1 * c + a2 * s - change, np.array([0, 0, 0, 0, a2 * c - a1 * s]), n.forward**2)
        out.append(state[:4].tolist())
    return out


@pytest.mark.parametrize("more", [{}, {"estimate_mount": True, "mount_start": 0.3, "use_forward": True}])
def test_heading_filter_matches_full_matrices(spark, more):
    noise = estimators.FilterSettings(**more)
    rng = np.random.default_rng(9)
    rows = [(float(rng.normal(0.02, 0.05)), float(rng.uniform(0, 12)), float(rng.normal()), float(rng.normal()), float(k % 7 == 0), float(rng.normal(0, 0.3))) for k in range(25)]
    df = spark.createDataFrame([(1, k, 0.3, 0.1, *r) for k, r in enumerate(rows)], "session long, k long, heading0 double, mount double, rate double, distance double, a1 double, a2 double, p_stationary double, change double")
    got = [[r.x, r.y, r.heading, r.bias] for r in estimators.fused_headings(df, settings=noise, parts=4).orderBy("k").collect()]
    assert np.allclose(got, matrix_filter(rows, 0.3, 0.1, noise, 4), atol=1e-7)


def test_heading_filter_learns_the_bias(spark):
    df = spark.range(50).select(F.lit(1).alias("session"), F.col("id").alias("k"), *(F.lit(v).alias(n) for n, v in (("heading0", 0.0), ("mount", 0.0), ("rate", 0.03), ("distance", 0.0), ("a1", 0.0), ("a2", 0.0), ("p_stationary", 1.0))))
    assert estimators.fused_headings(df).orderBy("k").collect()[-1].bias == pytest.approx(0.03, abs=1e-3)


def test_ridge_penalises_the_intercept(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 2)), rng.normal(5, 1, 60)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    got = learning.fit_ridge(df, ["a", "b"], "y", 3.0).weights
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(60)]
    assert got == pytest.approx(np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ y))


def test_windows_are_exclusive_at_the_end(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(20)], "s long, k long, x double")
    got = wn.sliding_windows(df, "s", "k", ["x"], 5, 5, 2, ["k"]).orderBy("start").collect()
    assert [(r.start, r.k) for r in got] == [(s, s + 5) for s in np.arange(0, 20 - 5 - 2, 5)] and got[1].X == [5.0, 6.0, 7.0, 8.0, 9.0]


def test_calibrator_rises_and_clamps(spark):
    df = spark.createDataFrame([(float(k), float(k if k < 300 else 300 - (k - 300) / 2)) for k in range(600)], "p double, y double")
    knots = st.calibrator(df, "p", "y", 10)
    y = [r.y for r in knots.orderBy("bin").collect()]
    assert y == sorted(y)
    out = st.calibrated(spark.createDataFrame([(-5.0,), (1e6,)], "p double"), "p", knots).orderBy("p").collect()
    assert [r.calibrated for r in out] == [y[0], y[-1]]


def test_checked_correlation(spark):
    with pytest.raises(Exception, match="correlation"):
        spark.range(1).select(st.checked_correlation(F.lit(1.1))).collect()


def test_best_axis_does_not_depend_on_the_split_of_the_rows(spark):
    """Correlations that round apart by 1e-13: -0.12105984149995 (a1) and -0.12105984150015 (lat) in exact arithmetic."""
    rows = samples(spark, "/root/testdata/sf0.1").filter("session = 757").select("session", "event_id", "a1", "lat", "speed_ms")
    for parts in (1, 2, 3, 5, 8, 13):
        r = rp.best_axis(rows.repartition(parts, "event_id"), "session", ["a1", "lat"], "speed_ms").first()
        assert (r.axis, r.sign) == ("lat", -1.0), parts
