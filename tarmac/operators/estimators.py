"""Estimators with state, as folds, and zero-phase filtering and live alignment as grouped functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients (b, a) for a cutoff as a fraction of the Nyquist rate, by the bilinear transform."""
    warped = 2 * math.tan(math.pi * cutoff / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    digital = (2 + poles) / (2 - poles)
    a = np.real(np.poly(digital))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state that a constant input of 1 keeps."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[1:, :-1] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    state = state.copy()
    for k, v in enumerate(x):
        y = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:-1] * v - a[1:-1] * y
        state[-1] = b[-1] * v - a[-1] * y
        out[k] = y
    return out


def zero_phase(x: np.ndarray, order: int = 3, cutoff: float = 0.1) -> np.ndarray:
    """The filter forwards and back over an odd extension of 3 * (order + 1) points; shorter series stay as they are."""
    b, a = butterworth(order, cutoff)
    pad = 3 * (order + 1)
    if len(x) <= pad:
        return x.astype(float)
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]).astype(float)
    steady = _steady(b, a)
    ahead = _run(b, a, long, steady * long[0])
    back = _run(b, a, ahead[::-1], steady * ahead[-1])[::-1]
    return back[pad:-pad]


def low_pass(df: DataFrame, session: str, order_by: str, value: str, order: int = 3, cutoff: float = 0.1) -> DataFrame:
    """session, order column, smooth; nulls are filled along the row number first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order_by)
        x = group[value].to_numpy(float)
        known = np.isfinite(x)
        if not known.any():
            smooth = np.full(len(x), np.nan)
        else:
            at = np.arange(len(x))
            smooth = zero_phase(np.interp(at, at[known], x[known]), order, cutoff)
        return pd.DataFrame({session: group[session], order_by: group[order_by], "smooth": smooth})

    kinds = dict(df.dtypes)
    return df.select(session, order_by, value).groupBy(session).applyInPandas(run, f"`{session}` {kinds[session]}, `{order_by}` {kinds[order_by]}, smooth double")


@dataclass
class FilterSettings:
    """Noise of the heading filter; lengths in metres, angles in radians, rates a second."""

    lateral: float = 0.1
    stationary_gyro: float = 0.01
    gyro: float = 0.01
    bias_walk: float = 1e-5
    mount_walk: float = 1e-6
    turn_inflation: float = 8.0
    bias_start: float = 0.05
    heading_start: float = 0.05
    mount_start: float = math.pi
    forward: float = 0.3
    estimate_mount: bool = False
    use_lateral: bool = True
    use_stationary: bool = True
    use_forward: bool = False
    stationary_probability: float = 0.5


#: The angles that the filter estimates. Position is never measured: of its uncertainty only what it shares with the
#: angles can move it, so two rows of that are carried, and its own variance is not.
ANGLES = ("heading", "bias", "mount")
MEANS = ("x", "y", *ANGLES)
SHARED = [(p, a) for p in ("x", "y") for a in ANGLES] + [(a, b) for k, a in enumerate(ANGLES) for b in ANGLES[k:]]


def _shared(p: str, a: str) -> str:
    return f"{p}_{a}" if (p, a) in SHARED else f"{a}_{p}"


class _State:
    """A state of the fold by name; ``with_`` replaces some of it."""

    def __init__(self, values: dict[str, Column]) -> None:
        self.values = values

    @classmethod
    def of(cls, s: Column) -> _State:
        return cls({n: s[n] for n in (*MEANS, *(f"{p}_{a}" for p, a in SHARED))})

    def __getitem__(self, key) -> Column:
        return self.values[key] if isinstance(key, str) else self.values[_shared(*key)]

    def with_(self, new: dict[str, Column]) -> _State:
        return _State(self.values | new)

    def struct(self, **more: Column) -> Column:
        return F.struct(*(c.alias(n) for n, c in (self.values | more).items()))


def _moved(s: _State, rate: Column, metres: Column, dt: float, noise: FilterSettings) -> _State:
    """A step along the heading, which turns by the rate without its bias. The heading's row of the shared uncertainty shears position, the bias' shears heading."""
    ahead = {"x": F.cos(s["heading"]) * metres, "y": F.sin(s["heading"]) * metres}
    slope = {"x": -ahead["y"], "y": ahead["x"]}  # of the step by the heading
    new = {p: s[p] + ahead[p] for p in ahead} | {"heading": s["heading"] + (rate - s["bias"]) * dt}
    for p in ahead:
        to = {a: s[p, a] + slope[p] * s["heading", a] for a in ANGLES}
        new |= {_shared(p, a): to[a] - dt * to["bias"] if a == "heading" else to[a] for a in ANGLES}
    new["heading_heading"] = s["heading", "heading"] - 2 * dt * s["heading", "bias"] + dt * dt * s["bias", "bias"] + (noise.gyro * dt) ** 2
    new["heading_bias"] = s["heading", "bias"] - dt * s["bias", "bias"]
    new["heading_mount"] = s["heading", "mount"] - dt * s["bias", "mount"]
    new["bias_bias"] = s["bias", "bias"] + noise.bias_walk**2 * dt
    if noise.estimate_mount:
        new["mount_mount"] = s["mount", "mount"] + noise.mount_walk**2 * dt
    return s.with_(new)


def _measured(s: _State, miss: Column, of_bias: Column, of_mount: Column, variance: Column) -> _State:
    """The state after one scalar measurement that is off by ``miss`` and depends on bias and mount alone.

    With u the measurement's covariance with each quantity and S its own, means
    move by u * miss / S and covariances lose u * u / S.
    """
    u = {n: s[n, "bias"] * of_bias + s[n, "mount"] * of_mount for n in MEANS}
    total = u["bias"] * of_bias + u["mount"] * of_mount + variance
    new = {n: s[n] + u[n] * miss / total for n in MEANS} | {_shared(p, a): s[p, a] - u[p] * u[a] / total for p, a in SHARED}
    useful = total > 0
    return s.with_({n: F.when(useful, c).otherwise(s[n]) for n, c in new.items()})


def _corrected(s: _State, r: Column, noise: FilterSettings) -> _State:
    """A second's one measurement: at rest the gyro reads its bias; else, from 0.5 m/s on, the sideways force is the centripetal one."""
    at_rest = r["p_stationary"] > noise.stationary_probability
    cos, sin = F.cos(s["mount"]), F.sin(s["mount"])
    sideways, along = r["a2"] * cos - r["a1"] * sin, r["a1"] * cos + r["a2"] * sin
    turning = noise.lateral * (1 + noise.turn_inflation * F.abs(r["rate"]))
    free = r["rate"] - s["bias"]
    miss = F.when(at_rest, free).otherwise(sideways - r["distance"] * free)
    of_bias = F.when(at_rest, 1.0).otherwise(r["distance"])
    of_mount = F.when(at_rest | F.lit(not noise.estimate_mount), 0.0).otherwise(-along)
    variance = F.when(at_rest, noise.stationary_gyro**2).otherwise(turning * turning)
    used = F.when(at_rest, F.lit(noise.use_stationary)).otherwise(F.lit(noise.use_lateral) & (r["distance"] >= 0.5))
    after = _measured(s, miss, of_bias, of_mount, variance)
    out = s.with_({n: F.when(used, after[n]).otherwise(s[n]) for n in s.values})
    return out


def _pushed(s: _State, r: Column, noise: FilterSettings) -> _State:
    """The force along the way is the change of speed: this sees the mount alone."""
    cos, sin = F.cos(s["mount"]), F.sin(s["mount"])
    after = _measured(s, r["a1"] * cos + r["a2"] * sin - r["change"], F.lit(0.0), r["a2"] * cos - r["a1"] * sin, F.lit(noise.forward**2))
    return s.with_({n: F.when(r["p_stationary"] > noise.stationary_probability, s[n]).otherwise(after[n]) for n in s.values})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def fused_headings(seconds: DataFrame, key: str = "session", parts: int = 10, settings: FilterSettings | None = None) -> DataFrame:
    """key, k, x, y, heading, bias: heading filtered by gyro, standstill and lateral force over each outage's seconds.

    ``seconds`` has k, heading0, mount, rate, distance, a1, a2, p_stationary, and
    change (of speed) where the forward force is used. Each second is moved in
    ``parts`` steps and then measured once. A fold over an outage's rows in the
    engine; an outage is short, so its rows fit an array.
    """
    noise = settings or FilterSettings()
    names = ["rate", "distance", "a1", "a2", "p_stationary", *(["change"] if noise.use_forward else [])]
    row = F.struct(F.col("k").cast("long").alias("k"), *(F.col(n).cast("double").alias(n) for n in names))
    outages = seconds.groupBy(key).agg(F.min_by("heading0", "k").cast("double").alias("heading0"), F.min_by("mount", "k").cast("double").alias("mount"), F.array_sort(F.collect_list(row)).alias("rows"))
    start = {"heading_heading": noise.heading_start**2, "bias_bias": noise.bias_start**2, "mount_mount": noise.mount_start**2 if noise.estimate_mount else 0.0}
    zero = {n: F.lit(0.0) for n in MEANS} | {f"{p}_{a}": F.lit(float(start.get(f"{p}_{a}", 0.0))) for p, a in SHARED}
    zero |= {"heading": F.col("heading0"), "mount": F.col("mount")}
    none = F.expr("cast(array() as array<struct<k: bigint, x: double, y: double, heading: double, bias: double>>)")

    def second(s: Column, r: Column) -> Column:
        move = lambda t, _: _moved(_State.of(t), r["rate"], r["distance"] / parts, 1 / parts, noise).struct()
        moved = F.aggregate(F.sequence(F.lit(1), F.lit(parts)), _State.of(s).struct(), move)
        done = _let(moved, lambda t: _corrected(_State.of(t), r, noise).struct())
        if noise.use_forward:
            done = _let(done, lambda t: _pushed(_State.of(t), r, noise).struct())
        shown = lambda t: F.array(F.struct(r["k"].alias("k"), *(t[n].alias(n) for n in ("x", "y", "heading", "bias"))))
        return _let(done, lambda t: _State.of(t).struct(out=F.concat(s["out"], shown(t))))

    folded = F.aggregate("rows", _State(zero).struct(out=none), second, lambda s: s["out"])
    return outages.select(key, F.explode(folded).alias("r")).select(key, "r.*")


def orthonormal(m: np.ndarray) -> np.ndarray:
    """The rotation next to a matrix."""
    u, _, v = np.linalg.svd(m)
    return u @ np.diag([1.0, 1.0, np.linalg.det(u @ v)]) @ v


def live_alignment(imu: DataFrame, session: str, order_by: str, dt: float) -> DataFrame:
    """session, order, vehicle-frame acceleration (ax, ay, az) by propagating the attitude with the gyro, made a rotation again at every step.

    ``imu`` has roll0, pitch0, yaw0 and ax, ay, az, gx, gy, gz.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order_by)
        r0, p0, y0 = (float(group[c].iloc[0]) for c in ("roll0", "pitch0", "yaw0"))
        cr, sr, cp, sp, cy, sy = math.cos(r0), math.sin(r0), math.cos(p0), math.sin(p0), math.cos(y0), math.sin(y0)
        turn = np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])
        out = []
        for a, g in zip(group[["ax", "ay", "az"]].to_numpy(float), group[["gx", "gy", "gz"]].to_numpy(float), strict=True):
            x, y, z = g * dt
            turn = orthonormal(turn @ (np.eye(3) + np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])))
            out.append(turn @ a)
        moved = np.array(out).reshape(-1, 3)
        return pd.DataFrame({session: group[session].to_numpy(), order_by: group[order_by].to_numpy(), "ax": moved[:, 0], "ay": moved[:, 1], "az": moved[:, 2]})

    kinds = dict(imu.dtypes)
    return imu.groupBy(session).applyInPandas(run, f"`{session}` {kinds[session]}, `{order_by}` {kinds[order_by]}, ax double, ay double, az double")


def static_tilt(df: DataFrame, session: str, ax: str, ay: str, az: str) -> DataFrame:
    """session, roll, pitch from the mean of a recording at rest."""
    m = df.groupBy(session).agg(F.avg(ax).alias("x"), F.avg(ay).alias("y"), F.avg(az).alias("z"))
    return m.select(session, F.atan2("y", "z").alias("roll"), F.atan2(-F.col("x"), F.sqrt(F.col("y") ** 2 + F.col("z") ** 2)).alias("pitch"))
