"""Reports over the corpus: trajectory invariants, scenario verdicts, label quality, run comparison, per-file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geo, units
from tarmac.operators import statistics as st
from tarmac.operators import timeseries as ts
from tarmac.operators.sliced import with_previous


def trajectory_checks(df: DataFrame, expected: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str, speed: str, box: tuple, margin: float = 3.0, floor_ms: float = 15.0, close: float = 300.0, tolerance: float = 150.0) -> DataFrame:
    """session and four invariants, null where one doesn't apply: ends in the box, path as expected (5 %), no jumps, closed loop.

    ``expected`` has session, path_km. A jump is a step between moved fixes further
    than max(margin * speed, floor) allows for its time.
    """
    ends = df.groupBy(session).agg(*(f(c, F.struct(*order)).alias(n) for f, c, n in ((F.min_by, lat, "a"), (F.min_by, lon, "b"), (F.max_by, lat, "c"), (F.max_by, lon, "d"))))
    moved = with_previous(ts.fixes(df, session, t, order, lat, lon), session, t, order, {"lat": F.col(lat), "lon": F.col(lon), "t": F.col(t)})
    step = geo.equirectangular(F.col("prev_lat"), F.col("prev_lon"), F.col(lat), F.col(lon))
    allowed = F.greatest(F.coalesce(F.col(speed), F.lit(0.0)) * margin, F.lit(floor_ms)) * (F.col(t) - F.col("prev_t"))
    rows = moved.withColumns({"step": step, "allowed": allowed})
    per = rows.groupBy(session).agg((F.coalesce(F.sum("step"), F.lit(0.0)) / 1000).alias("path_km"), F.count_if((F.col("allowed") > 0) & (F.col("step") > F.col("allowed"))).alias("n_jumps"), F.max("step").alias("max_jump_m"))
    out = ends.join(per, session, "left").join(expected.select(session, F.col("path_km").alias("expected_km")), session, "left")
    inside = geo.box_contains(box, F.col("a"), F.col("b")) & geo.box_contains(box, F.col("c"), F.col("d"))
    off = F.try_divide(F.abs(F.col("path_km") - F.col("expected_km")), F.nullif("expected_km", F.lit(0.0)))
    gap = geo.equirectangular(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    out = out.withColumns({"bbox_pass": inside, "distance_rel_err": off, "end_to_start_m": gap})
    return out.select(session, "path_km", "distance_rel_err", "n_jumps", "max_jump_m", "end_to_start_m", F.coalesce("bbox_pass", F.lit(False)).alias("bbox_pass"), (F.col("distance_rel_err") <= 0.05).alias("distance_pass"), (F.col("n_jumps") == 0).alias("jump_pass"), F.when(F.col("end_to_start_m") <= close, F.col("end_to_start_m") <= tolerance).alias("loop_pass"))


def scenario_table(scores: DataFrame, published: DataFrame, scenario: str, value: str, within: float = 0.3, needed: int = 4) -> tuple[DataFrame, DataFrame]:
    """Per scenario max, mean, min, deviation (ddof 0), ratio to the published maximum and ranks; and the verdict.

    It passes if at least ``needed`` scenarios are within the share and both orders agree.
    """
    own = scores.groupBy(scenario).agg(F.count(value).alias("n"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.stddev_pop(value).alias("std"))
    rows = own.join(F.broadcast(published.select(scenario, "published")), scenario)
    everything = Window.partitionBy()  # over a row a scenario
    rows = rows.withColumns({"ratio": F.try_divide(F.col("max"), F.col("published")), "rank": F.rank().over(everything.orderBy("max")), "published_rank": F.rank().over(everything.orderBy("published"))})
    close = F.count_if(F.abs(F.col("ratio") - 1) <= within)
    ordered = F.bool_and(F.col("rank") == F.col("published_rank"))
    return rows, rows.agg(close.alias("within"), ordered.alias("order_kept")).withColumn("passed", (F.col("within") >= needed) & F.col("order_kept"))


def start_fix_gate(df: DataFrame, outages: DataFrame, accuracy: str, worst: float = 20.0, width: float = 86_400.0) -> DataFrame:
    """``outages`` (session, t0, duration) with the interpolated accuracy at the start and whether it is good enough."""
    from tarmac.operators.replay import at_start

    at = at_start(df, outages, accuracy, "start_accuracy", width)
    return at.withColumn("usable", F.coalesce(F.col("start_accuracy") <= worst, F.lit(False)))


def trip_mean_ratio(df: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str, speed: str) -> DataFrame:
    """session, ratio: mean reported speed over path length by duration."""
    path = ts.path_length_km(df, session, t, order, lat, lon)
    means = df.groupBy(session).agg(F.avg(speed).alias("__v"), (F.max(t) - F.min(t)).alias("__s"))
    derived = F.try_divide(F.col("path_km") * 1000, F.col("__s"))
    return path.join(means, session).select(session, F.try_divide(F.col("__v"), F.nullif(derived, F.lit(0.0))).alias("ratio"))


def unit_checks(df: DataFrame, lat: str, lon: str, acceleration: Column, rate: str, speed_ratio: Column, time_header: str, step: Column) -> DataFrame:
    """check, verdict: the six unit checks of a recording."""
    p = F.percentile
    a = df.agg(
        F.min(lat).alias("la"), F.max(lat).alias("lb"), F.min(lon).alias("oa"), F.max(lon).alias("ob"), p(acceleration, 0.5).alias("m"), p(F.abs(F.col(rate)), 0.99).alias("g"), p(speed_ratio, 0.5).alias("s"), p(step, 0.5).alias("d")
    )
    verdicts = {
        "latitude": units.check_latitude(F.col("la"), F.col("lb")), "longitude": units.check_longitude(F.col("oa"), F.col("ob")), "acceleration": units.check_acceleration(F.col("m")),
        "gyroscope": units.check_gyroscope(F.col("g")), "speed": units.check_speed(F.col("s")), "time": units.check_time(time_header, F.col("d")),
    }
    return a.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("verdict")) for k, v in verdicts.items()))).alias("x")).select("x.*")


def ambiguous(candidates: DataFrame, key: str, edge: str, distance: str, times: float = 1.5, plus: float = 15.0) -> DataFrame:
    """key, edge of the nearest candidate, and whether another edge is about as near: within max(times * d0, d0 + plus)."""
    first = candidates.groupBy(key).agg(F.min(F.struct(F.col(distance).alias("d"), F.col(edge).alias("e"))).alias("__f"))
    rows = candidates.join(first, key)
    near = F.col(distance) <= F.greatest(F.col("__f.d") * times, F.col("__f.d") + plus)
    return rows.groupBy(key, F.col("__f.e").alias("edge"), F.col("__f.d").alias("distance")).agg(F.bool_or((F.col(edge) != F.col("__f.e")) & near).alias("ambiguous"))


def label_quality(labels: DataFrame, roles: DataFrame, session: str, order: str, value: str) -> DataFrame:
    """role, band, sessions, worst: sessions by the band of their label stability; sessions without one are noted as such."""
    stability = ts.label_stability(labels, session, order, value)
    rows = st.banded(stability, "stability_pct", st.cut_points(stability, "stability_pct"))
    both = roles.join(rows, session, "left").withColumn("band", F.coalesce("band", F.lit("none")))
    return both.groupBy("role", "band").agg(F.count("*").alias("sessions"), F.max("stability_pct").alias("worst"))


def run_comparison(scores: DataFrame, run: str, duration: str, drift: str, values: list[int]) -> DataFrame:
    """run and, by duration, mean drift and its standard error (ddof 1), with the rank at the longest."""
    se = lambda d: F.stddev_samp(F.when(F.col(duration) == d, F.col(drift))) / F.sqrt(F.count(F.when(F.col(duration) == d, F.col(drift))))
    out = scores.groupBy(run).agg(*(F.avg(F.when(F.col(duration) == d, F.col(drift))).alias(f"mean_{d}") for d in values), *(se(d).alias(f"se_{d}") for d in values))
    return out.withColumn("rank", F.rank().over(Window.partitionBy().orderBy(f"mean_{values[-1]}")))  # over a row a run


def per_file(df: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str, speed: str, a1: str, a2: str, rate: str) -> DataFrame:
    """One row a recording: rows, duration, rate, path, bounds, median acceleration, p99 rotation and speed ratio."""
    own = df.groupBy(session).agg(
        F.count("*").alias("n_rows"), (F.max(t) - F.min(t)).alias("duration_s"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"),
        F.percentile(F.hypot(a1, a2), 0.5).alias("accel_mag_median"), F.percentile(F.abs(F.col(rate)), 0.99).alias("gyro_abs_p99"),
    )
    out = own.join(ts.delta_quantiles(df, session, t, order).select(session, F.col("median").alias("dt_median_s"), F.col("hz").alias("effective_hz")), session, "left")
    out = out.join(ts.path_length_km(df, session, t, order, lat, lon).withColumnRenamed("path_km", "distance_km"), session, "left")
    return out.join(ts.speed_ratio(df, session, t, order, lat, lon, speed, slowest=0.1).select(session, F.col("ratio").alias("speed_ratio")), session, "left").withColumn("rows_per_s", F.try_divide(F.col("n_rows") - 1, F.col("duration_s")))


def inference_windows(grid: DataFrame, outages: DataFrame, session: str, k: str, t: str, step: float, width: int) -> DataFrame:
    """session, t0, second, start, valid: of each second of an outage, the first grid row of the window that ends there."""
    spans = grid.groupBy(session).agg(F.min(t).alias("__lo"), F.count("*").alias("__n"))
    seconds = outages.withColumn("second", F.explode(F.sequence(F.lit(1).cast("long"), F.round(F.col("duration") / F.col("step")).cast("long"))))
    rows = seconds.join(spans, session)
    end = F.ceil((F.col("t0") + F.col("second") * F.col("step") - F.col("__lo")) / step - 1e-9)
    rows = rows.withColumn("start", end - width)
    return rows.select(session, "t0", "second", "start", ((F.col("start") >= 0) & (F.col("start") + width <= F.col("__n"))).alias("valid"))


def probe_steps(features: DataFrame, prediction: Column, session: str, t0: str, second: str, heading0: str, turn: str | None = None) -> DataFrame:
    """A window predictor as a replay predictor: session, t0, k, distance, heading; invalid windows move by 0.

    The heading is the one at the start, plus the running turn if there is one.
    """
    run = Window.partitionBy(session, t0).orderBy(second).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col(heading0) if turn is None else F.col(heading0) + F.sum(F.coalesce(F.col(turn), F.lit(0.0))).over(run)
    return features.select(session, t0, F.col(second).alias("k"), F.coalesce(F.greatest(F.lit(0.0), prediction), F.lit(0.0)).alias("distance"), heading.alias("heading"))
