"""Queries over the time-series operators, on the telemetry views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import geo
from tarmac.operators import timeseries as ts
from tarmac.plans.registry import query
from tarmac.views import GRID_STEP, SAMPLES_SQL, samples

ORDER = ["t", "row_idx"]
S = f"WITH RECURSIVE {SAMPLES_SQL}"
#: Slices of ten days: an event stream has a few rows an hour.
WIDTH = 864_000.0

GRID_SQL = f"""spans AS (SELECT session, min(t) AS lo, max(t) AS hi FROM samples GROUP BY session),
grid AS (SELECT session, unnest(range(0, floor((hi - lo) / {GRID_STEP})::BIGINT + 1)) AS k, lo FROM spans),
gridt AS (SELECT session, k, lo + k * {GRID_STEP}.0::DOUBLE AS t FROM grid)"""


def lerp_sql(value: str, name: str, clamp: bool = True, points: str = "samples") -> str:
    """CTE ``name`` (session, k, t, v): ``value`` of ``points`` on the grid."""
    outside = "coalesce(v0, v1)" if clamp else "NULL"
    return f"""{name}_p AS (SELECT session, t, avg({value}) AS v FROM {points} WHERE {value} IS NOT NULL GROUP BY session, t),
{name}_u AS (
    SELECT session, t, NULL::BIGINT AS k, v, 0 AS g FROM {name}_p UNION ALL SELECT session, t, k, NULL, 1 FROM gridt
), {name}_w AS (
    SELECT session, t, k, g,
        last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0,
        last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER a AS t1, last_value(v IGNORE NULLS) OVER a AS v1
    FROM {name}_u WINDOW b AS (PARTITION BY session ORDER BY t, g, k ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY session ORDER BY t DESC, g, k ROWS UNBOUNDED PRECEDING)
), {name} AS (
    SELECT session, k, t, t0, t1, CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END ELSE {outside} END AS v
    FROM {name}_w WHERE g = 1
)"""


@query(f"""{S}, c AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, row_number() OVER w AS r FROM samples WINDOW w AS (PARTITION BY session ORDER BY t, row_idx))
    SELECT session, row_idx, lat, lon FROM c WHERE r = 1 OR lat <> plat OR lon <> plon""")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.fixes(samples(spark, sf_dir), "session", "t", ORDER, "lat", "lon").select("session", "row_idx", "lat", "lon")


@query(f"""{S}, c AS (SELECT *, (event_id % 3)::DOUBLE AS s FROM samples), d AS (SELECT *, row_number() OVER w = 1 OR s <> lag(s) OVER w AS moved FROM c WINDOW w AS (PARTITION BY session ORDER BY t, row_idx)),
    n AS (SELECT *, sum(moved::INT) OVER (PARTITION BY session) AS n FROM d)
    SELECT session, row_idx, s FROM n WHERE moved OR n < 20""")
def speed_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("s", F.pmod("event_id", F.lit(3)).cast("double"))
    return ts.speed_change_points(rows, "session", "t", ORDER, "s").select("session", "row_idx", "s")


@query(f"""{S}, d AS (SELECT session, (t - lag(t) OVER (PARTITION BY session ORDER BY t, row_idx)) * 1000 AS ms FROM samples),
    m AS (SELECT session, round_even(ms, 0) AS r, count(*) AS c FROM d WHERE ms IS NOT NULL GROUP BY ALL),
    mm AS (SELECT session, r AS mode_ms FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY c DESC, r) AS k FROM m) WHERE k = 1),
    a AS (SELECT session, count(CASE WHEN ms >= 20 THEN 1 END) AS ticks, quantile_cont(CASE WHEN ms >= 20 THEN ms END, 0.5) AS med, avg((ms < 20)::INT) AS short FROM d WHERE ms IS NOT NULL GROUP BY session)
    SELECT session, ticks, round(CASE WHEN ticks >= 20 THEN 1000 / med END, 9) AS hz, mode_ms, short > 0.2 AND ticks >= 20 AS bimodal FROM a JOIN mm USING (session)""")
def tick_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.tick_rate(samples(spark, sf_dir), "session", "t", ORDER).withColumn("hz", F.round("hz", 9))


@query(f"""{S}, d AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t, row_idx) AS d FROM samples)
    SELECT session, count(*) AS n, round(quantile_cont(d, 0.05), 4) AS p05, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.95), 4) AS p95, round(1 / quantile_cont(d, 0.5), 9) AS hz
    FROM d WHERE d > 0 GROUP BY session""")
def delta_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.delta_quantiles(samples(spark, sf_dir), "session", "t", ORDER)
    return out.withColumns({c: F.round(c, 4) for c in ("p05", "median", "p95")} | {"hz": F.round("hz", 9)})


@query(f"{S}, {GRID_SQL}, {lerp_sql('speed_ms', 'i')} SELECT session, k, round(v, 6) AS speed_ms FROM i")
def interp_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    out = ts.interpolate(rows, ts.uniform_grid(rows, "session", "t", GRID_STEP), "session", "t", "speed_ms", width=WIDTH)
    return out.select("session", "k", F.round("speed_ms", 6).alias("speed_ms"))


@query(f"""{S}, {GRID_SQL}, enough AS (SELECT session FROM samples GROUP BY session HAVING count(*) >= 10),
    sub AS (SELECT * FROM samples SEMI JOIN enough USING (session)), {lerp_sql('a1', 'i', clamp=False, points='sub')} SELECT session, k, round(v, 6) AS a1 FROM i""")
def sensor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    grid = ts.uniform_grid(rows, "session", "t", GRID_STEP)
    return ts.sensor_grid(rows, grid, "session", "t", "a1").select("session", "k", F.round("a1", 6).alias("a1"))


@query(f"""{S}, {GRID_SQL}, {lerp_sql('speed_ms', 'i')}, n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd FROM i WINDOW w AS (PARTITION BY session ORDER BY k))
    SELECT session, k, round(CASE WHEN hs IS NULL THEN (b - v) / hd WHEN hd IS NULL THEN (v - a) / hs ELSE (hs * hs * b + (hd * hd - hs * hs) * v - hd * hd * a) / (hs * hd * (hd + hs)) END, 9) AS derivative FROM n""")
def grid_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    grid = ts.interpolate(rows, ts.uniform_grid(rows, "session", "t", GRID_STEP), "session", "t", "speed_ms", width=WIDTH)
    return ts.derivative(grid, "session", "t", "k", "speed_ms").select("session", "k", F.round("derivative", 9).alias("derivative"))


EQ = "6371000.0::DOUBLE * sqrt(power(radians(lat - plat), 2) + power(radians(lon - plon) * cos(radians(lat)), 2))"
MOVED_SQL = """p AS (SELECT *, lag(lat) OVER w AS qlat, lag(lon) OVER w AS qlon, row_number() OVER w AS r FROM samples WINDOW w AS (PARTITION BY session ORDER BY t, row_idx)),
    m AS (SELECT session, t, row_idx, lat, lon, speed_ms FROM p WHERE r = 1 OR lat <> qlat OR lon <> qlon),
    f AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(t) OVER w AS pt FROM m WINDOW w AS (PARTITION BY session ORDER BY t, row_idx))"""


@query(f"""{S}, {MOVED_SQL}, s AS (SELECT *, coalesce({EQ}, 0) AS step FROM f)
    SELECT session, row_idx, round(step, 4) AS step_m, round(sum(step) OVER (PARTITION BY session ORDER BY t, row_idx ROWS UNBOUNDED PRECEDING), 4) AS cum_m FROM s""")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.cumulative_distance(samples(spark, sf_dir), "session", "t", ORDER, "lat", "lon", geo.equirectangular)
    return out.select("session", "row_idx", F.round("step_m", 4).alias("step_m"), F.round("cum_m", 4).alias("cum_m"))


@query(f"""{S}, {GRID_SQL}, {MOVED_SQL}, s AS (SELECT *, coalesce({EQ}, 0) AS step FROM f), cum AS (SELECT session, t, sum(step) OVER (PARTITION BY session ORDER BY t, row_idx ROWS UNBOUNDED PRECEDING) AS cum_m FROM s),
    {lerp_sql('cum_m', 'i', points='cum')}, l AS (SELECT session, k, lead(v, 10) OVER (PARTITION BY session ORDER BY k) - v AS d FROM i)
    SELECT session, k, round(CASE WHEN d >= 0 AND d / 36000.0 <= 0.6 THEN d END, 4) AS d, d >= 0 AND d / 36000.0 <= 0.6 AS plausible FROM l WHERE d IS NOT NULL""")
def displacement_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    cum = ts.cumulative_distance(rows, "session", "t", ORDER, "lat", "lon", geo.equirectangular)
    out = ts.displacement_labels(cum, ts.uniform_grid(rows, "session", "t", GRID_STEP), "session", "t", 10, 36000.0, 0.6)
    return out.withColumn("d", F.round("d", 4))


@query(f"""{S}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY session ORDER BY t, row_idx) AS dt FROM samples)
    SELECT session, row_idx, round(sum(coalesce(sqrt(a1 * a1 + a2 * a2) * dt, 0)) OVER (PARTITION BY session ORDER BY t, row_idx ROWS UNBOUNDED PRECEDING), 3) AS motion FROM d""")
def cumulative_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.motion_sum(samples(spark, sf_dir), "session", "t", ORDER, "a1", "a2")
    return out.select("session", "row_idx", F.round("motion", 3).alias("motion"))


@query(f"""{S}, c AS (SELECT session, row_idx, sum(speed_ms) OVER (PARTITION BY session ORDER BY t, row_idx ROWS UNBOUNDED PRECEDING) AS v FROM samples),
    e AS (SELECT *, first_value(v) OVER w AS a, last_value(v) OVER w AS b FROM c WINDOW w AS (PARTITION BY session ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT session, row_idx, round(CASE WHEN abs(b - a) > 1e-12 THEN (v - a) / (b - a) ELSE v - a END, 6) AS norm FROM e""")
def normalised_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.operators.sliced import running_sum

    curve = running_sum(samples(spark, sf_dir), "session", "t", ORDER, F.col("speed_ms"), "v", WIDTH)
    return ts.normalised(curve, "session", "row_idx", "v").select("session", "row_idx", F.round("norm", 6).alias("norm"))


WRAP = "(({0} + pi()) - 2 * pi() * floor(({0} + pi()) / (2 * pi())) - pi())"


@query(f"""{S}, d AS (SELECT *, radians(heading_deg) - radians(lag(heading_deg) OVER (PARTITION BY session ORDER BY t, row_idx)) AS d FROM samples)
    SELECT session, row_idx, round(abs(CASE WHEN speed_ms >= 5 THEN coalesce({WRAP.format('d')}, 0) * 10 END), 6) AS yaw_rate FROM d""")
def yaw_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.yaw_rate(samples(spark, sf_dir), "session", "t", ORDER, "heading_deg", "speed_ms")
    return out.select("session", "row_idx", F.round(F.abs("yaw_rate"), 6).alias("yaw_rate"))


@query(f"""{S}, h AS (SELECT *, radians(heading_deg * 0.99::DOUBLE) AS a FROM samples), d AS (SELECT *, a - lag(a) OVER (PARTITION BY session ORDER BY t, row_idx) AS d FROM h)
    SELECT session, row_idx, round(sum(CASE WHEN d IS NULL THEN a ELSE {WRAP.format('d')} END) OVER (PARTITION BY session ORDER BY t, row_idx ROWS UNBOUNDED PRECEDING), 5) + 0.0::DOUBLE AS unwrapped FROM d""")
def unwrap_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.unwrapped(samples(spark, sf_dir), "session", "t", ORDER, F.radians(F.col("heading_deg") * 0.99))
    return out.select("session", "row_idx", (F.round("unwrapped", 5) + 0.0).alias("unwrapped"))


@query(f"""{S}, p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM samples WINDOW w AS (PARTITION BY session ORDER BY t, row_idx))
    SELECT session, round(coalesce(sum({EQ}), 0) / 1000, 6) AS path_km FROM p GROUP BY session""")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.path_length_km(samples(spark, sf_dir), "session", "t", ORDER, "lat", "lon").withColumn("path_km", F.round("path_km", 6))


@query(f"""{S}, {MOVED_SQL}, r AS (SELECT session, speed_ms, t - pt AS dt, {EQ} / (t - pt) AS derived FROM f WHERE t > pt)
    SELECT session, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN quantile_cont(speed_ms / derived, 0.5) END, 4) AS ratio FROM r WHERE derived > 0.1 AND speed_ms > 0 GROUP BY session""")
def speed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.speed_ratio(samples(spark, sf_dir), "session", "t", ORDER, "lat", "lon", "speed_ms", slowest=0.1).withColumn("ratio", F.round("ratio", 4))


@query(f"""{S}, s AS (SELECT session, row_idx, speed_ms, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session) - 1 AS last FROM samples WINDOW w AS (PARTITION BY session ORDER BY row_idx)),
    x AS (SELECT s.session, s.row_idx, s.speed_ms AS v, n.speed_ms AS u FROM s, (SELECT unnest(range(-3, 4)) AS o) JOIN s AS n ON n.session = s.session AND n.i = greatest(0, least(s.last, s.i + o))),
    m AS (SELECT session, row_idx, v, quantile_cont(u, 0.5) AS med, list(u) AS us FROM x GROUP BY ALL),
    d AS (SELECT *, list_sort(list_transform(us, lambda q: abs(q - med)))[4] AS mad FROM m)
    SELECT session, row_idx, mad > 1e-9 AND abs(v - med) > 3 * mad AS is_spike, CASE WHEN mad > 1e-9 AND abs(v - med) > 3 * mad THEN med ELSE v END AS clean FROM d""")
def despike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.despike(samples(spark, sf_dir), "session", "row_idx", "speed_ms", 3).select("session", "row_idx", "is_spike", "clean")


@query(f"""{S}, d AS (SELECT *, abs(speed_ms - lag(speed_ms) OVER (PARTITION BY session ORDER BY row_idx)) AS dv FROM samples),
    e AS (SELECT session, row_idx, sum(dv) OVER w AS e, count(dv) OVER w AS n FROM d WINDOW w AS (PARTITION BY session ORDER BY row_idx ROWS 9 PRECEDING))
    SELECT session, row_idx AS end_row, round(e, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY e DESC, row_idx) AS k FROM e WHERE n >= 5) WHERE k = 1""")
def busiest_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.busiest_stretch(samples(spark, sf_dir), "session", "row_idx", "speed_ms", 10, 5).withColumn("energy", F.round("energy", 6))


@query(f"""{S}, p AS (SELECT *, lag(t) OVER w AS pt, lag(speed_ms) OVER w AS py FROM (SELECT session, floor(t / 3600) AS t, avg(speed_ms) AS speed_ms FROM samples GROUP BY ALL) WINDOW w AS (PARTITION BY session ORDER BY t))
    SELECT session, t, round(speed_ms, 9) AS speed_ms, round(CASE WHEN abs(t - pt - 1) < 1e-6 THEN py END, 9) AS y_pred FROM p""")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = samples(spark, sf_dir).groupBy("session", F.floor(F.col("t") / 3600).cast("double").alias("t")).agg(F.avg("speed_ms").alias("speed_ms"))
    return ts.persistence(hourly, "session", "t", ["t"], "speed_ms").select("session", "t", F.round("speed_ms", 9).alias("speed_ms"), F.round("y_pred", 9).alias("y_pred"))


@query(f"""{S}, d AS (SELECT session, speed_ms AS y, abs(lead(speed_ms, 5) OVER (PARTITION BY session ORDER BY row_idx) - speed_ms) AS d FROM samples)
    SELECT session, count(*) AS n, round(avg(y), 9) AS mean, round(100 * avg(d) / avg(y), 6) AS stability_pct FROM d GROUP BY session HAVING count(*) >= 50""")
def label_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.label_stability(samples(spark, sf_dir), "session", "row_idx", "speed_ms")
    return out.withColumns({"mean": F.round("mean", 9), "stability_pct": F.round("stability_pct", 6)})


@query(f"""{S}, o AS (SELECT unnest([1, 2, 5, 10]) AS off), d AS (SELECT a.session, off, abs(b.speed_ms - a.speed_ms) AS d FROM samples a, o JOIN samples b ON b.session = a.session AND b.row_idx = a.row_idx + off),
    m AS (SELECT session, avg(speed_ms) AS m FROM samples GROUP BY session)
    SELECT session, "off" AS "offset", round(100 * avg(d) / any_value(m), 6) AS change_pct FROM m JOIN d USING (session) GROUP BY session, off""")
def offset_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ts.offset_sensitivity(samples(spark, sf_dir), "session", "row_idx", "speed_ms", [1, 2, 5, 10])
    return out.filter("change_pct is not null").withColumn("change_pct", F.round("change_pct", 6))


@query(f"{S} SELECT session, row_idx, round(t - (session % 7) * 100 / 1000.0::DOUBLE, 6) AS t FROM samples")
def time_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    lags = rows.select("session").distinct().withColumn("lag_ms", F.pmod("session", F.lit(7)) * 100.0)
    return ts.apply_offset(rows, lags, "session", "t").select("session", "row_idx", F.round("t", 6).alias("t"))


@query(f"{S}, {GRID_SQL}, {lerp_sql('speed_ms', 'i')} SELECT session, k, round(CASE WHEN least(t - t0, t1 - t) <= 7200 THEN v END, 6) AS speed_ms FROM i")
def gap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    out = ts.gap_mask(rows, ts.uniform_grid(rows, "session", "t", GRID_STEP), "session", "t", "speed_ms", 7200.0)
    return out.select("session", "k", F.round("speed_ms", 6).alias("speed_ms"))


@query(f"""{S}, a AS (SELECT session, row_idx, speed_ms AS ref FROM samples WHERE event_type <> 'error'), b AS (SELECT session, row_idx, abs(a1) + 1 AS fl, abs(a2) + 1 AS fr FROM samples WHERE event_type <> 'signup'),
    z AS (SELECT session, row_idx, ref, (fl + fr) / 2 AS rate FROM a JOIN b USING (session, row_idx)), r AS (SELECT session, quantile_cont(ref / rate, 0.5) AS radius FROM z WHERE ref > 2 GROUP BY session)
    SELECT session, row_idx, round(rate * radius, 6) AS wheel_speed FROM z LEFT JOIN r USING (session)""")
def rowzip_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    a = rows.filter("event_type <> 'error'").select("session", "row_idx", F.col("speed_ms").alias("ref"))
    b = rows.filter("event_type <> 'signup'").select("session", "row_idx", (F.abs("a1") + 1).alias("fl"), (F.abs("a2") + 1).alias("fr"))
    out = ts.wheel_speed(ts.rows_zipped(a, b, "session", "row_idx"), "session", "ref", ["fl", "fr"])
    return out.select("session", "row_idx", F.round("wheel_speed", 6).alias("wheel_speed"))


@query(f"""{S}, h AS (SELECT session, floor(t / 3600) AS h, count(*) AS c FROM samples GROUP BY ALL) SELECT session, sum(c)::BIGINT AS n, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 9) AS share FROM h GROUP BY session""")
def dup_timestamp_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = samples(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600))
    return ts.duplicate_times(hours, "session", "h").withColumn("share", F.round("share", 9))


@query(f"""{S}, d AS (SELECT session, floor(t / 60) - lag(floor(t / 60)) OVER (PARTITION BY session ORDER BY row_idx) AS d FROM samples)
    SELECT session, coalesce(bool_and(d >= 0), true) AS monotone, count(CASE WHEN d = 0 THEN 1 END) AS duplicates FROM d GROUP BY session""")
def time_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = samples(spark, sf_dir).withColumn("m", F.floor(F.col("t") / 60))
    return ts.time_regularity(minutes, "session", "m", "row_idx")
