"""Queries over the corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import units
from tarmac.operators import reports as rep
from tarmac.operators import roadgraph as rg
from tarmac.operators import timeseries as ts
from tarmac.plans.graph import CROSS_SQL, POINTS_SQL, crossroads, points
from tarmac.plans.metrics import SCORES, rounded, scores
from tarmac.plans.registry import query
from tarmac.plans.replay import OUTAGES, at_sql, outages
from tarmac.plans.timeseries import EQ, MOVED_SQL, ORDER, WIDTH
from tarmac.views import SAMPLES_SQL, samples, table

S = f"WITH {SAMPLES_SQL}"


@query(f"""{S}, {MOVED_SQL}, s AS (SELECT session, {EQ} AS step, greatest(speed_ms * 3, 0.002) * (t - pt) AS allowed FROM f), pp AS (SELECT session, coalesce(sum(step), 0) / 1000 AS path_km, count(CASE WHEN allowed > 0 AND step > allowed THEN 1 END) AS n_jumps, max(step) AS max_jump_m FROM s GROUP BY session),
    e AS (SELECT session, min_by(lat, row_idx) AS plat, min_by(lon, row_idx) AS plon, max_by(lat, row_idx) AS lat, max_by(lon, row_idx) AS lon FROM samples GROUP BY session), x AS (SELECT session, count(*) * 0.55::DOUBLE AS km FROM samples GROUP BY session),
    g AS (SELECT *, {EQ} AS gap FROM e)
    SELECT session, round(path_km, 5) AS path_km, round(abs(path_km - km) / km, 6) AS distance_rel_err, n_jumps, round(max_jump_m, 3) AS max_jump_m, round(gap, 3) AS end_to_start_m, plat BETWEEN 51.5 AND 51.509 AND lat BETWEEN 51.5 AND 51.509 AS bbox_pass,
        coalesce((abs(path_km - km) / km <= 0.05)::VARCHAR, 'n/a') AS distance_pass, coalesce((n_jumps = 0)::VARCHAR, 'n/a') AS jump_pass, coalesce(CASE WHEN gap <= 300 THEN gap <= 150 END::VARCHAR, 'n/a') AS loop_pass FROM pp JOIN x USING (session) JOIN g USING (session)""")
def trajectory_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    expected = rows.groupBy("session").agg((F.count("*") * 0.55).alias("path_km"))
    out = rep.trajectory_checks(rows, expected, "session", "t", ORDER, "lat", "lon", "speed_ms", (F.lit(51.5), F.lit(-9.0), F.lit(51.509), F.lit(9.0)), floor_ms=0.002)
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in ("distance_pass", "jump_pass", "loop_pass")}
    return rounded(rounded(rounded(out.withColumns(shown), 5, "path_km"), 6, "distance_rel_err"), 3, "max_jump_m", "end_to_start_m")


PUBLISHED = [("AIR", 1000.0), ("FOB", 1010.0), ("MAIL", 1100.0), ("RAIL", 700.0), ("SHIP", 1030.0)]


def scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "lineitem").select(F.element_at(F.array(*(F.lit(n) for n, _ in PUBLISHED)), (F.pmod("l_partkey", F.lit(5)) + 1).cast("int")).alias("scenario"), (F.col("l_extendedprice") / 100).alias("crse"))
    return rep.scenario_table(own, spark.createDataFrame(PUBLISHED, "scenario string, published double"), "scenario", "crse")


SCENARIOS = "s AS (SELECT ['AIR', 'FOB', 'MAIL', 'RAIL', 'SHIP'][l_partkey % 5 + 1] AS scenario, l_extendedprice / 100 AS v FROM lineitem), p(scenario, published) AS (VALUES " + ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in PUBLISHED) + "), t AS (SELECT scenario, count(v) AS n, max(v) AS max, avg(v) AS mean, min(v) AS min, stddev_pop(v) AS std, any_value(published) AS published, max(v) / any_value(published) AS ratio FROM s JOIN p USING (scenario) GROUP BY scenario), r AS (SELECT *, rank() OVER (ORDER BY max) AS rank, rank() OVER (ORDER BY published) AS published_rank FROM t)"


@query(f"WITH {SCENARIOS} SELECT scenario, n, round(max, 4) AS max, round(mean, 4) AS mean, round(min, 4) AS min, round(std, 4) AS std, published, round(ratio, 6) AS ratio, rank::INT AS rank, published_rank::INT AS published_rank FROM r")
def scenario_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(scenarios(spark, sf_dir)[0], 4, "max", "mean", "min", "std"), 6, "ratio")


@query(f"WITH {SCENARIOS} SELECT count(CASE WHEN abs(ratio - 1) <= 0.3 THEN 1 END) AS within, bool_and(rank = published_rank) AS order_kept, count(CASE WHEN abs(ratio - 1) <= 0.3 THEN 1 END) >= 4 AND bool_and(rank = published_rank) AS passed FROM r")
def scenario_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios(spark, sf_dir)[1]


@query(f"""{S}, {OUTAGES}, starts AS (SELECT session, t0 AS t, t0 FROM o), {at_sql('g', 'acc', 'starts', 't0')} SELECT session, round(t0, 3) AS t0, round(v, 6) AS start_accuracy, v <= 20 AS usable FROM g""")
def start_fix_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = outages(spark, sf_dir)
    return rounded(rounded(rep.start_fix_gate(rows, found, "acc", 20.0, WIDTH).select("session", "t0", "start_accuracy", "usable"), 6, "start_accuracy"), 3, "t0")


@query(f"""{S}, p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM samples WINDOW w AS (PARTITION BY session ORDER BY t, row_idx)), q AS (SELECT session, sum({EQ}) AS m, avg(speed_ms) AS v, max(t) - min(t) AS s FROM p GROUP BY session) SELECT session, round(v / (m / s), 4) AS ratio FROM q""")
def trip_mean_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rep.trip_mean_ratio(samples(spark, sf_dir), "session", "t", ORDER, "lat", "lon", "speed_ms"), 4, "ratio")


@query("""SELECT unnest(['latitude', 'longitude', 'acceleration', 'gyroscope', 'speed', 'time']) AS "check", unnest(['degrees', 'degrees', 'g with gravity', 'rad/s', 'km/h', 'ms']) AS verdict""")
def unit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    return rep.unit_checks(rows, "lat", "lon", F.hypot("a1", "a2") * 0 + 1.0, "gyr", F.col("speed_ms") * 0 + 3.6, "TIME SINCE START (ms)", F.col("t"))


@query(f"""WITH {POINTS_SQL}, {CROSS_SQL}, v AS (SELECT id, edge, (lon1 - lon) * 111320 * cos(radians(lat)) AS x1, (lat1 - lat) * 110540 AS y1, (lon2 - lon1) * 111320 * cos(radians(lat)) AS dx, (lat2 - lat1) * 110540 AS dy FROM pt, sg),
    f AS (SELECT *, greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) AS f FROM v), h AS (SELECT id, edge, min(sqrt(power(x1 + f * dx, 2) + power(y1 + f * dy, 2))) AS d FROM f GROUP BY ALL HAVING d <= 60),
    m AS (SELECT id, min(d) AS d0 FROM h GROUP BY id) SELECT id, round(d0, 4) AS distance, count(CASE WHEN d <= greatest(1.5 * d0, d0 + 15) THEN 1 END) > 1 AS ambiguous FROM h JOIN m USING (id) GROUP BY id, d0""")
def match_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = rg.nearest_edges(points(spark, sf_dir), crossroads(spark).segments, 60.0, 32, cell=0.001)
    return rounded(rep.ambiguous(near, "id", "edge", "distance").select("id", "distance", "ambiguous"), 4, "distance")


@query(f"""{S}, d AS (SELECT session, speed_ms AS y, abs(lead(speed_ms, 5) OVER (PARTITION BY session ORDER BY row_idx) - speed_ms) AS d FROM samples), q AS (SELECT session, 100 * avg(d) / avg(y) AS s FROM d GROUP BY session HAVING count(*) >= 50),
    c AS (SELECT quantile_cont(s, 0.6) AS a, quantile_cont(s, 0.9) AS b FROM q), r AS (SELECT DISTINCT session, CASE WHEN session % 3 = 0 THEN 'train' ELSE 'test' END AS role FROM samples),
    b AS (SELECT role, s, CASE WHEN s IS NULL THEN 'none' WHEN s < a THEN 'low' WHEN s < b THEN 'middle' ELSE 'high' END AS band FROM r LEFT JOIN q USING (session), c) SELECT role, band, count(*) AS sessions, round(max(s), 6) AS worst FROM b GROUP BY ALL""")
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    roles = rows.select("session").distinct().withColumn("role", F.when(F.pmod("session", F.lit(3)) == 0, "train").otherwise("test"))
    return rounded(rep.label_quality(rows, roles, "session", "row_idx", "speed_ms"), 6, "worst")


@query(f"""WITH {SCORES}, a AS (SELECT predictor, avg(CASE WHEN duration = 10 THEN drift END) AS m1, avg(CASE WHEN duration = 60 THEN drift END) AS m6, stddev_samp(CASE WHEN duration = 10 THEN drift END) / sqrt(count(CASE WHEN duration = 10 THEN 1 END)) AS s1,
    stddev_samp(CASE WHEN duration = 60 THEN drift END) / sqrt(count(CASE WHEN duration = 60 THEN 1 END)) AS s6 FROM scores GROUP BY predictor)
    SELECT predictor, round(m1, 4) AS mean_10, round(m6, 4) AS mean_60, round(s1, 4) AS se_10, round(s6, 4) AS se_60, rank() OVER (ORDER BY m6)::INT AS rank FROM a""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rep.run_comparison(scores(spark, sf_dir), "predictor", "duration", "drift", [10, 60]), 4, "mean_10", "mean_60", "se_10", "se_60")


@query(f"""{S}, {MOVED_SQL}, r AS (SELECT session, speed_ms, t - pt AS dt, {EQ} / (t - pt) AS derived FROM f WHERE t > pt), sr AS (SELECT session, CASE WHEN count(*) >= 30 THEN quantile_cont(speed_ms / derived, 0.5) END AS ratio FROM r WHERE derived > 0.1 AND speed_ms > 0 GROUP BY session),
    l AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, t - lag(t) OVER w AS d FROM samples WINDOW w AS (PARTITION BY session ORDER BY t, row_idx)),
    a AS (SELECT session, count(*) AS n_rows, max(t) - min(t) AS s, min(lat) AS lat_min, max(lat) AS lat_max, quantile_cont(sqrt(a1 * a1 + a2 * a2), 0.5) AS am, quantile_cont(abs(gyr), 0.99) AS g, sum({EQ}) / 1000 AS km, quantile_cont(CASE WHEN d > 0 THEN d END, 0.5) AS dt FROM l GROUP BY session)
    SELECT a.session, n_rows, round(s, 3) AS duration_s, round(lat_min, 6) AS lat_min, round(lat_max, 6) AS lat_max, round(am, 6) AS accel_mag_median, round(g, 6) AS gyro_abs_p99, round(dt, 3) AS dt_median_s, round(km, 5) AS distance_km, round(ratio, 4) AS speed_ratio, round((n_rows - 1) / s, 9) AS rows_per_s FROM a LEFT JOIN sr USING (session)""")
def per_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rep.per_file(samples(spark, sf_dir), "session", "t", ORDER, "lat", "lon", "speed_ms", "a1", "a2", "gyr").drop("lon_min", "lon_max", "effective_hz")
    out = rounded(rounded(out, 3, "duration_s", "dt_median_s"), 6, "lat_min", "lat_max", "accel_mag_median", "gyro_abs_p99")
    return rounded(rounded(rounded(out, 5, "distance_km"), 4, "speed_ratio"), 9, "rows_per_s")


@query(f"""{S}, {OUTAGES}, n AS (SELECT session, min(t) AS lo, floor((max(t) - min(t)) / 3600)::BIGINT + 1 AS n FROM samples GROUP BY session), s AS (SELECT o.session, t0, second, ceil((t0 + second * 3600 - n.lo) / 3600 - 1e-9)::BIGINT - 30 AS start, n FROM o JOIN n USING (session), (SELECT unnest(range(1, 25)) AS second))
    SELECT session, round(t0, 3) AS t0, second, start, start >= 0 AND start + 30 <= n AS valid FROM s""")
def inference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = outages(spark, sf_dir)
    out = rep.inference_windows(ts.uniform_grid(rows, "session", "t", 3600), found, "session", "k", "t", 3600.0, 30)
    return rounded(out, 3, "t0")


@query("""SELECT 'l_quantity' AS "column", count(l_quantity) AS n, min(l_quantity)::DOUBLE AS min, round(quantile_cont(l_quantity, 0.5), 6) AS median, max(l_quantity)::DOUBLE AS max FROM lineitem
    UNION ALL SELECT 'l_tax', count(l_tax), min(l_tax), round(quantile_cont(l_tax, 0.5), 6), max(l_tax) FROM lineitem""")
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(units.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]), 6, "median")
