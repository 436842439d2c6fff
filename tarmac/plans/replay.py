"""Queries over windows, outage replay, predictors and estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import replay as rp
from tarmac.operators import statistics as st
from tarmac.operators import windowing as wn
from tarmac.plans.metrics import rounded
from tarmac.plans.registry import query
from tarmac.plans.timeseries import WIDTH
from tarmac.views import SAMPLES_SQL, samples, table

S = f"WITH {SAMPLES_SQL}"
#: Outages on the event stream: a day long, scored every hour.
DAY, HOUR = 86_400.0, 3_600.0


@query(f"""{S}, n AS (SELECT *, row_idx - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM samples), s AS (SELECT session, i - 8 AS start, speed_ms AS y FROM n WHERE i >= 8 AND (i - 8) % 4 = 0 AND i - 8 < n - 8 - 2)
    SELECT s.session, start, round(any_value(y), 9) AS y, count(*) AS size, round(sum(a1 + a2), 6) + 0.0::DOUBLE AS total FROM s JOIN n ON n.session = s.session AND n.i >= start AND n.i < start + 8 GROUP BY s.session, start""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wn.sliding_windows(samples(spark, sf_dir), "session", "row_idx", ["a1", "a2"], 8, 4, 2, ["speed_ms"])
    total = F.aggregate("X", F.lit(0.0), lambda s, x: s + x)
    rows = wn.complete(out, "speed_ms").filter("keep")
    return rounded(rounded(rows.select("session", "start", F.col("speed_ms").alias("y"), (F.size("X") / 2).cast("long").alias("size"), total.alias("total")), 6, "total"), 9, "y")


@query(f"""{S}, v AS (SELECT session, row_idx, var_pop(speed_ms) OVER w AS variance, count(speed_ms) OVER w AS c, lag(speed_ms, 6) OVER o AS a, lead(speed_ms, 6) OVER o AS b, speed_ms AS x FROM samples
        WINDOW o AS (PARTITION BY session ORDER BY row_idx), w AS (PARTITION BY session ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
    SELECT session, row_idx, round(variance, 6) AS variance, round(x - a, 6) AS previous, round(b - x, 6) AS following FROM v WHERE c = 6""")
def validation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wn.validation_windows(samples(spark, sf_dir), "session", "row_idx", "speed_ms", 6), 6, "variance", "previous", "following")


SPANS = "spans AS (SELECT session, min(t) AS lo, max(t) AS hi FROM samples GROUP BY session)"
OUTAGES = f"{SPANS}, outages AS (SELECT session, unnest(range(0, floor((hi - lo - 86400) / 86400)::BIGINT + 1)) AS j, lo FROM spans WHERE hi - lo >= 86400), o AS (SELECT session, lo + j * 86400.0::DOUBLE AS t0 FROM outages)"


def outages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, spans and outages."""
    rows = samples(spark, sf_dir)
    spans = rows.groupBy("session").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    found = wn.outage_starts(spans, "session", "lo", "hi", DAY)
    return rows, spans, found.select("session", "t0", F.lit(DAY).alias("duration"), F.lit(HOUR).alias("step"))


@query(f"{S}, {OUTAGES} SELECT session, round(t0, 6) AS t0 FROM o")
def outage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outages(spark, sf_dir)[2].select("session", "t0"), 6, "t0")


@query(f"""{S}, b AS (SELECT session, (row_idx - 1) // 10 AS block, sum(a1) AS a1, max(speed_ms) AS top FROM samples GROUP BY ALL HAVING count(*) = 10) SELECT session, block, round(a1, 6) + 0.0::DOUBLE AS a1, top FROM b""")
def block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("k", F.col("row_idx") - 1)
    return rounded(wn.blocks(rows, "session", "k", 10, {"a1": F.sum("a1"), "top": F.max("speed_ms")}), 6, "a1")


@query(f"""{S} SELECT session, row_idx, round(CASE WHEN count(gyr) OVER w = 10 THEN avg(gyr) OVER w END, 9) + 0.0::DOUBLE AS trailing FROM samples WINDOW w AS (PARTITION BY session ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wn.trailing_mean(samples(spark, sf_dir), "session", "row_idx", "gyr", 10).select("session", "row_idx", "trailing"), 9, "trailing")


@query(f"""{S} SELECT session, row_idx, round(-(sum(gyr / 10) OVER (PARTITION BY session ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), 9) + 0.0::DOUBLE AS turn FROM samples""")
def accumulated_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(wn.turn_between(samples(spark, sf_dir), "session", "row_idx", "gyr", 10.0, 4, 2, -1.0).select("session", "row_idx", "turn"), 9, "turn")


@query(f"""{S}, n AS (SELECT session, speed_ms, row_idx - 1 AS i, count(*) OVER (PARTITION BY session) // 3 AS s FROM samples)
    SELECT session, (i // s)::BIGINT AS third, count(*) AS n, round(avg(speed_ms), 9) AS mean FROM n WHERE i < 3 * s GROUP BY ALL""")
def session_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wn.thirds(samples(spark, sf_dir), "session", "row_idx").filter("third is not null")
    return rounded(rows.groupBy("session", "third").agg(F.count("*").alias("n"), F.avg("speed_ms").alias("mean")), 9, "mean")


@query(f"""{S}, n AS (SELECT session, row_idx, row_idx - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM samples), p AS (SELECT DISTINCT session, round_even(j * (n - 1) / 9.0::DOUBLE, 0)::BIGINT AS i FROM n, (SELECT unnest(range(0, 10)) AS j))
    SELECT n.session, row_idx FROM n SEMI JOIN p ON p.session = n.session AND p.i = n.i WHERE n > 10 UNION ALL SELECT session, row_idx FROM n WHERE n <= 10""")
def outage_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.evenly_spaced(samples(spark, sf_dir), "session", "row_idx", 10).select("session", "row_idx")


def at_sql(name: str, value: str, points: str, columns: str) -> str:
    """CTE ``name``: ``value`` interpolated (clamped) at the rows of ``points`` (session, t, columns)."""
    nulls = ", ".join(f"NULL AS {c.strip()}" for c in columns.split(","))
    return f"""{name}_p AS (SELECT session, t, avg({value}) AS v FROM samples WHERE {value} IS NOT NULL GROUP BY session, t),
{name}_u AS (SELECT session, t, {columns}, NULL::DOUBLE AS v, 1 AS g FROM {points} UNION ALL SELECT session, t, {nulls}, v, 0 FROM {name}_p),
{name}_w AS (SELECT *, last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER b AS ta, last_value(v IGNORE NULLS) OVER b AS va, last_value(CASE WHEN g = 0 THEN t END IGNORE NULLS) OVER a AS tb, last_value(v IGNORE NULLS) OVER a AS vb
    FROM {name}_u WINDOW b AS (PARTITION BY session ORDER BY t, g ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY session ORDER BY t DESC, g ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT session, t, {columns}, CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN CASE WHEN ta = tb THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END ELSE coalesce(va, vb) END AS v FROM {name}_w WHERE g = 1)"""


REPLAY = f"""{OUTAGES}, marks AS (SELECT session, t0, k, t0 + k * 3600.0::DOUBLE AS t FROM o, (SELECT unnest(range(0, 25)) AS k)), starts AS (SELECT session, t0 AS t, t0 FROM o),
    {at_sql('la', 'lat', 'marks', 't0, k')}, {at_sql('lo', 'lon', 'marks', 't0, k')}, {at_sql('v0', 'speed_ms', 'starts', 't0')}, {at_sql('h0', 'heading_deg', 'starts', 't0')},
    pos AS (SELECT la.session, la.t0, la.k, la.v AS lat, lo.v AS lon FROM la JOIN lo ON la.session = lo.session AND la.t0 = lo.t0 AND la.k = lo.k),
    rel AS (SELECT p.session, p.t0, p.k, (p.lat - s.lat) * 111320 AS n, (p.lon - s.lon) * 111320 * cos(radians(s.lat)) AS e FROM pos p JOIN pos s ON s.session = p.session AND s.t0 = p.t0 AND s.k = 0),
    tru AS (SELECT *, sqrt(power(n - lag(n) OVER w, 2) + power(e - lag(e) OVER w, 2)) AS ts FROM rel WINDOW w AS (PARTITION BY session, t0 ORDER BY k)),
    err AS (SELECT tru.session, tru.t0, tru.k, ts, v0.v * 3600 - ts AS se, sqrt(power(tru.k * v0.v * 3600 * cos(radians(h0.v)) - n, 2) + power(tru.k * v0.v * 3600 * sin(radians(h0.v)) - e, 2)) AS pe
        FROM tru JOIN v0 ON v0.session = tru.session AND v0.t0 = tru.t0 JOIN h0 ON h0.session = tru.session AND h0.t0 = tru.t0 WHERE tru.k > 0)"""


@query(f"""{S}, {REPLAY} SELECT session, round(t0, 3) AS t0, 86400.0::DOUBLE AS duration, round(sum(se), 2) + 0.0::DOUBLE AS cae, round(avg(abs(se)), 2) AS aeps, round(sum(abs(se)), 2) AS crse_scalar, count(se) AS n_seconds, round(max_by(pe, k), 2) AS crse,
    round(max_by(pe, k), 2) AS final_position_error_m, round(max(pe), 2) AS max_position_error_m, round(sum(ts), 2) AS true_distance_m FROM err GROUP BY session, t0""")
def constant_velocity_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = outages(spark, sf_dir)
    steps = rp.scored(rp.held_velocity(rp.observed(rows, found, WIDTH)), rp.local_flat)
    out = rounded(rp.totals(steps), 2, "cae", "aeps", "crse_scalar", "crse", "final_position_error_m", "max_position_error_m", "true_distance_m")
    return rounded(out, 3, "t0")


@query(f"""{S}, {REPLAY}, {at_sql('hk', 'heading_deg', 'marks', 't0, k')}, st AS (SELECT hk.session, hk.t0, hk.k, v0.v * 3600 * cos(radians(hk.v)) AS dn, v0.v * 3600 * sin(radians(hk.v)) AS de FROM hk JOIN v0 ON v0.session = hk.session AND v0.t0 = hk.t0 WHERE hk.k > 0),
    tr AS (SELECT session, t0, k, sum(dn) OVER w AS pn, sum(de) OVER w AS pe FROM st WINDOW w AS (PARTITION BY session, t0 ORDER BY k))
    SELECT tr.session, round(tr.t0, 3) AS t0, round(max_by(sqrt(power(pn - n, 2) + power(pe - e, 2)), tr.k), 1) AS crse FROM tr JOIN tru ON tru.session = tr.session AND tru.t0 = tr.t0 AND tru.k = tr.k GROUP BY tr.session, tr.t0""")
def oracle_heading_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = outages(spark, sf_dir)
    steps = rp.scored(rp.held_velocity(rp.observed(rows, found, WIDTH), true_heading=True), rp.local_flat)
    return rounded(rounded(rp.totals(steps).select("session", "t0", "crse"), 1, "crse"), 3, "t0")


@query(f"""{S}, {REPLAY}, sc AS (SELECT session, t0, pi() / 180 * 6378137 * (1 - q) / power(1 - q * power(sin(radians(lat)), 2), 1.5) AS north, pi() / 180 * 6378137 * cos(radians(lat)) / sqrt(1 - q * power(sin(radians(lat)), 2)) AS east FROM (SELECT *, 0.0066943799901413165::DOUBLE AS q FROM pos) WHERE k = 0),
    rl AS (SELECT p.session, p.t0, p.k, (p.lat - s.lat) * north AS n, (p.lon - s.lon) * east AS e FROM pos p JOIN pos s ON s.session = p.session AND s.t0 = p.t0 AND s.k = 0 JOIN sc ON sc.session = p.session AND sc.t0 = p.t0)
    SELECT rl.session, round(rl.t0, 3) AS t0, round(max_by(sqrt(power(rl.k * v0.v * 3600 * cos(radians(h0.v)) - n, 2) + power(rl.k * v0.v * 3600 * sin(radians(h0.v)) - e, 2)), rl.k), 0) + 0.0::DOUBLE AS crse FROM rl JOIN v0 ON v0.session = rl.session AND v0.t0 = rl.t0 JOIN h0 ON h0.session = rl.session AND h0.t0 = rl.t0 WHERE rl.k > 0 GROUP BY rl.session, rl.t0""")
def ellipsoid_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictor and truth as relations, joined, in metres of the ellipsoid."""
    rows, _, found = outages(spark, sf_dir)
    steps = rp.score(rp.constant_velocity(rows, found, WIDTH), rp.truth(rows, found, WIDTH))
    return rounded(rounded(rp.totals(steps).select("session", "t0", "crse"), 0, "crse"), 3, "t0")


@query(f"""{S}, {OUTAGES}, starts AS (SELECT session, t0 AS t, t0 FROM o), {at_sql('v0', 'speed_ms', 'starts', 't0')}
    SELECT CASE WHEN v < 5 THEN 'slow' ELSE 'eligible' END AS reason, count(*) AS n, round(avg(v), 6) AS start_speed FROM v0 GROUP BY ALL""")
def outage_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans, found = outages(spark, sf_dir)
    speed = rp.at_start(rows, found, "speed_ms", "start_speed", WIDTH)
    out = rp.eligibility(found, spans, speed).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"), F.avg("start_speed").alias("start_speed"))
    return rounded(out, 6, "start_speed")


@query("""WITH RECURSIVE s AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value / 10 AS mu, greatest(0.3, least(20, ((event_id % 7) + 1) / 2.0::DOUBLE)) AS sigma, CASE WHEN event_id % 5 > 0 THEN ((event_id % 21) - 10) / 100.0::DOUBLE END AS a FROM events),
    f AS (SELECT session, k, mu AS v, sigma * sigma AS p FROM s WHERE k = 0 UNION ALL
        SELECT s.session, s.k, v + coalesce(a, 0) + (p + CASE WHEN a IS NULL THEN 0 ELSE 0.5 END) / (p + CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + sigma * sigma) * (mu - v - coalesce(a, 0)),
            (1 - (p + CASE WHEN a IS NULL THEN 0 ELSE 0.5 END) / (p + CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + sigma * sigma)) * (p + CASE WHEN a IS NULL THEN 0 ELSE 0.5 END)
        FROM f JOIN s ON s.session = f.session AND s.k = f.k + 1)
    SELECT session, k, round(greatest(0, v), 6) AS fused FROM f""")
def kalman_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("session", (F.col("row_idx") - 1).alias("k"), F.col("speed_ms").alias("mu"), ((F.pmod("event_id", F.lit(7)) + 1) / 2.0).alias("sigma"), F.when(F.pmod("event_id", F.lit(5)) > 0, F.col("gyr")).alias("a_fwd"))
    return rounded(rp.speed_fusion(rows, ["session"]), 6, "fused")


@query(f"""WITH RECURSIVE {SAMPLES_SQL}, s AS (SELECT session, row_idx AS k, a1 AS a, gyr AS w, 1.0::DOUBLE AS dt, first_value(speed_ms) OVER (PARTITION BY session ORDER BY row_idx) AS v0 FROM samples),
    f AS (SELECT session, k, greatest(0, v0 + a * dt) AS v, w * dt AS h, (v0 + greatest(0, v0 + a * dt)) / 2 * dt AS d, a, w FROM s WHERE k = 1 UNION ALL
        SELECT s.session, s.k, greatest(0, f.v + (f.a + s.a) / 2 * s.dt), f.h + (f.w + s.w) / 2 * s.dt, f.d + (f.v + greatest(0, f.v + (f.a + s.a) / 2 * s.dt)) / 2 * s.dt, s.a, s.w FROM f JOIN s ON s.session = f.session AND s.k = f.k + 1)
    SELECT session, k, round(v, 6) AS speed, round(d, 4) AS distance, round(h, 6) + 0.0::DOUBLE AS heading FROM f""")
def ins_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    first = rows.groupBy("session").agg(F.min_by("speed_ms", "row_idx").alias("v0"))
    rows = rows.join(first, "session").withColumns({"h0": F.lit(0.0), "dt": F.lit(1.0)})
    out = rp.ins_seconds(rows, ["session"], "row_idx", "v0", "h0", "a1", "gyr")
    return rounded(rounded(out, 6, "speed", "heading"), 4, "distance")


@query(f"""{S}, c AS (SELECT session, corr(a1, speed_ms) AS a1, corr(gyr, speed_ms) AS gyr, corr(lat, speed_ms) AS lat FROM samples GROUP BY session),
    u AS (SELECT session, unnest([a1, gyr, lat]) AS r, unnest(['a1', 'gyr', 'lat']) AS axis, unnest([0, 1, 2]) AS i FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(abs(r), 9) DESC, i) AS k FROM u)
    SELECT session, axis, sign(r)::DOUBLE AS sign, round(r, 6) AS r FROM k WHERE k = 1""")
def best_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.best_axis(samples(spark, sf_dir), "session", ["a1", "gyr", "lat"], "speed_ms"), 6, "r")


@query(f"""{S} SELECT session, round(CASE WHEN count(CASE WHEN speed_ms < 4 THEN a1 END) >= 20 THEN avg(CASE WHEN speed_ms < 4 THEN a1 END) ELSE 0 END, 9) + 0.0::DOUBLE AS bias, count(CASE WHEN speed_ms < 4 THEN a1 END) AS n FROM samples GROUP BY session""")
def rest_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.rest_bias(samples(spark, sf_dir), "session", "a1", "speed_ms", 4.0, 20), 9, "bias")


@query(f"""{S}, b AS (SELECT session, (row_idx - 1) // 3 AS k, avg(a1) AS c1, avg(a2) AS c2, avg(gyr) * 10 AS f, avg(lat - 51.505::DOUBLE) * 100 AS l, avg(speed_ms) AS w FROM samples GROUP BY ALL HAVING count(*) = 3)
    SELECT session, round(atan2(sum(w * (c2 * f - c1 * l)), sum(w * (c1 * f + c2 * l))), 6) AS phi, count(CASE WHEN abs(f) >= 0.3 THEN 1 END) AS n_forward, count(CASE WHEN abs(l) >= 0.1 THEN 1 END) AS n_turn,
        count(CASE WHEN abs(f) >= 0.3 THEN 1 END) >= 8 AND count(CASE WHEN abs(l) >= 0.1 THEN 1 END) >= 8 AS observable,
        round(CASE WHEN count(CASE WHEN abs(f) >= 0.3 THEN 1 END) >= 8 AND count(CASE WHEN abs(l) >= 0.1 THEN 1 END) >= 8 THEN atan2(sum(w * (c2 * f - c1 * l)), sum(w * (c1 * f + c2 * l))) ELSE 0 END, 6) AS phi_safe FROM b GROUP BY session""")
def mount_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("k", F.col("row_idx") - 1)
    mean = {"c1": F.avg("a1"), "c2": F.avg("a2"), "f": F.avg("gyr") * 10, "l": F.avg(F.col("lat") - 51.505) * 100, "w": F.avg("speed_ms")}
    out = rp.mount_yaw(wn.blocks(rows, "session", "k", 3, mean), "session", "f", "l", "c1", "c2", "w", 0.3, 0.1, 8)
    return rounded(out, 6, "phi", "phi_safe")


@query(f"""{S}, c AS (SELECT session, 0.5 * atan2(2 * covar_pop(a1, a2), var_pop(a1) - var_pop(a2)) AS yaw, avg(a1) AS mx, avg(a2) AS my FROM samples GROUP BY session)
    SELECT session, round(CASE WHEN cos(yaw) * mx + sin(yaw) * my < 0 THEN atan2(-sin(yaw), -cos(yaw)) ELSE yaw END, 6) AS yaw FROM c""")
def pca_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rp.principal_yaw(samples(spark, sf_dir), "session", "a1", "a2"), 6, "yaw")


@query(f"""{S}, m AS (SELECT session, quantile_cont(gyr, 0.5) AS x, quantile_cont(a1, 0.5) AS y, quantile_cont(speed_ms, 0.5) AS z FROM samples GROUP BY session),
    u AS (SELECT session, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM m)
    SELECT samples.session, row_idx, round(a1 * x + a2 * y + gyr * z, 6) + 0.0::DOUBLE AS up, round(sqrt(greatest(0, a1 * a1 + a2 * a2 + gyr * gyr - power(a1 * x + a2 * y + gyr * z, 2))), 5) AS horizontal FROM samples JOIN u USING (session)""")
def levelled_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rp.levelled(samples(spark, sf_dir), "session", ["a1", "a2", "gyr"], ["gyr", "a1", "speed_ms"])
    return rounded(rounded(out.select("session", "row_idx", "up", F.hypot("h1", "h2").alias("horizontal")), 6, "up"), 5, "horizontal")


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), c AS (SELECT vec_id, i % 4 AS c, i // 4 AS s, x, x - lag(x) OVER (PARTITION BY vec_id, i % 4 ORDER BY i) AS d FROM x),
    f AS (SELECT vec_id, c, avg(x) AS a, stddev_pop(x) AS b, avg(abs(x)) AS m, avg(abs(d)) AS d FROM c GROUP BY ALL)
    SELECT vec_id, c::INT AS channel, round(a, 6) + 0.0::DOUBLE AS mean, round(b, 5) AS deviation, round(m, 6) AS absmean, round(d, 6) AS absstep FROM f""")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wn.window_features(table(spark, sf_dir, "embeddings"), "embedding", 4)
    rows = out.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("features", c * 4 + 1, F.lit(4)))).alias("channel", "f"))
    rows = rows.select("vec_id", "channel", *(F.col("f")[i].alias(n) for i, n in enumerate(("mean", "deviation", "absmean", "absstep"))))
    return rounded(rounded(rows, 6, "mean", "absmean", "absstep"), 5, "deviation")
