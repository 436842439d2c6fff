"""Queries over predictors, matching at a point, and comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import mapmatch as mm
from tarmac.operators import predictors as pd_
from tarmac.operators import windowing as wn
from tarmac.plans.graph import CROSS_SQL, crossroads, points
from tarmac.plans.metrics import rounded
from tarmac.plans.registry import query
from tarmac.plans.replay import DAY, OUTAGES, S, outages
from tarmac.plans.timeseries import WIDTH
from tarmac.views import PAIRS_SQL, SAMPLES_SQL, pairs, samples, table


@query(f"""{S}, {OUTAGES}, x AS (SELECT session, row_idx, t, CASE WHEN event_id % 3 > 0 THEN heading_deg END AS h FROM samples), f AS (SELECT session, min_by(h, row_idx) FILTER (h IS NOT NULL) AS f FROM x GROUP BY session),
    a AS (SELECT o.session, o.t0, min_by(h, row_idx) AS dummy, min(row_idx) AS row_idx FROM o LEFT JOIN x ON x.session = o.session AND x.t >= o.t0 GROUP BY ALL)
    SELECT a.session, round(a.t0, 3) AS t0, round(radians(coalesce(x.h, f.f, 0)), 9) AS heading0 FROM a LEFT JOIN x ON x.session = a.session AND x.row_idx = a.row_idx LEFT JOIN f ON f.session = a.session""")
def start_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = outages(spark, sf_dir)
    rows = rows.withColumn("h", F.when(F.pmod("event_id", F.lit(3)) > 0, F.col("heading_deg")))
    return rounded(rounded(pd_.start_heading(rows, found, "t", "row_idx", "h", WIDTH), 9, "heading0"), 3, "t0")


@query(f"""{S}, {OUTAGES}, b AS (SELECT session, t, a1 AS c1, a2 AS c2, gyr * 10 AS f, (lat - 51.505::DOUBLE) * 100 AS l, speed_ms AS w FROM samples),
    j AS (SELECT o.session, o.t0, atan2(sum(w * (c2 * f - c1 * l)), sum(w * (c1 * f + c2 * l))) AS phi, count(CASE WHEN abs(f) >= 0.3 THEN 1 END) AS nf, count(CASE WHEN abs(l) >= 0.1 THEN 1 END) AS nt FROM o JOIN b ON b.session = o.session AND b.t < o.t0 AND b.t >= o.t0 - 259200 GROUP BY ALL)
    SELECT o.session, round(o.t0, 3) AS t0, round(phi, 6) AS phi, coalesce(nf >= 3 AND nt >= 3, false) AS observable, round(CASE WHEN nf >= 3 AND nt >= 3 THEN phi ELSE 0 END, 6) AS phi_safe FROM o LEFT JOIN j ON j.session = o.session AND j.t0 = o.t0""")
def mount_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = outages(spark, sf_dir)
    blocks = rows.select("session", "t", F.col("a1").alias("c1"), F.col("a2").alias("c2"), (F.col("gyr") * 10).alias("f"), ((F.col("lat") - 51.505) * 100).alias("l"), F.col("speed_ms").alias("w"))
    out = pd_.mount_before(blocks, found, "t", "f", "l", "c1", "c2", "w", 3 * DAY, brisk=0.3, turning=0.1, least=3)
    return rounded(rounded(out, 6, "phi", "phi_safe"), 3, "t0")


def five_seconds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples as a grid of three rows a second, and an outage of five seconds at every twelfth row, the last ones uncovered."""
    rows = samples(spark, sf_dir).withColumn("k", F.col("row_idx") - 1)
    starts = rows.filter("k % 12 = 0").select("session", F.col("k").cast("double").alias("t0"), F.col("k").alias("start"), F.lit(5).alias("seconds"), (F.col("gyr") * 3).alias("phi"), F.radians("heading_deg").alias("heading0"))
    return rows, starts


FIVE = f"""{SAMPLES_SQL}, g AS (SELECT *, row_idx - 1 AS k FROM samples), st AS (SELECT session, k::DOUBLE AS t0, k AS start, gyr * 3 AS phi, radians(heading_deg) AS heading0 FROM g WHERE k % 12 = 0),
    sec AS (SELECT *, unnest(range(0, 5)) AS s FROM st), fa AS (SELECT sec.session, t0, s + 1 AS k, CASE WHEN count(g.k) = 3 THEN avg(g.a1 * cos(phi) + g.a2 * sin(phi)) END AS a_fwd FROM sec LEFT JOIN g ON g.session = sec.session AND g.k >= start + s * 3 AND g.k < start + s * 3 + 3 GROUP BY sec.session, t0, s)"""


@query(f"WITH {FIVE} SELECT session, t0, k::BIGINT AS k, round(a_fwd, 9) + 0.0::DOUBLE AS a_fwd FROM fa")
def forward_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, starts = five_seconds(spark, sf_dir)
    return rounded(pd_.forward_acceleration(rows, starts, "k", 3, "a1", "a2"), 9, "a_fwd")


@query(f"""WITH RECURSIVE {FIVE}, m AS (SELECT fa.*, g.speed_ms AS mu FROM fa JOIN g ON g.session = fa.session AND g.k = fa.t0 + fa.k - 1),
    f AS (SELECT session, t0, k, mu AS v, 400::DOUBLE AS p, mu FROM m WHERE k = 1 UNION ALL
        SELECT m.session, m.t0, m.k, v + coalesce(a_fwd, 0) + (p + CASE WHEN a_fwd IS NULL THEN 0 ELSE 0.5::DOUBLE END) / (p + CASE WHEN a_fwd IS NULL THEN 0 ELSE 0.5::DOUBLE END + 400) * (m.mu - v - coalesce(a_fwd, 0)),
            (1 - (p + CASE WHEN a_fwd IS NULL THEN 0 ELSE 0.5::DOUBLE END) / (p + CASE WHEN a_fwd IS NULL THEN 0 ELSE 0.5::DOUBLE END + 400)) * (p + CASE WHEN a_fwd IS NULL THEN 0 ELSE 0.5::DOUBLE END), m.mu FROM f JOIN m ON m.session = f.session AND m.t0 = f.t0 AND m.k = f.k + 1)
    SELECT session, t0, k::BIGINT AS k, round(greatest(0, v), 6) AS distance FROM f""")
def speed_fused_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, starts = five_seconds(spark, sf_dir)
    forces = pd_.forward_acceleration(rows, starts, "k", 3, "a1", "a2")
    inner = forces.select("session", "t0", "k", (F.col("t0") + F.col("k") - 1).cast("long").alias("at")).join(rows.select("session", F.col("k").alias("at"), F.col("speed_ms").alias("distance"), "heading_deg"), ["session", "at"])
    inner = inner.select("session", "t0", "k", "distance", F.radians("heading_deg").alias("heading"))
    return rounded(pd_.speed_fused(inner, forces).select("session", "t0", "k", "distance"), 6, "distance")


@query(f"{S} SELECT event_id, round(sqrt(power(a1 - gyr, 2) + power(a2 - a1, 2) + power(speed_ms - 9.8::DOUBLE, 2)), 6) AS phone, round(9.80665::DOUBLE * sqrt(a1 * a1 + a2 * a2), 6) AS ecu FROM samples")
def force_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    out = samples(spark, sf_dir).select("event_id", pd_.phone_magnitude([c("a1"), c("a2"), c("speed_ms")], [c("gyr"), c("a1"), F.lit(9.8)]).alias("phone"), pd_.ecu_magnitude(c("a1"), c("a2")).alias("ecu"))
    return rounded(out, 6, "phone", "ecu")


@query(f"""{S}, w AS (SELECT session, (row_idx - 1) // 4 AS w, avg(abs(gyr)) AS r, sqrt(power(avg(a1), 2) + power(avg(a2), 2)) AS f FROM samples GROUP BY ALL)
    SELECT session, w, round(r, 9) AS mean_rate, round(f, 9) AS "force", r <= 0.05 AND f >= 0.3 AS accepted FROM w""")
def alignment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("w", F.floor((F.col("row_idx") - 1) / 4))
    return rounded(pd_.straight_and_accelerating(rows, ["session", "w"], "gyr", "a1", "a2", 0.05), 9, "mean_rate", "force")


@query(f"{S} SELECT event_id, round(CASE WHEN event_id % 6 > 0 THEN speed_ms ELSE 0 END, 9) AS mu, round(CASE WHEN event_id % 6 > 0 THEN exp(0.5 * a1) ELSE 5 END, 6) AS sigma, round(CASE WHEN event_id % 6 > 0 THEN 1 / (1 + exp(-a2)) ELSE 0 END, 6) AS p_stationary, CASE WHEN event_id % 4 > 0 THEN abs(a1) ELSE 3 END AS used_sigma FROM samples")
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("event_id", F.col("speed_ms").alias("mu"), F.col("a1").alias("log_var"), F.col("a2").alias("logit"), (F.pmod("event_id", F.lit(6)) > 0).alias("valid"), pd_.sigmas(F.when(F.pmod("event_id", F.lit(4)) > 0, F.abs("a1"))).alias("used_sigma"))
    return rounded(rounded(pd_.model_outputs(rows).select("event_id", "mu", "sigma", "p_stationary", "used_sigma"), 9, "mu"), 6, "sigma", "p_stationary")


MODEL = f"""{SAMPLES_SQL}, w AS (SELECT session, ((row_idx - 1) // 20)::DOUBLE AS t0, (row_idx - 1) % 20 + 1 AS k, speed_ms AS mu, gyr AS yaw, 1 / (1 + exp(-a2)) AS p, abs(gyr) AS gyro, abs(a1) AS deviation, event_id % 5 > 0 AS valid FROM samples)"""


def model_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Model outputs over outages of twenty rows, a fifth of them invalid, and the outages' headings."""
    rows = samples(spark, sf_dir).select(
        "session", F.floor((F.col("row_idx") - 1) / 20).cast("double").alias("t0"), (F.pmod(F.col("row_idx") - 1, F.lit(20)) + 1).alias("k"), F.col("speed_ms").alias("mu"), F.col("gyr").alias("yaw"), (1 / (1 + F.exp(-F.col("a2")))).alias("p_stationary"),
        F.abs("gyr").alias("gyro"), F.abs("a1").alias("deviation"), (F.pmod("event_id", F.lit(5)) > 0).alias("valid"),
    )
    return rows, rows.select("session", "t0").distinct().withColumn("heading0", F.col("t0") / 10)


def model_sql(mu: str, yaw: str) -> str:
    return f"""WITH {MODEL}, v AS (SELECT session, t0, k, valid, {mu} AS mu, {yaw} AS yaw FROM w)
    SELECT session, t0, k, round(coalesce(last_value(CASE WHEN valid THEN mu END IGNORE NULLS) OVER o, 0), 6) + 0.0::DOUBLE AS distance, round(t0 / 10 + sum(CASE WHEN valid THEN yaw ELSE 0 END) OVER o, 6) + 0.0::DOUBLE AS heading FROM v WINDOW o AS (PARTITION BY session, t0 ORDER BY k ROWS UNBOUNDED PRECEDING)"""


@query(model_sql("mu * (1 - p)", "yaw * (1 - p)"))
def model_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, starts = model_windows(spark, sf_dir)
    return rounded(pd_.model_steps(pd_.gated(rows), starts), 6, "distance", "heading")


@query(model_sql(*(f"CASE WHEN p > 0.5 AND mu < 1 AND gyro < 0.02 AND deviation < 0.35 THEN 0 ELSE {x} END" for x in ("mu", "yaw"))))
def model_steps_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, starts = model_windows(spark, sf_dir)
    return rounded(pd_.model_steps(pd_.gated(rows, strict=True), starts), 6, "distance", "heading")


@query(f"""WITH {MODEL} SELECT session, t0, k, round(CASE WHEN valid THEN greatest(0, mu - 3) ELSE 0 END, 6) + 0.0::DOUBLE AS distance,
    round(t0 / 10 + sum(CASE WHEN valid THEN yaw ELSE 0 END) OVER (PARTITION BY session, t0 ORDER BY k ROWS UNBOUNDED PRECEDING), 6) + 0.0::DOUBLE AS heading FROM w""")
def probe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, starts = model_windows(spark, sf_dir)
    return rounded(pd_.probe_replay(rows, F.col("mu") - 3, starts, "yaw"), 6, "distance", "heading")


@query(f"WITH {MODEL} SELECT session, t0, k, round(CASE WHEN k <= 12 THEN mu ELSE mu / 2 END, 6) AS distance FROM w")
def primed_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = model_windows(spark, sf_dir)
    primed = rows.filter("k <= 12").select("session", "t0", "k", F.col("mu").alias("distance"))
    return rounded(pd_.displacements(primed, rows.select("session", "t0", "k", (F.col("mu") / 2).alias("distance"))), 6, "distance")


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    n AS (SELECT vec_id, i, (x - (i % 4) / 10.0::DOUBLE) / (1 + i % 4) * CASE WHEN i % 4 = 2 THEN 0.5::DOUBLE ELSE 1 END AS x FROM x)
    SELECT vec_id, round(sum(x), 6) + 0.0::DOUBLE AS total, round(sum(CASE WHEN i % 4 = 3 THEN x END), 6) + 0.0::DOUBLE AS turn, round(0.25::DOUBLE + sum(x * (i % 3 - 1)), 6) + 0.0::DOUBLE AS mu FROM n GROUP BY vec_id""")
def assembled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    out = pd_.assembled(rows, "x", [0.0, 0.1, 0.2, 0.3], [1.0, 2.0, 3.0, 4.0], {2: 0.5}, rate=3)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return rounded(out.select("vec_id", total("x").alias("total"), total("turn").alias("turn"), pd_.linear_prediction("x", [i % 3 - 1 for i in range(64)], 0.25).alias("mu")), 6, "total", "turn", "mu")


# ---------------------------------------------------------------- roads at a point


#: Between the whole degrees of the headings, so that no bearing is at the gate.
TOLERANCE = math.radians(60.5)


CANDIDATES = f"""{SAMPLES_SQL}, {CROSS_SQL}, pt AS (SELECT event_id AS id, 51.4995::DOUBLE + (event_id % 11) * 1e-4::DOUBLE AS lat, -2.5005::DOUBLE + (event_id % 13) * 1e-4::DOUBLE AS lon, radians(heading_deg) AS heading FROM samples),
    v AS (SELECT id, heading, edge, i, lat1, lon1, lat2, lon2, (lon1 - lon) * 111320 * cos(radians(lat)) AS x1, (lat1 - lat) * 110540 AS y1, (lon2 - lon1) * 111320 * cos(radians(lat)) AS dx, (lat2 - lat1) * 110540 AS dy, metres FROM pt, sg),
    h AS (SELECT *, greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) AS f FROM v), z AS (SELECT *, sqrt(power(x1 + f * dx, 2) + power(y1 + f * dy, 2)) AS distance FROM h),
    l AS (SELECT edge, sum(metres) AS len FROM sg GROUP BY edge), cu AS (SELECT edge, i, coalesce(sum(metres) OVER (PARTITION BY edge ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM sg),
    q AS (SELECT z.*, cum + f * metres AS o, len, row_number() OVER (PARTITION BY id, z.edge ORDER BY distance, z.i) AS first FROM z JOIN cu ON cu.edge = z.edge AND cu.i = z.i JOIN l ON l.edge = z.edge WHERE distance <= 60),
    two AS (SELECT id, edge, heading, distance, len, o, lat1, lon1, lat2, lon2, unnest([0, 1]) AS r FROM q WHERE first = 1), dd AS (SELECT two.*, edge * 2 + r AS d, CASE WHEN r = 1 THEN len - o ELSE o END AS o2, oneway FROM two JOIN e USING (edge)),
    bb AS (SELECT *, atan2((lon2 - lon1) * CASE WHEN r = 1 THEN -1 ELSE 1 END * cos(radians((lat1 + lat2) / 2)), (lat2 - lat1) * CASE WHEN r = 1 THEN -1 ELSE 1 END) - heading AS raw FROM dd WHERE r = 0 OR NOT oneway),
    ww AS (SELECT *, abs(atan2(sin(raw), cos(raw))) AS off_ FROM bb), aa AS (SELECT *, off_ <= radians(60.5::DOUBLE) AS ok, bool_or(off_ <= radians(60.5::DOUBLE)) OVER (PARTITION BY id) AS has FROM ww)"""


@query(f"""WITH {CANDIDATES} SELECT id, count(DISTINCT edge) AS edges, round(min(distance), 4) AS nearest, round(max(distance), 4) AS furthest FROM aa WHERE ok OR NOT has GROUP BY id""")
def road_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each point, its candidates: those with a fitting bearing if there is one, all kept here."""
    g = crossroads(spark)
    found = pd_.candidates(points(spark, sf_dir), g.segments, g.directed, 60.0, 12, TOLERANCE)
    near = found.groupBy("id").agg(F.count("*").alias("edges"), F.min("distance").alias("nearest"), F.max("distance").alias("furthest"))
    return rounded(near, 4, "nearest", "furthest")


@query(f"""WITH {CANDIDATES}, best AS (SELECT id, edge, min(distance) AS distance FROM aa WHERE ok OR NOT has GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, edge) AS k, min(distance) OVER (PARTITION BY id) AS d0 FROM best)
    SELECT id, k, round((d0 - distance) / 60, 6) + 0.0::DOUBLE AS weight FROM k WHERE k <= 2""")
def start_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = crossroads(spark)
    out = pd_.start_hypotheses(pd_.candidates(points(spark, sf_dir), g.segments, g.directed, 60.0, 12, TOLERANCE), 60.0, 2)
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.col("weight").desc(), "d"))
    return rounded(out.select("id", k.alias("k").cast("long"), "weight"), 6, "weight")


@query()
def rematched_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy tracks over the crossroads, matched again every ten seconds."""
    from tarmac.plans.graph import drives

    g = crossroads(spark)
    steps, starts, parts = drives(spark, sf_dir)
    longest = steps.agg(F.max("k")).first()[0] or 0
    return rounded(pd_.rematched_track(steps, starts, parts, g.segments, g.directed, longest, 60.0, settings=mm.Settings()), 4, "offset")


# ---------------------------------------------------------------- comparisons


@query("""WITH i(inner_) AS (VALUES ('constant_velocity_dr'), ('ins_dr'), ('model'), ('model_speed_fused')), b(backend) AS (VALUES ('graph')), t(tracker) AS (VALUES ('map'), ('hmm'), ('viterbi'))
    SELECT inner_ AS name, inner_ AS "inner", NULL AS backend, NULL AS tracker FROM i UNION ALL SELECT tracker || '_matched_' || backend || '_' || inner_, inner_, backend, tracker FROM i, b, t""")
def predictor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    column = lambda name, values: spark.createDataFrame([(v,) for v in values], f"`{name}` string")
    return pd_.predictor_names(column("inner", ["constant_velocity_dr", "ins_dr", "model", "model_speed_fused"]), column("backend", ["graph"]), column("tracker", ["map", "hmm", "viterbi"]))


@query("""WITH x AS (SELECT l_linenumber::VARCHAR AS variant, CASE WHEN l_orderkey % 9 > 0 THEN l_quantity * 4 END AS drift FROM lineitem)
    SELECT variant, count(drift) AS n, round(avg(drift), 6) AS mean_m, round(quantile_cont(drift, 0.5), 6) AS median_m, round(quantile_cont(drift, 0.9), 6) AS p90_m, round(100 * avg((drift < 100)::INT), 6) AS pct_under_100m, count(*) - count(drift) AS skipped FROM x GROUP BY variant HAVING count(drift) > 0""")
def ablation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("variant"), F.when(F.pmod("l_orderkey", F.lit(9)) > 0, F.col("l_quantity") * 4).alias("drift"))
    return rounded(pd_.ablation(rows, "variant", "drift"), 6, "mean_m", "median_m", "p90_m", "pct_under_100m")


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT 'run' || (id % 3) AS run, CASE WHEN session % 2 = 0 THEN 'test' ELSE 'validate' END AS role, y_true, y_pred FROM pairs),
    b AS (SELECT run, role, CASE WHEN y_true < 5 THEN 0 WHEN y_true < 15 THEN 1 WHEN y_true < 25 THEN 2 ELSE 3 END AS b, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sum(abs(y_pred - y_true)) AS s FROM x GROUP BY ALL)
    SELECT run, role, round(avg(CASE WHEN n >= 30 THEN mae END), 6) AS bucket_mean_mae, round(sum(s) / sum(n), 6) AS pooled_mae, sum(n)::BIGINT AS n FROM b GROUP BY ALL""")
def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumns({"run": F.concat(F.lit("run"), F.pmod("id", F.lit(3)).cast("string")), "role": F.when(F.col("session") % 2 == 0, "test").otherwise("validate")})
    return rounded(pd_.windowed_metrics(rows, "run", "role", "y_true", "y_pred"), 6, "bucket_mean_mae", "pooled_mae")


@query("""WITH x AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'test' ELSE 'validate' END AS role, CASE WHEN l_linenumber % 2 = 0 THEN 'model' ELSE 'oracle_heading' END AS variant, l_quantity * 40 AS distance, l_quantity * 4 AS drift, (l_discount - 0.05::DOUBLE) * 100 AS signed FROM lineitem)
    SELECT role, variant, (CASE WHEN distance / 60 < 5 THEN 0 WHEN distance / 60 < 15 THEN 1 WHEN distance / 60 < 25 THEN 2 ELSE 3 END)::INT AS bucket, count(*) AS n, round(avg(drift), 6) AS crse, round(avg(signed), 6) + 0.0::DOUBLE AS cae FROM x GROUP BY ALL""")
def drift_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 2 == 0, "test").otherwise("validate").alias("role"), F.when(F.col("l_linenumber") % 2 == 0, "model").otherwise("oracle_heading").alias("variant"), (F.col("l_quantity") * 40).alias("distance"), (F.col("l_quantity") * 4).alias("drift"), ((F.col("l_discount") - 0.05) * 100).alias("signed"),
    )
    return rounded(pd_.drift_rows(rows, ["role", "variant"], "distance", 60.0, "drift", "signed"), 6, "crse", "cae")


@query(f"""WITH {PAIRS_SQL}, b AS (SELECT CASE WHEN y_true < 5 THEN 0 WHEN y_true < 15 THEN 1 WHEN y_true < 25 THEN 2 ELSE 3 END AS b, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sum(abs(y_pred - y_true)) AS s FROM pairs GROUP BY ALL)
    SELECT round(sum(s) / sum(n), 6) AS pooled_mae, round(avg(CASE WHEN n >= 30 THEN mae END), 6) AS bucket_mean_mae, round(max(CASE WHEN b = 0 THEN mae END), 6) AS mae_0, round(max(CASE WHEN b = 1 THEN mae END), 6) AS mae_1, round(max(CASE WHEN b = 2 THEN mae END), 6) AS mae_2, round(max(CASE WHEN b = 3 THEN mae END), 6) AS mae_3 FROM b""")
def model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pd_.evaluation(pairs(spark, sf_dir), "y_true", "y_pred")
    return rounded(out, 6, *out.columns)


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT *, 'run' || (id % 2) AS run, (id % 13) / 100.0::DOUBLE AS rate FROM pairs), s AS (SELECT *, CASE WHEN rate >= 0.05 THEN 'cornering' WHEN rate <= 0.02 AND y_true < 25 THEN 'straight' WHEN rate <= 0.02 THEN 'motorway' END AS scenario FROM x)
    SELECT run, scenario, count(*) AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(avg(y_pred - y_true), 6) + 0.0::DOUBLE AS bias, round(avg(y_true), 6) AS label_mean FROM s WHERE scenario IS NOT NULL GROUP BY ALL HAVING count(*) >= 30""")
def scenario_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumns({"run": F.concat(F.lit("run"), F.pmod("id", F.lit(2)).cast("string")), "rate": F.pmod("id", F.lit(13)) / 100.0})
    return rounded(pd_.scenario_mae(rows, ["run"], F.col("rate"), "y_true", "y_pred"), 6, "mae", "bias", "label_mean")


@query(f"""{S}, n AS (SELECT *, row_idx - 1 AS i, count(*) OVER (PARTITION BY session) AS n FROM samples), w AS (SELECT session, count(*) AS windows FROM n WHERE i >= 8 AND (i - 8) % 4 = 0 AND i - 8 < n - 8 - 2 GROUP BY session),
    c AS (SELECT DISTINCT session, CASE WHEN session % 5 = 0 THEN 'test' WHEN session % 5 = 1 THEN 'ood' ELSE 'train' END AS role, CASE WHEN session % 7 = 0 THEN 'V' ELSE 'S' END AS family FROM samples)
    SELECT c.session, role, coalesce(windows, 0) AS windows, CASE WHEN coalesce(windows, 0) = 0 THEN 'no usable windows' END AS note FROM c LEFT JOIN w ON w.session = c.session WHERE role IN ('train', 'test') AND family = 'S'""")
def split_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    windows = wn.complete(wn.sliding_windows(rows, "session", "row_idx", ["a1", "a2"], 8, 4, 2, ["speed_ms"]), "speed_ms")
    five = F.pmod("session", F.lit(5))
    catalogue = rows.select("session").distinct().select("session", F.when(five == 0, "test").when(five == 1, "ood").otherwise("train").alias("role"), F.when(F.pmod("session", F.lit(7)) == 0, "V").otherwise("S").alias("family"))
    return pd_.split_sessions(windows, catalogue, ["train", "test"])


@query("""WITH x AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'rare' WHEN l_suppkey % 2 = 0 THEN '10 Hz' ELSE '2 Hz' END AS regime, l_suppkey AS session, l_quantity AS q, l_extendedprice / 1000 AS y, (l_suppkey // 10) % 10 < 7 AS tr FROM lineitem),
    z AS (SELECT regime, session, count(*) AS n FROM x GROUP BY ALL), ok AS (SELECT * FROM x SEMI JOIN (SELECT * FROM z WHERE n >= 20) k ON k.regime = x.regime AND k.session = x.session), many AS (SELECT regime, count(DISTINCT session) AS s FROM ok GROUP BY regime),
    st AS (SELECT regime, avg(q) AS m, stddev_pop(q) AS d, avg(y) AS ym, count(DISTINCT session) AS fitted FROM ok WHERE tr GROUP BY regime),
    c AS (SELECT ok.regime, sum(power((q - m) / d, 2)) AS xx, sum((q - m) / d) AS sx, count(*) AS n, sum((q - m) / d * y) AS xy, sum(y) AS sy FROM ok JOIN st ON st.regime = ok.regime WHERE tr GROUP BY ok.regime),
    w AS (SELECT regime, (xy * (n + 1) - sx * sy) / ((xx + 1) * (n + 1) - sx * sx) AS a, ((xx + 1) * sy - sx * xy) / ((xx + 1) * (n + 1) - sx * sx) AS b FROM c),
    r AS (SELECT ok.regime, any_value(fitted) AS n_sessions_fit, count(DISTINCT session) AS n_sessions_eval, count(*) AS n_windows_eval, avg(abs(y - ym)) AS mean_mae, avg(abs(greatest(0, a * (q - m) / d + b) - y)) AS ridge FROM ok JOIN st ON st.regime = ok.regime JOIN w ON w.regime = ok.regime WHERE NOT tr GROUP BY ok.regime)
    SELECT g.regime, coalesce(n_sessions_fit, 0) AS n_sessions_fit, coalesce(n_sessions_eval, 0) AS n_sessions_eval, coalesce(n_windows_eval, 0) AS n_windows_eval, round(mean_mae, 4) AS mean_mae_m, round(ridge, 4) AS ridge_mae_m, round(100 * (1 - ridge / mean_mae), 4) AS ridge_improvement_pct, CASE WHEN r.regime IS NULL THEN 'too few sessions' END AS note
    FROM (SELECT DISTINCT regime FROM x) g LEFT JOIN (SELECT r.* FROM r JOIN many ON many.regime = r.regime WHERE s >= 12) r ON r.regime = g.regime""")
def rate_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(F.when(key % 10 == 0, "rare").when(key % 2 == 0, "10 Hz").otherwise("2 Hz").alias("regime"), key.alias("session"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("y"))
    out = pd_.rate_regimes(rows, "regime", "session", ["q"], "y", F.floor(F.col("session") / 10) % 10 < 7, 20, 12)
    return rounded(out, 4, "mean_mae_m", "ridge_mae_m", "ridge_improvement_pct")



