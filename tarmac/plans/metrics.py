"""Queries over metrics, buckets, drift tables and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import metrics as m
from tarmac.operators import statistics as st
from tarmac.operators import timeseries as ts
from tarmac.plans.registry import query
from tarmac.views import PAIRS_SQL, SAMPLES_SQL, pairs, samples, table

S = f"WITH {SAMPLES_SQL}"
P = f"WITH {PAIRS_SQL}"
BUCKET = "CASE WHEN {0} < 5 THEN 0 WHEN {0} < 15 THEN 1 WHEN {0} < 25 THEN 2 WHEN {0} IS NOT NULL THEN 3 END"


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


HOURLY = "hourly AS (SELECT session, floor(t / 3600) AS t, avg(speed_ms) AS y FROM samples GROUP BY ALL)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("session", F.floor(F.col("t") / 3600).cast("double").alias("t")).agg(F.avg("speed_ms").alias("y"))


MAE_SQL = f"""b AS (SELECT {BUCKET.format('y')} AS bucket, y, p FROM known), f AS (SELECT bucket, count(*) AS n, avg(abs(p - y)) AS mae, avg(y) AS label_mean FROM b GROUP BY bucket),
    e AS (SELECT unnest([0, 1, 2, 3])::INT AS bucket), j AS (SELECT e.bucket, coalesce(n, 0)::BIGINT AS n, mae, label_mean FROM e LEFT JOIN f USING (bucket))
    SELECT bucket, n, round(n / (sum(n) OVER ())::DOUBLE, 9) AS frac, round(mae, 6) AS mae, round(label_mean, 6) AS label_mean, n >= 30 AS counted FROM j"""


@query(f"""{S}, {HOURLY}, q AS (SELECT y, lag(y) OVER w AS py, t - lag(t) OVER w AS dt FROM hourly WINDOW w AS (PARTITION BY session ORDER BY t)),
    known AS (SELECT y, py AS p FROM q WHERE abs(dt - 1) < 1e-6), {MAE_SQL}""")
def persistence_bucketed_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.persistence(hourly(spark, sf_dir), "session", "t", ["t"], "y")
    return rounded(rounded(m.bucketed_mae(rows, "y", "y_pred"), 6, "mae", "label_mean"), 9, "frac")


@query(f"{P}, known AS (SELECT y_true AS y, y_pred AS p FROM pairs), {MAE_SQL}")
def bucketed_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(m.bucketed_mae(pairs(spark, sf_dir), "y_true", "y_pred"), 6, "mae", "label_mean"), 9, "frac")


@query(f"""{P}, f AS (SELECT session, {BUCKET.format('y_true')} AS b, count(*) AS n, avg(abs(y_pred - y_true)) AS mae, sum(abs(y_pred - y_true)) AS s FROM pairs GROUP BY ALL)
    SELECT session, round(avg(CASE WHEN n >= 30 THEN mae END), 6) AS bucket_mean_mae, round(sum(s) / sum(n), 6) AS pooled_mae, sum(n)::BIGINT AS n FROM f GROUP BY session""")
def bucket_mean_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.bucket_mean_mae(pairs(spark, sf_dir), "y_true", "y_pred", ["session"]), 6, "bucket_mean_mae", "pooled_mae")


@query(f"""{P}, b AS (SELECT id, {BUCKET.format('y_true')} AS bucket FROM pairs), c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket),
    r AS (SELECT *, CASE WHEN n >= 30 THEN 1.0::DOUBLE / n ELSE 0 END AS raw FROM c), w AS (SELECT bucket, raw / (sum(raw * n) OVER () / sum(n) OVER ()) AS weight FROM r)
    SELECT id, bucket, round(weight, 9) AS weight FROM b JOIN w USING (bucket)""")
def inverse_frequency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.inverse_frequency_weights(pairs(spark, sf_dir), "y_true").select("id", "bucket", "weight"), 9, "weight")


@query(f"""{S}, e AS (SELECT session, row_idx AS k, a1 AS n, a2 AS e, a1 + a2 AS s, sqrt(a1 * a1 + a2 * a2) AS p FROM samples)
    SELECT session, round(sqrt(power(sum(n), 2) + power(sum(e), 2)), 6) AS crse_2d, round(sum(s), 6) + 0.0::DOUBLE AS cae, round(avg(abs(s)), 6) AS aeps, round(sum(abs(s)), 6) AS crse_scalar, count(s) AS n_seconds,
        round(max_by(p, k), 6) AS crse, round(max_by(p, k), 6) AS final_position_error_m, round(max(p), 6) AS max_position_error_m FROM e GROUP BY session""")
def outage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("session", "row_idx", "a1", "a2", (F.col("a1") + F.col("a2")).alias("s"), F.hypot("a1", "a2").alias("p"))
    out = m.summary(rows, ["session"], "s", "row_idx", "p").join(rows.groupBy("session").agg(m.crse(F.col("a1"), F.col("a2")).alias("crse_2d")), "session")
    return rounded(out, 6, "crse_2d", "cae", "aeps", "crse_scalar", "crse", "final_position_error_m", "max_position_error_m")


SCORES = "scores AS (SELECT l_returnflag AS predictor, CASE l_linenumber % 3 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 60 END AS duration, l_extendedprice / 100 AS drift, (l_discount - 0.05::DOUBLE) * l_extendedprice / 10 AS cae, l_quantity * 40 AS distance, l_shipdate, l_orderkey FROM lineitem)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outage scores stood in for by line items."""
    third = F.pmod("l_linenumber", F.lit(3))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("predictor"), F.when(third == 0, 10).when(third == 1, 30).otherwise(60).alias("duration"), (F.col("l_extendedprice") / 100).alias("drift"),
        ((F.col("l_discount") - 0.05) * F.col("l_extendedprice") / 10).alias("cae"), (F.col("l_quantity") * 40).alias("distance"), "l_shipdate", "l_orderkey",
    )


@query(f"""WITH {SCORES}, a AS (SELECT predictor, duration, count(drift) AS n, avg(drift) AS mean, quantile_cont(drift, 0.5) AS median, quantile_cont(drift, 0.9) AS p90, max(drift) AS max, avg(cae) AS mean_cae, avg(abs(cae)) AS mean_abs_cae FROM scores GROUP BY ALL)
    SELECT predictor, duration, n, round(mean, 4) AS mean, round(median, 4) AS median, round(p90, 4) AS p90, round(max, 4) AS max, round(mean_cae, 4) + 0.0::DOUBLE AS mean_cae, round(mean_abs_cae, 4) AS mean_abs_cae, round(mean_abs_cae / mean, 6) AS ratio,
        CASE WHEN mean_abs_cae / mean > 0.7 THEN 'systematic' WHEN mean_abs_cae / mean < 0.3 THEN 'scatter' ELSE 'mixed' END AS reading FROM a""")
def drift_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.drift_stats(scores(spark, sf_dir), ["predictor", "duration"], "drift", "cae")
    return rounded(rounded(out, 4, "mean", "median", "p90", "max", "mean_cae", "mean_abs_cae"), 6, "ratio")


@query(f"""WITH {SCORES} SELECT predictor, count(*) AS n, round(100 * avg((drift < 100)::INT), 6) AS under_100_pct, round(avg(drift), 9) AS mean, round(quantile_cont(drift, 0.5), 9) AS median
    FROM scores WHERE duration = 60 AND distance BETWEEN 800 AND 1200 GROUP BY predictor""")
def benchmark_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(m.benchmark_band(scores(spark, sf_dir), ["predictor"], "duration", "distance", "drift"), 9, "mean", "median"), 6, "under_100_pct")


@query(f"""WITH {SCORES} SELECT predictor, round(avg(CASE WHEN duration = 10 THEN (cae < 0)::INT END), 9) AS "10", round(avg(CASE WHEN duration = 30 THEN (cae < 0)::INT END), 9) AS "30", round(avg(CASE WHEN duration = 60 THEN (cae < 0)::INT END), 9) AS "60"
    FROM scores GROUP BY predictor""")
def fraction_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.fraction_negative(scores(spark, sf_dir), "predictor", "duration", [10, 30, 60], "cae"), 9, "10", "30", "60")


@query("""WITH c AS (SELECT o_totalprice > 100000 AS a, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS b FROM orders)
    SELECT 'large' AS "check", count(CASE WHEN a THEN 1 END) AS passed, count(CASE WHEN NOT a THEN 1 END) AS failed, count(CASE WHEN a IS NULL THEN 1 END) AS not_applicable FROM c
    UNION ALL SELECT 'final', count(CASE WHEN b THEN 1 END), count(CASE WHEN NOT b THEN 1 END), count(CASE WHEN b IS NULL THEN 1 END) FROM c""")
def tri_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return m.tri_state(table(spark, sf_dir, "orders"), {"large": F.col("o_totalprice") > 100000, "final": status})


@query(f"""WITH {SCORES}, p AS (SELECT predictor, year(l_shipdate) AS epoch, count(drift) AS n, avg(drift) AS mean, stddev_samp(drift) / sqrt(count(drift)) AS se FROM scores GROUP BY ALL),
    q AS (SELECT *, avg(mean) OVER (PARTITION BY predictor ORDER BY epoch ROWS 2 PRECEDING) AS ma3, abs(mean - lag(mean) OVER (PARTITION BY predictor ORDER BY epoch)) AS change FROM p)
    SELECT predictor, epoch, n, round(mean, 4) AS mean, round(se, 4) AS se, round(ma3, 4) AS ma3, round(change, 4) AS change, coalesce(change <= se, false) AS within_noise FROM q""")
def ma3_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).withColumn("epoch", F.year("l_shipdate").cast("long"))
    return rounded(m.drift_progress(rows, "predictor", "epoch", "drift"), 4, "mean", "se", "ma3", "change")


@query(f"""{S}, {HOURLY}, r AS (SELECT *, CASE session % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validate' ELSE 'test' END AS role FROM hourly),
    q AS (SELECT role, y, CASE WHEN abs(t - lag(t) OVER w - 1) < 1e-6 THEN lag(y) OVER w END AS p, (SELECT avg(y) FROM r WHERE role = 'train') AS mean FROM r WINDOW w AS (PARTITION BY session ORDER BY t)),
    u AS (SELECT role, 'mean' AS predictor, y, mean AS p FROM q UNION ALL SELECT role, 'persistence', y, p FROM q),
    b AS (SELECT role, predictor, {BUCKET.format('y')} AS b, count(*) AS n, avg(abs(p - y)) AS mae, sum(abs(p - y)) AS s FROM u WHERE p IS NOT NULL GROUP BY ALL),
    d AS (SELECT role, predictor, count(CASE WHEN p IS NULL THEN 1 END) AS dropped FROM u GROUP BY ALL)
    SELECT role, predictor, round(avg(CASE WHEN n >= 30 THEN mae END), 6) AS bucket_mean_mae, round(sum(s) / sum(n), 6) AS pooled_mae, sum(n)::BIGINT AS n, any_value(dropped) AS dropped FROM b JOIN d USING (role, predictor) GROUP BY ALL""")
def baseline_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod("session", F.lit(3))
    rows = hourly(spark, sf_dir).withColumn("role", F.when(third == 0, "train").when(third == 1, "validate").otherwise("test"))
    return rounded(m.baselines(rows, "session", "role", "t", ["t"], "y", "train"), 6, "bucket_mean_mae", "pooled_mae")


@query("""WITH e AS (SELECT unnest([0, 1, 2, 3])::INT AS bin, unnest([0, 10, 25, 40])::DOUBLE AS low, unnest([10, 25, 40, 50])::DOUBLE AS high)
    SELECT bin, low, high, count(l_quantity) AS n FROM e LEFT JOIN lineitem ON l_quantity >= low AND (l_quantity < high OR (bin = 3 AND l_quantity = high)) GROUP BY ALL""")
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [0, 10, 25, 40, 50])


@query("SELECT round(quantile_cont(l_extendedprice, 0.6), 4) AS p60, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(l_extendedprice) AS n FROM lineitem WHERE l_quantity >= 5")
def band_cutpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.cut_points(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_quantity") >= 5), 4, "p60", "p90")


@query("""WITH c AS (SELECT quantile_cont(o_totalprice, 0.6) AS p60, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders), b AS (SELECT o_orderstatus, CASE WHEN o_totalprice < p60 THEN 'low' WHEN o_totalprice < p90 THEN 'middle' ELSE 'high' END AS band FROM orders, c)
    SELECT o_orderstatus AS role, count(CASE WHEN band = 'low' THEN 1 END) AS low, count(CASE WHEN band = 'middle' THEN 1 END) AS middle, count(CASE WHEN band = 'high' THEN 1 END) AS high FROM b GROUP BY role""")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")
    rows = st.banded(orders, "o_totalprice", st.cut_points(orders, "o_totalprice")).withColumnRenamed("o_orderstatus", "role")
    return rows.groupBy("role").pivot("band", ["low", "middle", "high"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""{S}, r AS (SELECT session, rank() OVER (PARTITION BY session ORDER BY speed_ms) + (count(*) OVER (PARTITION BY session, speed_ms) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY session ORDER BY lat) + (count(*) OVER (PARTITION BY session, lat) - 1) / 2.0 AS ry FROM samples)
    SELECT session, count(*) AS n, round(corr(rx, ry), 6) + 0.0::DOUBLE AS rho FROM r GROUP BY session""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.spearman(samples(spark, sf_dir), ["session"], "speed_ms", "lat"), 6, "rho")


LAGS = [-3, -2, -1, 0, 1, 2, 3]
Z = "z AS (SELECT session, row_idx, (a1 - avg(a1) OVER w) / stddev_pop(a1) OVER w AS zx, (a2 - avg(a2) OVER w) / stddev_pop(a2) OVER w AS zy FROM samples WINDOW w AS (PARTITION BY session))"
LAGGED = "c AS (SELECT a.session, lag, count(*) AS n, avg(a.zx * b.zy) AS r FROM (SELECT z.*, unnest(range(-3, 4)) AS lag FROM z) a JOIN z b ON b.session = a.session AND b.row_idx = a.row_idx + lag GROUP BY ALL)"


@query(f'{S}, {Z}, {LAGGED} SELECT session, "lag", n, round(r, 6) + 0.0::DOUBLE AS r FROM c')
def lag_selfjoin_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.lag_correlations(samples(spark, sf_dir), "session", "row_idx", "a1", "a2", LAGS), 6, "r")


@query(f"""{S}, {Z}, {LAGGED}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(abs(r), 9) DESC, "lag") AS k FROM c WHERE n >= 3)
    SELECT session, "lag", round(r, 6) + 0.0::DOUBLE AS r FROM k WHERE k = 1""")
def best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.best_lag(st.lag_correlations(samples(spark, sf_dir), "session", "row_idx", "a1", "a2", LAGS), "session"), 6, "r")


@query(f"""{S}, m AS (SELECT session, a1 - avg(a1) OVER w AS p, a2 - avg(a2) OVER w AS q, gyr - avg(gyr) OVER w AS w FROM samples WINDOW w AS (PARTITION BY session)),
    s AS (SELECT session, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * w) AS pw, sum(q * w) AS qw, sum(w * w) AS ww FROM m GROUP BY session),
    g AS (SELECT s.*, yaw, cos(yaw * 2 * pi() / 72) AS c, sin(yaw * 2 * pi() / 72) AS s FROM s, (SELECT unnest(range(0, 72)) AS yaw)),
    r AS (SELECT session, yaw, (c * pw + s * qw) / sqrt((c * c * pp + 2 * c * s * pq + s * s * qq) * ww) AS r FROM g)
    SELECT session, yaw::INT AS yaw, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY round(r, 9) DESC, yaw) AS k FROM r) WHERE k = 1""")
def gram_yaw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.yaw_search(samples(spark, sf_dir), "session", "a1", "a2", "gyr"), 6, "r")


@query(f"""{S}, l AS (SELECT a.session, lag, a.a1 AS p, a.a2 AS q, b.gyr AS w FROM (SELECT samples.*, unnest(range(-3, 4)) AS lag FROM samples) a JOIN samples b ON b.session = a.session AND b.row_idx = a.row_idx + lag),
    s AS (SELECT session, lag, covar_pop(p, p) AS pp, covar_pop(p, q) AS pq, covar_pop(q, q) AS qq, covar_pop(p, w) AS pw, covar_pop(q, w) AS qw, covar_pop(w, w) AS ww FROM l GROUP BY ALL HAVING count(*) >= 3),
    g AS (SELECT s.*, yaw, cos(yaw * 2 * pi() / 72) AS c, sin(yaw * 2 * pi() / 72) AS s FROM s, (SELECT unnest(range(0, 72)) AS yaw)),
    r AS (SELECT session, "lag", yaw, round((c * pw + s * qw) / sqrt((c * c * pp + 2 * c * s * pq + s * s * qq) * ww), 7) AS r FROM g)
    SELECT session, "lag"::INT AS "lag", yaw::INT AS yaw, r FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY r DESC, "lag", yaw) AS k FROM r) WHERE k = 1""")
def lagged_yaw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.lagged_yaw_search(samples(spark, sf_dir), "session", "row_idx", "a1", "a2", "gyr", LAGS)


@query(f"""{S}, g AS (SELECT session, count(*) AS n, regr_r2(speed_ms, a2) AS r2, regr_slope(speed_ms, a2) AS b FROM samples GROUP BY session)
    SELECT session, n, round(r2, 6) AS r2, round(b, 6) AS b_a2 FROM g""")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.least_squares(samples(spark, sf_dir), ["session"], ["a2"], "speed_ms"), 6, "r2", "b_a2")


CURVES = """c AS (SELECT session, row_idx, sum(speed_ms) OVER w AS x, sum(abs(a1)) OVER w AS y FROM samples WINDOW w AS (PARTITION BY session ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT session, row_idx, (x - first_value(x) OVER w) / (last_value(x) OVER w - first_value(x) OVER w) AS x, (y - first_value(y) OVER w) / (last_value(y) OVER w - first_value(y) OVER w) AS y FROM c
        WINDOW w AS (PARTITION BY session ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"""{S}, {CURVES}, d AS (SELECT a.session, lag, round(avg(abs(a.x - b.y)), 9) AS residual FROM (SELECT n.*, unnest(range(-3, 4)) AS lag FROM n) a JOIN n b ON b.session = a.session AND b.row_idx = a.row_idx + lag GROUP BY ALL HAVING count(*) >= 10)
    SELECT session, "lag"::INT AS "lag", round(residual, 6) AS residual FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY residual, "lag") AS k FROM d) WHERE k = 1""")
def distance_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.operators.sliced import running_sum

    rows = running_sum(samples(spark, sf_dir), "session", "t", ["t", "row_idx"], F.col("speed_ms"), "x", 864_000.0)
    rows = running_sum(rows, "session", "t", ["t", "row_idx"], F.abs("a1"), "y", 864_000.0)
    x = ts.normalised(rows, "session", "row_idx", "x").withColumn("x", F.col("norm")).drop("norm")
    both = ts.normalised(x, "session", "row_idx", "y").withColumn("y", F.col("norm"))
    return rounded(st.distance_offset(both, "session", "row_idx", "x", "y", LAGS), 6, "residual")


@query(f"{S}, h AS (SELECT session, sqrt(power(avg(cos(radians(heading_deg))), 2) + power(avg(sin(radians(heading_deg))), 2)) AS r FROM samples GROUP BY session) SELECT session, round(sqrt(-2 * ln(r)), 6) AS spread FROM h")
def circular_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.functions.angles import circular_spread as spread

    return rounded(samples(spark, sf_dir).groupBy("session").agg(spread(F.radians("heading_deg")).alias("spread")), 6, "spread")


@query(f"""{S}, g AS (SELECT session, quantile_cont(a1, 0.5) AS x, quantile_cont(a2, 0.5) AS y, quantile_cont(speed_ms, 0.5) AS z FROM samples GROUP BY session)
    SELECT session, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0::DOUBLE AS g_a1, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0::DOUBLE AS g_a2, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0::DOUBLE AS g_speed_ms FROM g""")
def gravity_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.gravity(samples(spark, sf_dir), "session", ["a1", "a2", "speed_ms"]), 6, "g_a1", "g_a2", "g_speed_ms")


@query("""WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT (i % 4)::INT AS channel, count(x) AS n, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0 ELSE stddev_pop(x) END, 6) AS std FROM x GROUP BY channel""")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return rounded(st.norm_stats(rows, "x", 4), 6, "mean", "std")


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT i % 4 AS c, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY c)
    SELECT vec_id, round(sum((x - m) / s), 4) + 0.0::DOUBLE AS total, round(sum(power((x - m) / s, 2)), 4) AS squares FROM x JOIN s ON i % 4 = c GROUP BY vec_id""")
def standardise_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = st.standardised(rows, "x", st.norm_stats(rows, "x", 4), 4)
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda s, x: s + f(x))
    return rounded(out.select("vec_id", total(lambda x: x).alias("total"), total(lambda x: x * x).alias("squares")), 4, "total", "squares")


@query(f"{S} SELECT session, regr_count(a2, speed_ms) AS n, round(regr_slope(a2, speed_ms), 6) AS slope, round(regr_intercept(a2, speed_ms), 6) AS intercept FROM samples GROUP BY session")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.linear_fit(samples(spark, sf_dir), ["session"], "a2", "speed_ms"), 6, "slope", "intercept")


EDGES20 = ", ".join(f"{k}::DOUBLE / 20" for k in range(21))
KNOTS = f"""e AS (SELECT quantile_cont(y_pred, [{EDGES20}]) AS e FROM pairs),
    b AS (SELECT least(19, greatest(0, len(list_filter(e, lambda q: q <= y_pred)) - 1)) AS bin, y_pred, y_true FROM pairs, e),
    k AS (SELECT bin, count(*) AS n, avg(y_pred) AS x, avg(y_true) AS y FROM b GROUP BY bin HAVING count(*) >= 20), r AS (SELECT bin, n, x, max(y) OVER (ORDER BY bin) AS y FROM k)"""


@query(f"{P}, {KNOTS} SELECT bin::INT AS bin, n, round(x, 6) AS x, round(y, 6) AS y FROM r")
def calibrator_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.calibrator(pairs(spark, sf_dir), "y_pred", "y_true"), 6, "x", "y")


@query("""WITH k(x, y) AS (VALUES (0.0::DOUBLE, 1.0::DOUBLE), (10.0, 8.0), (20.0, 22.0), (30.0, 28.0)), p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::DOUBLE AS p FROM lineitem),
    j AS (SELECT id, p, (SELECT max(x) FROM k WHERE x <= p.p) AS x0, (SELECT min(x) FROM k WHERE x > p.p) AS x1 FROM p)
    SELECT id, round(greatest(0, CASE WHEN x1 IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (p - x0) / (x1 - x0) END), 6) AS calibrated FROM j LEFT JOIN k a ON a.x = x0 LEFT JOIN k b ON b.x = x1""")
def calibrator_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = spark.createDataFrame([(0.0, 1.0), (10.0, 8.0), (20.0, 22.0), (30.0, 28.0)], "x double, y double")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("p"))
    return rounded(st.calibrated(rows, "p", knots).select("id", "calibrated"), 6, "calibrated")


@query("SELECT count(CASE WHEN l_quantity < 3 THEN 1 END) AS positives, count(CASE WHEN NOT l_quantity < 3 THEN 1 END) AS negatives, count(CASE WHEN NOT l_quantity < 3 THEN 1 END)::DOUBLE / count(CASE WHEN l_quantity < 3 THEN 1 END) AS weight FROM lineitem")
def pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.positive_weight(table(spark, sf_dir, "lineitem"), F.col("l_quantity") < 3)
