"""Outage error metrics, speed buckets and drift tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the speed buckets, left-closed; the windows a bucket needs to count.
EDGES, COUNTED = (5.0, 15.0, 25.0), 30


def crse(north: Column, east: Column) -> Column:
    """Aggregate: length of the summed error vector."""
    return F.hypot(F.sum(north), F.sum(east))


def last_finite(error: Column, k: Column) -> Column:
    """Aggregate: the last known value, which is the CRSE of position errors."""
    return F.max_by(error, F.when(error.isNotNull(), k))


def crse_scalar(error: Column) -> Column:
    return F.coalesce(F.sum(F.abs(error)), F.lit(0.0))


def cae(error: Column) -> Column:
    return F.coalesce(F.sum(error), F.lit(0.0))


def aeps(error: Column) -> Column:
    return F.avg(F.abs(error))


def summary(steps: DataFrame, keys: list[str], error: str, k: str, position: str | None = None) -> DataFrame:
    """One row per outage: cae, aeps, crse_scalar, n_seconds and, with a position error, crse, final and largest."""
    e = F.col(error)
    aggregates = [cae(e).alias("cae"), aeps(e).alias("aeps"), crse_scalar(e).alias("crse_scalar"), F.count(e).alias("n_seconds")]
    if position:
        p = F.col(position)
        aggregates += [last_finite(p, F.col(k)).alias("crse"), F.max_by(p, k).alias("final_position_error_m"), F.max(p).alias("max_position_error_m")]
    return steps.groupBy(*keys).agg(*aggregates)


def bucket(value: Column) -> Column:
    """0..3 by EDGES."""
    return F.when(value < EDGES[0], 0).when(value < EDGES[1], 1).when(value < EDGES[2], 2).when(value.isNotNull(), 3)


def bucketed_mae(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """All four buckets: bucket, n, frac, mae, label_mean, counted. Rows without a prediction don't count."""
    spark = pairs.sparkSession
    known = pairs.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    found = known.groupBy(bucket(F.col(truth)).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(predicted) - F.col(truth))).alias("mae"), F.avg(truth).alias("label_mean"))
    every = spark.range(4).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy())  # over four rows
    return rows.select("bucket", "n", F.try_divide(F.col("n"), total).alias("frac"), "mae", "label_mean", (F.col("n") >= COUNTED).alias("counted"))


def bucket_mean_mae(pairs: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Pooled MAE and the plain mean of the counted buckets' MAE, over all rows or by keys; two levels of aggregation."""
    keys = keys or []
    known = pairs.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    e = F.abs(F.col(predicted) - F.col(truth))
    per = known.groupBy(*keys, bucket(F.col(truth)).alias("bucket")).agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.sum(e).alias("s"))
    out = per.groupBy(*keys).agg(F.avg(F.when(F.col("n") >= COUNTED, F.col("mae"))).alias("bucket_mean_mae"), (F.sum("s") / F.sum("n")).alias("pooled_mae"), F.sum("n").alias("n"))
    return out


def inverse_frequency_weights(df: DataFrame, truth: str) -> DataFrame:
    """``df`` with weight: 1 / bucket count, 0 for buckets that don't count, scaled to a mean of 1.

    The four counts are joined by broadcast; no row moves.
    """
    b = bucket(F.col(truth))
    counts = df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # over five rows at most
    raw = F.when((F.col("n") >= COUNTED) & F.col("bucket").isNotNull(), 1.0 / F.col("n")).otherwise(0.0)
    mean = F.sum(raw * F.col("n")).over(everything) / F.sum("n").over(everything)
    weights = counts.select("bucket", F.coalesce(F.try_divide(raw, mean), F.lit(0.0)).alias("weight"))
    rows = df.withColumn("bucket", b)
    return rows.join(F.broadcast(weights.withColumnRenamed("bucket", "__b")), F.col("bucket").eqNullSafe(F.col("__b")), "left").drop("__b")


def drift_stats(scores: DataFrame, keys: list[str], drift: str, signed: str) -> DataFrame:
    """n, mean, median, p90, max of drift, mean CAE and mean absolute CAE, their ratio and what it says."""
    p = F.percentile(drift, F.array(F.lit(0.5), F.lit(0.9)))
    out = scores.groupBy(*keys).agg(F.count(drift).alias("n"), F.avg(drift).alias("mean"), p.alias("p"), F.max(drift).alias("max"), F.avg(signed).alias("mean_cae"), F.avg(F.abs(signed)).alias("mean_abs_cae"))
    ratio = F.try_divide(F.col("mean_abs_cae"), F.col("mean"))
    reading = F.when(ratio > 0.7, "systematic").when(ratio < 0.3, "scatter").when(ratio.isNotNull(), "mixed")
    return out.select(*keys, "n", "mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"), "max", "mean_cae", "mean_abs_cae", ratio.alias("ratio"), reading.alias("reading"))


def benchmark_band(scores: DataFrame, keys: list[str], duration: str, distance: str, drift: str) -> DataFrame:
    """60 s outages over 800 to 1200 m: n, share under 100 m, mean and median drift, best median first."""
    band = scores.filter((F.col(duration) == 60) & F.col(distance).between(800, 1200))
    out = band.groupBy(*keys).agg(F.count("*").alias("n"), (100 * F.avg((F.col(drift) < 100).cast("double"))).alias("under_100_pct"), F.avg(drift).alias("mean"), F.percentile(drift, 0.5).alias("median"))
    return out.orderBy("median", *keys)


def fraction_negative(df: DataFrame, key: str, columns: str, values: list, signed: str) -> DataFrame:
    """By key, a column a value with the share of negative errors."""
    return df.groupBy(key).pivot(columns, values).agg(F.avg((F.col(signed) < 0).cast("double")))


def tri_state(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, passed, failed, not_applicable for boolean columns that may be null."""
    row = [F.struct(F.lit(k).alias("check"), c.alias("ok")) for k, c in checks.items()]
    rows = df.select(F.explode(F.array(*row)).alias("c")).select("c.*")
    return rows.groupBy("check").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("not_applicable"))


def drift_progress(epochs: DataFrame, run: str, epoch: str, drift: str) -> DataFrame:
    """By run and epoch: n, mean, standard error (ddof 1) and the mean of the last three means."""
    per = epochs.groupBy(run, epoch).agg(F.count(drift).alias("n"), F.avg(drift).alias("mean"), (F.stddev_samp(drift) / F.sqrt(F.count(drift))).alias("se"))
    w = Window.partitionBy(run).orderBy(epoch)
    out = per.withColumns({"ma3": F.avg("mean").over(w.rowsBetween(-2, 0)), "change": F.abs(F.col("mean") - F.lag("mean").over(w))})
    return out.withColumn("within_noise", F.coalesce(F.col("change") <= F.col("se"), F.lit(False)))


def baselines(labels: DataFrame, session: str, role: str, t: str, order: list[str], value: str, train_role: str) -> DataFrame:
    """role, predictor, n, dropped, pooled_mae, bucket_mean_mae of the mean of the training role and of persistence."""
    from tarmac.operators.timeseries import persistence

    rows = persistence(labels, session, t, order, value)
    mean = labels.filter(F.col(role) == train_role).agg(F.avg(value).alias("__m"))
    rows = rows.crossJoin(F.broadcast(mean))  # one row
    both = rows.select(role, F.col(value).alias("y"), F.explode(F.array(F.struct(F.lit("mean").alias("predictor"), F.col("__m").alias("p")), F.struct(F.lit("persistence").alias("predictor"), F.col("y_pred").alias("p")))).alias("x"))
    both = both.select(role, "y", "x.predictor", "x.p")
    missing = both.groupBy(role, "predictor").agg(F.count_if(F.col("p").isNull()).alias("dropped"))
    return bucket_mean_mae(both, "y", "p", [role, "predictor"]).join(missing, [role, "predictor"])
