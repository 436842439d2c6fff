"""Statistics: histograms, ranks, correlation searches, fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, low, high, n for every bin; left-closed, the last one closed at both ends. One pass, one row a bin shuffled."""
    v = F.col(value)
    index = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        inside = (v >= edges[k]) & ((v <= edges[k + 1]) if k == len(edges) - 2 else (v < edges[k + 1]))
        index = F.when(inside, k).otherwise(index)
    counts = df.groupBy(index.alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")
    every = df.sparkSession.createDataFrame([(k, float(edges[k]), float(edges[k + 1])) for k in range(len(edges) - 1)], "bin int, low double, high double")
    return every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def cut_points(df: DataFrame, value: str, keep: Column | None = None) -> DataFrame:
    """p60 and p90 of the rows to keep."""
    rows = df if keep is None else df.filter(keep)
    q = F.percentile(value, F.array(F.lit(0.6), F.lit(0.9)))
    return rows.agg(q.alias("q"), F.count(value).alias("n")).select(F.col("q")[0].alias("p60"), F.col("q")[1].alias("p90"), "n")


def banded(df: DataFrame, value: str, cuts: DataFrame) -> DataFrame:
    """``df`` with band: low, middle, high by the cut points."""
    v = F.col(value)
    band = F.when(v < F.col("p60"), "low").when(v < F.col("p90"), "middle").when(v.isNotNull(), "high")
    return df.crossJoin(F.broadcast(cuts.select("p60", "p90"))).withColumn("band", band).drop("p60", "p90")  # one row


def average_rank(value: str, partition: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*partition).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    return F.rank().over(w) + (ties - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho over rows that have both values."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"__rx": average_rank(x, keys), "__ry": average_rank(y, keys)})
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__rx", "__ry").alias("rho"))


def checked_correlation(r: Column) -> Column:
    """r, or an error where rounding cannot explain it."""
    return F.when(F.abs(r) > 1 + 1e-9, F.raise_error(F.concat(F.lit("correlation "), r.cast("string")))).otherwise(r)


def lag_correlations(df: DataFrame, session: str, k: str, x: str, y: str, lags: list[int]) -> DataFrame:
    """session, lag, n, r of x at k with y at k + lag, both z-scored over the full series.

    Rows are copied once a lag and meet on the shifted index; the copies carry sums only.
    """
    own = Window.partitionBy(session)
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(own), F.nullif(F.stddev_pop(c).over(own), F.lit(0.0)))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": z(x), "__y": z(y)})
    left = rows.select(session, F.col("__x").alias("zx"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(k).alias("k0")).withColumn("kk", F.col("k0") + F.col("lag"))
    right = rows.select(session, F.col(k).alias("kk"), F.col("__y").alias("zy"))
    out = left.join(right, [session, "kk"]).groupBy(session, "lag").agg(F.count("*").alias("n"), F.avg(F.col("zx") * F.col("zy")).alias("r"))
    return out.withColumn("r", checked_correlation(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))))


def best_lag(correlations: DataFrame, session: str, least: int = 3) -> DataFrame:
    """session, lag, r with the largest |r|; of equals the smallest lag."""
    rows = correlations.filter(F.col("n") >= least)
    best = F.max(F.struct(F.round(F.abs("r"), 9).alias("a"), (-F.col("lag")).alias("l"), F.col("r").alias("r"))).alias("m")
    return rows.groupBy(session).agg(best).select(session, (-F.col("m.l")).alias("lag"), F.col("m.r").alias("r"))


def yaw_search(df: DataFrame, session: str, c1: str, c2: str, y: str, yaws: int = 72) -> DataFrame:
    """session, yaw (index), r: the mount yaw whose rotated channel agrees best with y.

    Six sums per session give the correlation at every yaw; the curves are never formed.
    """
    own = Window.partitionBy(session)
    rows = df.filter(F.col(c1).isNotNull() & F.col(c2).isNotNull() & F.col(y).isNotNull())
    m = rows.select(session, *((F.col(c) - F.avg(c).over(own)).alias(n) for c, n in ((c1, "p"), (c2, "q"), (y, "w"))))
    sums = m.groupBy(session).agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("pp", "pq", "qq", "pw", "qw", "ww")))
    angle = F.col("yaw") * (2 * math.pi / yaws)
    c, s = F.cos(angle), F.sin(angle)
    var = c * c * F.col("pp") + 2 * c * s * F.col("pq") + s * s * F.col("qq")
    r = F.try_divide(c * F.col("pw") + s * F.col("qw"), F.sqrt(F.greatest(var, F.lit(0.0)) * F.col("ww")))
    grid = sums.withColumn("yaw", F.explode(F.sequence(F.lit(0), F.lit(yaws - 1)))).withColumn("r", r).filter("r is not null")
    best = F.max(F.struct(F.round("r", 9).alias("a"), (-F.col("yaw")).alias("l"), F.col("r").alias("r"))).alias("m")
    return grid.groupBy(session).agg(best).select(session, (-F.col("m.l")).alias("yaw"), F.col("m.r").alias("r"))


def lagged_yaw_search(df: DataFrame, session: str, k: str, c1: str, c2: str, y: str, lags: list[int], yaws: int = 72) -> DataFrame:
    """session, lag, yaw, r: the joint search over lag and yaw, from nine sums per lag."""
    left = df.select(session, F.col(c1).alias("p"), F.col(c2).alias("q"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(k).alias("k0")).withColumn("kk", F.col("k0") + F.col("lag"))
    right = df.select(session, F.col(k).alias("kk"), F.col(y).alias("w"))
    met = left.join(right, [session, "kk"]).filter("p is not null and q is not null and w is not null")
    n = F.count("*")
    cov = lambda a, b: (F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n).alias(a + b)
    sums = met.groupBy(session, "lag").agg(n.alias("n"), *(cov(a, b) for a, b in ("pp", "pq", "qq", "pw", "qw", "ww")))
    angle = F.col("yaw") * (2 * math.pi / yaws)
    c, s = F.cos(angle), F.sin(angle)
    var = c * c * F.col("pp") + 2 * c * s * F.col("pq") + s * s * F.col("qq")
    r = F.try_divide(c * F.col("pw") + s * F.col("qw"), F.sqrt(F.nullif(F.greatest(var, F.lit(0.0)) * F.col("ww"), F.lit(0.0))))
    grid = sums.filter("n >= 3").withColumn("yaw", F.explode(F.sequence(F.lit(0), F.lit(yaws - 1)))).withColumn("r", r).filter("r is not null")
    best = F.max(F.struct(F.round("r", 7).alias("a"), (-F.col("lag")).alias("l"), (-F.col("yaw")).alias("w"))).alias("m")
    return grid.groupBy(session).agg(best).select(session, (-F.col("m.l")).alias("lag"), (-F.col("m.w")).alias("yaw"), F.col("m.a").alias("r"))


def least_squares(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """keys, n, r2 and a coefficient b_<x> each, by Cramer's rule on centred sums of up to three predictors."""
    n = F.count("*")
    rows = df.filter(F.col(y).isNotNull())
    for x in xs:
        rows = rows.filter(F.col(x).isNotNull())
    cov = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    pairs = {(i, j): cov(xs[i], xs[j]).alias(f"s{i}{j}") for i in range(len(xs)) for j in range(i, len(xs))}
    sums = rows.groupBy(*keys).agg(n.alias("n"), *pairs.values(), *(cov(x, y).alias(f"t{i}") for i, x in enumerate(xs)), cov(y, y).alias("yy"))
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}")
    matrix = [[s(i, j) for j in range(len(xs))] for i in range(len(xs))]
    right = [F.col(f"t{i}") for i in range(len(xs))]

    def det(m: list) -> Column:
        if len(m) == 1:
            return m[0][0]
        parts = [(-1) ** j * m[0][j] * det([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
        return sum(parts[1:], parts[0])

    d = det(matrix)
    solved = {f"b_{x}": F.try_divide(det([row[:i] + [right[r]] + row[i + 1 :] for r, row in enumerate(matrix)]), F.nullif(d, F.lit(0.0))) for i, x in enumerate(xs)}
    out = sums.withColumns(solved)
    explained = sum((F.col(f"b_{x}") * F.col(f"t{i}") for i, x in enumerate(xs[1:], 1)), F.col(f"b_{xs[0]}") * F.col("t0"))
    return out.select(*keys, "n", F.try_divide(explained, F.nullif("yy", F.lit(0.0))).alias("r2"), *solved)


def distance_offset(curves: DataFrame, session: str, k: str, x: str, y: str, lags: list[int], least: int = 10) -> DataFrame:
    """session, lag, residual: the shift with the least mean absolute difference of two curves; the smallest of equals."""
    left = curves.select(session, F.col(x).alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(k).alias("k0")).withColumn("kk", F.col("k0") + F.col("lag"))
    right = curves.select(session, F.col(k).alias("kk"), F.col(y).alias("y"))
    res = left.join(right, [session, "kk"]).groupBy(session, "lag").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 9).alias("residual")).filter(F.col("n") >= least)
    return res.groupBy(session).agg(F.min(F.struct("residual", "lag")).alias("m")).select(session, F.col("m.lag").alias("lag"), F.col("m.residual").alias("residual"))


def gravity(df: DataFrame, session: str, axes: list[str]) -> DataFrame:
    """Unit vector of the axes' medians by session."""
    med = df.groupBy(session).agg(*(F.percentile(a, 0.5).alias(a) for a in axes))
    norm = F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))
    return med.select(session, *(F.try_divide(F.col(a), norm).alias(f"g_{a}") for a in axes))


def norm_stats(windows: DataFrame, array: str, channels: int) -> DataFrame:
    """channel, n, mean, std (ddof 0, 1 where next to 0) over all values of flat arrays, time-major."""
    rows = windows.select(F.posexplode(array).alias("i", "x")).withColumn("channel", F.col("i") % channels)
    out = rows.groupBy("channel").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def standardised(windows: DataFrame, array: str, stats: DataFrame, channels: int) -> DataFrame:
    """Arrays with each channel centred and scaled; the statistics are one row of ``channels`` pairs, broadcast."""
    pairs = F.array_sort(F.collect_list(F.struct("channel", "mean", "std")))
    one = F.broadcast(stats.filter(F.col("channel") < channels).agg(pairs.alias("__s")))
    scaled = F.transform(array, lambda x, i: (x - F.element_at("__s", (i % channels + 1).cast("int"))["mean"]) / F.element_at("__s", (i % channels + 1).cast("int"))["std"])
    return windows.crossJoin(one).withColumn(array, scaled).drop("__s")


def linear_fit(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def calibrator(df: DataFrame, predicted: str, truth: str, bins: int = 20, least: int = 20) -> DataFrame:
    """bin, n, x, y: quantile bins of the prediction with their means, y made to rise by a running maximum.

    Edges are exact quantiles; the bins are one broadcast row and a bounded aggregation.
    """
    edges = df.agg(F.percentile(predicted, F.array(*(F.lit(k / bins) for k in range(bins + 1)))).alias("e"))
    rows = df.filter(F.col(predicted).isNotNull() & F.col(truth).isNotNull()).crossJoin(F.broadcast(edges))
    index = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.size(F.filter("e", lambda x: x <= F.col(predicted))) - 1))
    means = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg(predicted).alias("x"), F.avg(truth).alias("y")).filter(F.col("n") >= least)
    rising = Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # over ``bins`` rows at most
    return means.withColumn("y", F.max("y").over(rising))


def calibrated(df: DataFrame, predicted: str, knots: DataFrame) -> Column | DataFrame:
    """Predictions through a calibrator: interpolated between knots, clamped at the ends, at least 0."""
    one = F.broadcast(knots.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("__k")))
    p = F.col(predicted)
    below = F.filter("__k", lambda q: q["x"] <= p)
    above = F.filter("__k", lambda q: q["x"] > p)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    inside = a["y"] + (b["y"] - a["y"]) * (p - a["x"]) / (b["x"] - a["x"])
    out = F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(inside)
    return df.crossJoin(one).withColumn("calibrated", F.greatest(F.lit(0.0), F.coalesce(out, p))).drop("__k")


def positive_weight(df: DataFrame, flag: Column) -> DataFrame:
    """negatives / positives; 1 without positives."""
    return df.agg(F.count_if(flag).alias("positives"), F.count_if(~flag).alias("negatives")).withColumn("weight", F.coalesce(F.try_divide(F.col("negatives").cast("double"), F.col("positives")), F.lit(1.0)))
