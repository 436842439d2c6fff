"""Fits and losses: ridge on standardised features, boosted trees, split evaluation, loss terms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Ridge:
    """Coefficients of a ridge fit in standardised features; the intercept is penalised too."""

    def __init__(self, features: list[str], mean: np.ndarray, std: np.ndarray, weights: np.ndarray) -> None:
        self.features, self.mean, self.std, self.weights = features, mean, std, weights

    def predict(self) -> Column:
        """The prediction as an expression, cut at 0."""
        out = F.lit(float(self.weights[-1]))
        for f, m, s, w in zip(self.features, self.mean, self.std, self.weights, strict=False):
            out = out + (F.col(f) - float(m)) / float(s) * float(w)
        return F.greatest(F.lit(0.0), out)


def fit_ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> Ridge:
    """Normal equations from one aggregation; the driver gets a matrix of the features' size."""
    stats = df.agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    mean = np.array([stats[f"m{i}"] for i in range(len(features))])
    std = np.array([stats[f"s{i}"] if stats[f"s{i}"] and stats[f"s{i}"] >= 1e-8 else 1.0 for i in range(len(features))])
    z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mean, std, strict=True)] + [F.lit(1.0)]
    n = len(z)
    sums = df.agg(*(F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(z[i] * F.col(target)).alias(f"b{i}") for i in range(n))).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    return Ridge(features, mean, std, np.linalg.solve(gram + alpha * np.eye(n), np.array([sums[f"b{i}"] for i in range(n)])))


def fit_trees(df: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 4, rate: float = 0.1):
    """Boosted regression trees; ``predict_trees`` cuts their output at 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    boost = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="__p", maxIter=trees, maxDepth=depth, stepSize=rate, seed=3)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), boost]).fit(df)


def predict_trees(model, df: DataFrame, name: str = "prediction") -> DataFrame:
    return model.transform(df).withColumn(name, F.greatest(F.lit(0.0), F.col("__p"))).drop("__x", "__p")


def session_split(df: DataFrame, session: str, share: float = 0.7, seed: int = 0) -> DataFrame:
    """``df`` with in_train: whole sessions on either side, by a seeded hash."""
    return df.withColumn("in_train", F.pmod(F.xxhash64(F.col(session), F.lit(seed)), F.lit(1000)) < int(share * 1000))


def gaussian_nll(mu: Column, log_var: Column, y: Column) -> Column:
    return 0.5 * (log_var + (y - mu) * (y - mu) * F.exp(-log_var))


def stationary_bce(logit: Column, flag: Column, weight: Column) -> Column:
    """Cross entropy with the positives weighed, in the stable form."""
    positive = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    negative = F.log1p(F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0))
    y = flag.cast("double")
    return weight * y * positive + (1 - y) * negative


def losses(rows: DataFrame, session: str, t: str, weights: tuple[float, ...] = (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)) -> DataFrame:
    """One row: nll, bce, kinematic, sideways, yaw, smooth and their weighted total.

    ``rows`` has mu, log_var, y, logit, stationary, weight, accel, yaw_hat, yaw_true.
    Terms over neighbours are kept within a session and gaps of 1.5 s.
    """
    own = Window.partitionBy(session).orderBy(t)
    gap = F.col(t) - F.lag(t).over(own)
    near = gap <= 1.5
    change = F.col("mu") - F.lag("mu").over(own)
    kinematic = F.when(near, F.greatest(F.lit(0.0), F.abs(change) - F.abs(F.col("accel")) * gap) ** 2)
    lateral = F.abs(F.col("mu") * F.sin(F.coalesce("yaw_hat", F.lit(0.0)))) * (F.abs(F.coalesce("yaw_hat", F.lit(0.0))) < 0.02).cast("double")
    terms = {
        "nll": gaussian_nll(F.col("mu"), F.col("log_var"), F.col("y")) * F.col("weight"),
        "bce": stationary_bce(F.col("logit"), F.col("stationary"), F.lit(2.0)),
        "kinematic": kinematic,
        "sideways": lateral,
        "yaw": F.abs(F.col("yaw_hat") - F.col("yaw_true")),
        "smooth": F.when(near, F.abs(change)),
    }
    out = rows.select(*(c.alias(n) for n, c in terms.items())).agg(*(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in terms))
    return out.withColumn("total", sum((w * F.col(n) for n, w in list(zip(terms, weights, strict=True))[1:]), weights[0] * F.col("nll")))


def scenario(yaw_rate: Column, displacement: Column) -> Column:
    """cornering, straight, motorway or other; a null rate is other."""
    r = F.abs(yaw_rate)
    return F.when(r >= 0.05, "cornering").when((r <= 0.02) & (displacement < 25), "straight").when((r <= 0.02) & (displacement >= 25), "motorway").otherwise("other")


def zero_velocity(p: Column, mu: Column, gyro: Column, deviation: Column) -> Column:
    """Whether a window is at rest: likely, slow, not turning and not shaking."""
    return (p > 0.5) & (mu < 1) & (gyro < 0.02) & (deviation < 0.35)


def soft_gate(mu: Column, logit: Column) -> Column:
    return mu * (1 - 1 / (1 + F.exp(-logit)))


def augmented(windows: DataFrame, x: str, channels: int, seed: int = 0, noise: float = 0.02) -> DataFrame:
    """Flat windows turned in the plane of their first two channels by a seeded angle, with seeded noise; the same in every run."""
    angle = (F.pmod(F.xxhash64(F.col(x), F.lit(seed)), F.lit(360_000)) / 1000.0) * (3.141592653589793 / 180)
    jitter = lambda v, i: v + noise * (F.pmod(F.xxhash64(v, i, F.lit(seed)), F.lit(2001)) - 1000) / 1000.0
    rows = windows.withColumn("__a", angle)

    def turned(v: Column, i: Column) -> Column:
        first = v * F.cos("__a") - F.coalesce(F.try_element_at(F.col(x), i + 2), F.lit(0.0)) * F.sin("__a")
        second = F.coalesce(F.try_element_at(F.col(x), F.greatest(i, F.lit(1))), F.lit(0.0)) * F.sin("__a") + v * F.cos("__a")
        return F.when(i % channels == 0, first).when(i % channels == 1, second).otherwise(v)

    return rows.withColumn(x, F.transform(F.transform(x, turned), jitter)).drop("__a")
