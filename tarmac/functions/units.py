"""Unit rules, validity predicates and schema comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

G = 9.80665


def valid_fix(lat: Column, lon: Column, t: Column) -> Column:
    """A fix with all parts, and not the 0 that stands for none."""
    return F.coalesce((lat != 0) & (lon != 0) & t.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def plausible(metres: Column, seconds: float, fastest: float = 60.0) -> Column:
    """ok, negative or too fast, for a distance over a time."""
    v = metres / seconds
    return F.when(v < 0, "negative").when(v > fastest, "too fast").when(v.isNotNull(), "ok")


def suspect(lag_ms: Column, r: Column) -> Column:
    """Whether an estimated offset is not to be trusted."""
    return lag_ms.isNull() | F.isnan(lag_ms) | (F.abs(lag_ms) > 500) | F.coalesce(F.abs(r) < 0.3, F.lit(True))


def stationary(speed: Column) -> Column:
    return F.coalesce(speed, F.lit(0.0)) < 0.3


def hz_bucket(hz: Column) -> Column:
    """The first nominal rate within 15 %, unknown, or the rate marked odd."""
    out = F.when(hz.isNull() | F.isnan(hz), "unknown")
    for target in (100, 50, 20, 10, 5, 2, 1):
        out = out.when(F.abs(hz - target) / target < 0.15, f"{target} Hz")
    return out.otherwise(F.concat(F.format_string("%.2f", hz), F.lit(" Hz (odd)")))


def diagnosis(ratio: Column, within: float = 0.2) -> Column:
    """The unit slip that explains a ratio of two values that should agree."""
    out = F.when(ratio.isNull(), "unknown")
    for name, factor in (("g", G), ("3.6", 3.6), ("2", 2.0), ("57.3", math.degrees(1))):
        out = out.when(F.abs(ratio / factor - 1) <= within, name).when(F.abs(ratio * factor - 1) <= within, f"1/{name}")
    return out.otherwise("unknown")


def family_verdicts(df: DataFrame, keys: list[str], family: str, value: str, within: float = 0.25) -> DataFrame:
    """keys, family, median, family_median, flagged: groups whose median strays from their family's."""
    own = df.groupBy(*keys, family).agg(F.percentile(value, 0.5).alias("median"))
    all_ = df.groupBy(family).agg(F.percentile(value, 0.5).alias("family_median"))
    return own.join(F.broadcast(all_), family).withColumn("flagged", F.abs(F.try_divide(F.col("median"), F.col("family_median")) - 1) > within)


def check_latitude(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "no data").when((low >= -90) & (high <= 90), "degrees").when((low >= -5400) & (high <= 5400), "arc minutes").otherwise("unknown")


def check_longitude(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "no data").when((low >= -180) & (high <= 180), "degrees").when((low >= -10800) & (high <= 10800), "arc minutes").otherwise("unknown")


def check_acceleration(median_magnitude: Column) -> Column:
    m = median_magnitude
    return F.when(m.isNull(), "no data").when(m.between(8, 12), "m/s2 with gravity").when(m.between(0.8, 1.2), "g with gravity").when(m < 0.5, "g without gravity").when(m < 5, "m/s2 without gravity").otherwise("unknown")


def check_gyroscope(p99: Column) -> Column:
    return F.when(p99.isNull(), "no data").when(p99 <= 6, "rad/s").when(p99 <= 360, "deg/s").otherwise("unknown")


def check_speed(ratio: Column) -> Column:
    """By reported over derived speed."""
    return F.when(ratio.isNull(), "no data").when(ratio.between(0.8, 1.25), "m/s").when(ratio.between(2.9, 4.5), "km/h").when(ratio.between(1.8, 2.7), "mph").otherwise("unknown")


def check_time(header: str, median_step: Column) -> Column:
    """The header decides; without a word there, the size of the step."""
    h = header.upper()
    if "(MS)" in h or "MILLISEC" in h:
        return F.lit("ms")
    if "SECOND" in h:
        return F.lit("s")
    return F.when(median_step.isNull(), "no data").when(median_step > 10, "ms").otherwise("s")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, min, median, max of numeric columns, in one pass."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    return rows.groupBy("column").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.percentile("v", 0.5).alias("median"), F.max("v").alias("max"))


def schema_differences(headers: DataFrame, name: str, columns: str) -> DataFrame:
    """a, b, only_a, only_b, shared for every pair of distinct headers; one row a distinct header goes in."""
    a = headers.select(F.col(name).alias("a"), F.col(columns).alias("ca"))
    b = headers.select(F.col(name).alias("b"), F.col(columns).alias("cb"))
    rows = a.join(b, F.col("a") < F.col("b"))
    return rows.select("a", "b", F.array_sort(F.array_except("ca", "cb")).alias("only_a"), F.array_sort(F.array_except("cb", "ca")).alias("only_b"), F.size(F.array_intersect("ca", "cb")).alias("shared"))
