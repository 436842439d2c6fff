"""Windows over grids and outages: sliding windows, blocks, thirds, outage starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_windows(grid: DataFrame, session: str, k: str, channels: list[str], width: int, stride: int, label_ahead: int = 0, carry: list[str] | None = None) -> DataFrame:
    """session, start, X (flat, time-major) and ``carry`` read at row start + width, starts while start < n - width - label_ahead.

    One window expression over the session; only the rows at which a window ends survive.
    """
    own = Window.partitionBy(session).orderBy(k)
    values = F.array(*(F.col(c).cast("double") for c in channels))
    rows = grid.withColumns({"__x": F.collect_list(values).over(own.rowsBetween(-width, -1)), "__n": F.count("*").over(Window.partitionBy(session)), "__i": F.row_number().over(own) - 1})
    start = F.col("__i") - width
    rows = rows.withColumn("start", start).filter((F.col("start") >= 0) & (F.col("start") % stride == 0) & (F.col("start") < F.col("__n") - width - label_ahead))
    return rows.select(session, "start", F.flatten("__x").alias("X"), *(carry or []))


def complete(windows: DataFrame, label: str | None = None) -> DataFrame:
    """``windows`` with keep: the label is known and every sample finite."""
    fine = F.forall("X", lambda x: x.isNotNull() & ~F.isnan(x))
    return windows.withColumn("keep", fine & F.col(label).isNotNull() if label else fine)


def validation_windows(grid: DataFrame, session: str, k: str, value: str, width: int) -> DataFrame:
    """session, k, variance of the value over the window that ends before k, and the change over the window before and after."""
    own = Window.partitionBy(session).orderBy(k)
    frame = own.rowsBetween(-width, -1)
    rows = grid.withColumns({"variance": F.var_pop(value).over(frame), "__c": F.count(value).over(frame), "previous": F.col(value) - F.lag(value, width).over(own), "following": F.lead(value, width).over(own) - F.col(value)})
    return rows.filter(F.col("__c") == width).select(session, k, "variance", "previous", "following")


def outage_starts(spans: DataFrame, session: str, low: str, high: str, duration: float, step: float | None = None) -> DataFrame:
    """session, j, t0 = low + j * step (the duration by default) while t0 <= high - duration; none for shorter spans."""
    step = step or duration
    last = F.floor((F.col(high) - F.col(low) - duration) / step)
    rows = spans.filter(F.col(high) - F.col(low) >= duration)
    return rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(session, "j", (F.col(low) + F.col("j") * step).alias("t0"))


def evenly_spaced(df: DataFrame, session: str, order: str, count: int, rounded: bool = True) -> DataFrame:
    """The rows of each session at ``count`` evenly spaced indices, rounded or cut down; all rows of shorter sessions."""
    n = F.count("*").over(Window.partitionBy(session))
    rows = df.withColumns({"__i": F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1, "__n": n})
    at = lambda j: j * (F.col("__n") - 1) / F.lit(float(max(count - 1, 1)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: (F.bround(at(j)) if rounded else F.floor(at(j))).cast("int"))
    return rows.filter((F.col("__n") <= count) | F.array_contains(picks, F.col("__i"))).drop("__i", "__n")


def blocks(grid: DataFrame, session: str, k: str, size: int, aggregates: dict[str, Column]) -> DataFrame:
    """session, block, aggregates over tumbling blocks of ``size`` steps; incomplete ones go."""
    rows = grid.groupBy(session, F.floor(F.col(k) / size).alias("block")).agg(F.count("*").alias("__n"), *(c.alias(n) for n, c in aggregates.items()))
    return rows.filter(F.col("__n") == size).drop("__n")


def trailing_mean(grid: DataFrame, session: str, k: str, value: str, width: int) -> DataFrame:
    """``grid`` with the mean of the ``width`` rows before each, null where there are fewer."""
    frame = Window.partitionBy(session).orderBy(k).rowsBetween(-width, -1)
    return grid.withColumn("trailing", F.when(F.count(value).over(frame) == width, F.avg(value).over(frame)))


def turn_between(grid: DataFrame, session: str, k: str, rate: str, hz: float, width: int, lead: int = 0, sign: float = 1.0) -> DataFrame:
    """``grid`` with the turn (rate / hz summed) over the ``width`` rows up to ``lead`` rows on."""
    frame = Window.partitionBy(session).orderBy(k).rowsBetween(lead - width, lead - 1)
    return grid.withColumn("turn", F.sum(F.col(rate) / hz).over(frame) * sign)


def thirds(df: DataFrame, session: str, order: str) -> DataFrame:
    """``df`` with third: 0, 1 or 2 by floor(n / 3) rows each; the remainder is null."""
    size = F.floor(F.count("*").over(Window.partitionBy(session)) / 3)
    i = F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1
    rows = df.withColumns({"__s": size, "__i": i})
    return rows.withColumn("third", F.when(F.col("__i") < 3 * F.col("__s"), F.floor(F.col("__i") / F.col("__s")))).drop("__s", "__i")


def window_features(windows: DataFrame, x: str, channels: int) -> DataFrame:
    """``windows`` with features: per channel mean, deviation (ddof 0), mean absolute value and mean absolute step."""
    out = []
    for c in range(channels):
        out.append(F.transform(F.sequence(F.lit(c), F.size(x) - 1, F.lit(channels)), _picker(x)))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, y: s + f(y))
    per = []
    for v in out:
        n = F.size(v)
        mean = total(v, lambda y: y) / n
        square = total(v, lambda y: y * y) / n
        steps = F.zip_with(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda a, b: F.abs(a - b))
        per += [mean, F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)), total(v, F.abs) / n, F.try_divide(total(steps, lambda y: y), n - 1)]
    return windows.withColumn("features", F.array(*per))


def _picker(x: str):
    return lambda i: F.element_at(x, i + 1).cast("double")
