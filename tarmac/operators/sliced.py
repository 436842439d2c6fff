"""Window primitives that cut long sessions to time slices.

A window over a whole session puts all of it in one task. Here windows run over
(session, slice) and what must cross a slice border, the last value before it,
the first after it or the sum so far, comes from a table with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a session ordered by time that one slice is expected to hold, by default as a day of time.
WIDTH = 86_400.0


def sliced(df: DataFrame, t: str, width: float = WIDTH) -> DataFrame:
    return df.withColumn("__slice", F.floor(F.col(t) / F.lit(float(width))).cast("long"))


def _window(session: str, order: list) -> Window:
    return Window.partitionBy(session, "__slice").orderBy(*order)


def _slices(session: str, back: bool = False) -> Window:
    return Window.partitionBy(session).orderBy(F.col("__slice").desc() if back else F.col("__slice"))


def with_previous(df: DataFrame, session: str, t: str, order: list[str], columns: dict[str, Column], width: float = WIDTH) -> DataFrame:
    """Adds ``prev_<name>``: each column's value in the session's row before, whatever slice that is in."""
    value = F.struct(*(c.alias(n) for n, c in columns.items()))
    cut = sliced(df, t, width).withColumn("__value", value)
    own = _window(session, [F.col(c) for c in order])
    last = cut.groupBy(session, "__slice").agg(F.max_by("__value", F.struct(*order)).alias("__last"))
    carry = last.withColumn("__carry", F.lag("__last").over(_slices(session))).select(session, "__slice", "__carry")
    rows = cut.withColumn("__prev", F.lag("__value").over(own)).join(carry, [session, "__slice"])
    before = F.coalesce("__prev", "__carry")
    return rows.withColumns({f"prev_{n}": before[n] for n in columns}).drop("__slice", "__value", "__prev", "__carry")


def running_sum(df: DataFrame, session: str, t: str, order: list[str], value: Column, name: str, width: float = WIDTH) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row in its session; null counts as 0."""
    cut = sliced(df, t, width).withColumn("__v", F.coalesce(value, F.lit(0.0)))
    sums = cut.groupBy(session, "__slice").agg(F.sum("__v").alias("__s"))
    before = F.coalesce(F.sum("__s").over(_slices(session).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    base = sums.withColumn("__base", before).select(session, "__slice", "__base")
    inner = F.sum("__v").over(_window(session, [F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = cut.withColumn("__in", inner).join(base, [session, "__slice"])
    return rows.withColumn(name, F.col("__base") + F.col("__in")).drop("__slice", "__v", "__in", "__base")


def asof_all(points: DataFrame, grid: DataFrame, session: str, t: str, values: list[str], width: float = WIDTH) -> DataFrame:
    """For every row of ``grid`` and every value the sample at or before and at or after it: structs (t, v) <value>_a and <value>_b, null where there is none.

    ``points`` has session, t and the values, one row a time; ``grid`` has session,
    t and any other columns. All values share one sort, in which both sides meet.
    """
    rest = [c for c in grid.columns if c not in (session, t)]
    kind, none = grid.select(F.struct(*(rest or [t]))).schema[0].dataType, F.lit(None).cast("struct<t: double, v: double>")
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(t).cast("double").alias("t"), F.col(c).cast("double").alias("v")))
    names = [f"__p{i}" for i in range(len(values))]
    left = points.filter(F.col(t).isNotNull()).select(session, t, *(known(c).alias(n) for c, n in zip(values, names, strict=True)), F.lit(None).cast(kind).alias("__g"), F.lit(False).alias("__is_grid"))
    right = grid.select(session, t, *(none.alias(n) for n in names), F.struct(*(rest or [t])).alias("__g"), F.lit(True).alias("__is_grid"))
    both = sliced(left.unionByName(right), t, width)
    ends = both.groupBy(session, "__slice").agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("first", F.min), ("last", F.max))))
    earlier, later = (_slices(session, back).rowsBetween(Window.unboundedPreceding, -1) for back in (False, True))
    ends = ends.select(session, "__slice", *(F.last(f"{n}_last", ignorenulls=True).over(earlier).alias(f"{n}_before") for n in names), *(F.last(f"{n}_first", ignorenulls=True).over(later).alias(f"{n}_after") for n in names))
    # At equal times samples come before grid points looking back, and after them looking forward.
    back = _window(session, [F.col(t), F.col("__is_grid")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = _window(session, [F.col(t).desc(), F.col("__is_grid")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.select("*", *(F.last(n, ignorenulls=True).over(back).alias(f"{n}_a") for n in names)).select("*", *(F.last(n, ignorenulls=True).over(ahead).alias(f"{n}_b") for n in names))
    rows = rows.filter("__is_grid").join(ends, [session, "__slice"])
    found = [F.coalesce(f"{n}_{x}", f"{n}_{y}").alias(f"{c}_{x}") for c, n in zip(values, names, strict=True) for x, y in (("a", "before"), ("b", "after"))]
    return rows.select(session, t, *(F.col(f"__g.{c}").alias(c) for c in rest), *found)


def asof(points: DataFrame, grid: DataFrame, session: str, t: str, value: str, width: float = WIDTH) -> DataFrame:
    """asof_all of one value, as columns __t0, __v0, __t1, __v1."""
    rest = [c for c in grid.columns if c not in (session, t)]
    found = asof_all(points, grid, session, t, [value], width)
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    return found.select(session, t, *rest, a["t"].alias("__t0"), a["v"].alias("__v0"), b["t"].alias("__t1"), b["v"].alias("__v1"))


def between(t: str, a: Column, b: Column, clamp: bool = True) -> Column:
    """The value at ``t`` between as-of neighbours (structs t, v); outside them the end value, or null if not ``clamp``."""
    inside = F.when(b["t"] == a["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"]))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, inside).otherwise(F.coalesce(a["v"], b["v"])) if clamp else F.when(both, inside)
