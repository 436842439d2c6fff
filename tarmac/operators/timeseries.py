"""Time-series operators: change points, rates, resampling, derivatives, labels.

Every operator takes a DataFrame and column names. Long sessions are cut to
slices (see ``sliced``); missing values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geo
from tarmac.functions.angles import wrap, wrap_step
from tarmac.operators.sliced import WIDTH, asof, asof_all, between, running_sum, with_previous


def change_points(df: DataFrame, session: str, t: str, order: list[str], columns: list[str], width: float = WIDTH) -> DataFrame:
    """Rows in which any of ``columns`` differs from the session's row before; the first row stays."""
    rows = with_previous(df, session, t, order, {c: F.col(c) for c in columns} | {"seen": F.lit(True)}, width)
    moved = F.col("prev_seen").isNull()
    for c in columns:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    return rows.filter(moved).drop("prev_seen", *(f"prev_{c}" for c in columns))


def speed_change_points(df: DataFrame, session: str, t: str, order: list[str], speed: str, least: int = 20) -> DataFrame:
    """Change points of speed in sessions that have ``least`` of them; all rows of the others."""
    rows = with_previous(df, session, t, order, {speed: F.col(speed), "seen": F.lit(True)})
    moved = F.col("prev_seen").isNull() | ~F.col(speed).eqNullSafe(F.col(f"prev_{speed}"))
    counts = rows.withColumn("__moved", moved).groupBy(session).agg(F.count_if("__moved").alias("__n"))
    both = rows.withColumn("__moved", moved).join(counts, session)
    return both.filter(F.col("__moved") | (F.col("__n") < least)).drop("__moved", "__n", "prev_seen", f"prev_{speed}")


def fixes(df: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str) -> DataFrame:
    """Valid fixes (no nulls, no zero coordinates) where the position moved."""
    valid = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(t).isNotNull() & (F.col(lat) != 0) & (F.col(lon) != 0))
    return change_points(valid, session, t, order, [lat, lon])


def tick_rate(df: DataFrame, session: str, t: str, order: list[str], least_ms: float = 20.0, least: int = 20) -> DataFrame:
    """session, ticks, hz = 1000 / median tick, share of ticks under ``least_ms``, mode of rounded ticks, bimodal."""
    rows = with_previous(df, session, t, order, {"t": F.col(t)})
    ms = (F.col(t) - F.col("prev_t")) * 1000
    rows = rows.select(session, ms.alias("ms")).filter("ms is not null")
    tick = F.when(F.col("ms") >= least_ms, F.col("ms"))
    short = F.avg((F.col("ms") < least_ms).cast("double"))
    out = rows.groupBy(session).agg(F.count(tick).alias("ticks"), F.percentile(tick, 0.5).alias("median_ms"), short.alias("short"), F.mode(F.bround("ms"), True).alias("mode_ms"))
    hz = F.when(F.col("ticks") >= least, F.try_divide(F.lit(1000.0), F.col("median_ms")))
    return out.select(session, "ticks", hz.alias("hz"), "mode_ms", ((F.col("short") > 0.2) & (F.col("ticks") >= least)).alias("bimodal"))


def delta_quantiles(df: DataFrame, session: str, t: str, order: list[str]) -> DataFrame:
    """session, n, p05, median, p95 of positive time steps and the rate of the median."""
    rows = with_previous(df, session, t, order, {"t": F.col(t)})
    d = rows.select(session, (F.col(t) - F.col("prev_t")).alias("d")).filter("d > 0")
    out = d.groupBy(session).agg(F.count("*").alias("n"), F.percentile("d", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return out.select(session, "n", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), F.try_divide(F.lit(1.0), F.col("q")[1]).alias("hz"))


def uniform_grid(df: DataFrame, session: str, t: str, step: float) -> DataFrame:
    """session, k, t from each session's first to its last time in steps; integer k is the join key."""
    spans = df.filter(F.col(t).isNotNull()).groupBy(session).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / step)))
    return spans.withColumn("k", k).select(session, "k", (F.col("lo") + F.col("k") * step).alias(t))


def mean_by_time(df: DataFrame, session: str, t: str, value: str) -> DataFrame:
    """One row a time: duplicate times have their mean."""
    return df.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).groupBy(session, t).agg(F.avg(value).alias(value))


def interpolate_all(points: DataFrame, grid: DataFrame, session: str, t: str, values: list[str], clamp: bool = True, width: float = WIDTH) -> DataFrame:
    """``grid`` with each value interpolated linearly, all in one pass; outside a value's samples its end value, or null if not ``clamp``."""
    rest = [c for c in grid.columns if c not in (session, t)]
    own = points.filter(F.col(t).isNotNull()).groupBy(session, t).agg(*(F.avg(c).alias(c) for c in values))  # duplicate times have their mean
    found = asof_all(own, grid, session, t, values, width)
    return found.select(session, t, *rest, *(between(t, F.col(f"{c}_a"), F.col(f"{c}_b"), clamp).alias(c) for c in values))


def interpolate(points: DataFrame, grid: DataFrame, session: str, t: str, value: str, clamp: bool = True, width: float = WIDTH) -> DataFrame:
    """interpolate_all of one value."""
    return interpolate_all(points, grid, session, t, [value], clamp, width)


def sensor_grid(df: DataFrame, grid: DataFrame, session: str, t: str, value: str, least: int = 10) -> DataFrame:
    """A sensor's own valid samples on a grid; null outside them and for sessions with under ``least``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(session).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return interpolate(df.join(counts.select(session), session, "left_semi"), grid, session, t, value, clamp=False)


def derivative(grid: DataFrame, session: str, t: str, k: str, value: str, name: str = "derivative") -> DataFrame:
    """Gradient over unequal steps: three-point inside, one-sided at the ends."""
    own = Window.partitionBy(session).orderBy(k)
    v, x = F.col(value), F.col(t)
    hs, hd = x - F.lag(x).over(own), F.lead(x).over(own) - x
    a, b = F.lag(v).over(own), F.lead(v).over(own)
    inside = F.try_divide(hs * hs * b + (hd * hd - hs * hs) * v - hd * hd * a, hs * hd * (hd + hs))
    first, last = F.try_divide(b - v, hd), F.try_divide(v - a, hs)
    return grid.withColumn(name, F.when(hs.isNull(), first).when(hd.isNull(), last).otherwise(inside))


def cumulative_distance(df: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str, metres=geo.distance) -> DataFrame:
    """Moved fixes with step_m and cum_m; ``metres`` is the distance of two points."""
    moved = fixes(df, session, t, order, lat, lon)
    rows = with_previous(moved, session, t, order, {lat: F.col(lat), lon: F.col(lon)})
    rows = rows.withColumn("step_m", F.coalesce(metres(F.col(f"prev_{lat}"), F.col(f"prev_{lon}"), F.col(lat), F.col(lon)), F.lit(0.0)))
    return running_sum(rows.drop(f"prev_{lat}", f"prev_{lon}"), session, t, order, F.col("step_m"), "cum_m")


def displacement_labels(cumulative: DataFrame, grid: DataFrame, session: str, t: str, window: int, seconds: float, fastest: float = 60.0) -> DataFrame:
    """session, k, d: distance over the next ``window`` grid steps; implausible ones are null with plausible false."""
    at = interpolate(cumulative, grid, session, t, "cum_m")
    own = Window.partitionBy(session).orderBy("k")
    d = F.lead("cum_m", window).over(own) - F.col("cum_m")
    rows = at.withColumn("d", d).filter("d is not null")
    good = (F.col("d") >= 0) & (F.col("d") / seconds <= fastest)
    return rows.select(session, "k", F.when(good, F.col("d")).alias("d"), good.alias("plausible"))


def motion_sum(df: DataFrame, session: str, t: str, order: list[str], a1: str, a2: str) -> DataFrame:
    """Running sum of the horizontal acceleration's magnitude times the step in time."""
    rows = with_previous(df, session, t, order, {"t": F.col(t)})
    step = F.hypot(F.col(a1), F.col(a2)) * (F.col(t) - F.col("prev_t"))
    return running_sum(rows.withColumn("step", step).drop("prev_t"), session, t, order, F.col("step"), "motion")


def normalised(df: DataFrame, session: str, order: str, value: str) -> DataFrame:
    """A curve minus its first value, divided by its last where that isn't next to 0."""
    ends = df.groupBy(session).agg(F.min_by(value, order).alias("__a"), F.max_by(value, order).alias("__b"))
    span = F.col("__b") - F.col("__a")
    rows = df.join(ends, session)
    return rows.withColumn("norm", F.when(F.abs(span) > 1e-12, (F.col(value) - F.col("__a")) / span).otherwise(F.col(value) - F.col("__a"))).drop("__a", "__b")


def yaw_rate(df: DataFrame, session: str, t: str, order: list[str], heading_deg: str, speed: str, hz: float = 10.0, least: float = 5.0) -> DataFrame:
    """Wrapped heading change times the rate; the first change is 0; null under the least speed."""
    rows = with_previous(df, session, t, order, {"h": F.col(heading_deg)})
    step = F.coalesce(wrap(F.radians(F.col(heading_deg)) - F.radians(F.col("prev_h"))), F.lit(0.0))
    return rows.withColumn("yaw_rate", F.when(F.col(speed) >= least, step * hz)).drop("prev_h")


def unwrapped(df: DataFrame, session: str, t: str, order: list[str], angle: Column, name: str = "unwrapped") -> DataFrame:
    """The angle (radians) without jumps: the first one plus the sum of wrapped steps."""
    base = df.withColumn("__a", angle)
    rows = with_previous(base, session, t, order, {"a": F.col("__a")})
    step = F.when(F.col("prev_a").isNull(), F.col("__a")).otherwise(wrap_step(F.col("__a") - F.col("prev_a")))
    return running_sum(rows.withColumn("__step", step), session, t, order, F.col("__step"), name).drop("__a", "__step", "prev_a")


def path_length_km(df: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str) -> DataFrame:
    """session, path_km by equirectangular steps."""
    rows = with_previous(df, session, t, order, {"lat": F.col(lat), "lon": F.col(lon)})
    step = geo.equirectangular(F.col("prev_lat"), F.col("prev_lon"), F.col(lat), F.col(lon))
    return rows.groupBy(session).agg((F.coalesce(F.sum(step), F.lit(0.0)) / 1000).alias("path_km"))


def speed_ratio(df: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str, speed: str, slowest: float = 3.0, least: int = 30) -> DataFrame:
    """session, n, median reported / derived speed over moved fixes; null under ``least`` cases."""
    moved = fixes(df, session, t, order, lat, lon)
    rows = with_previous(moved, session, t, order, {"lat": F.col(lat), "lon": F.col(lon), "t": F.col(t)})
    dt = F.col(t) - F.col("prev_t")
    derived = F.try_divide(geo.equirectangular(F.col("prev_lat"), F.col("prev_lon"), F.col(lat), F.col(lon)), dt)
    rows = rows.withColumns({"dt": dt, "derived": derived}).filter((F.col("dt") > 0) & (F.col("derived") > slowest) & (F.col(speed) > 0))
    out = rows.groupBy(session).agg(F.count("*").alias("n"), F.percentile(F.col(speed) / F.col("derived"), 0.5).alias("ratio"))
    return out.withColumn("ratio", F.when(F.col("n") >= least, F.col("ratio")))


def path_ratio(df: DataFrame, session: str, t: str, order: list[str], lat: str, lon: str, speed: str, low: float = 0.75, high: float = 1.15) -> DataFrame:
    """session, path_m, integral_m, ratio and what the guard says: inflated, deflated, no speed or ok."""
    rows = with_previous(df, session, t, order, {"lat": F.col(lat), "lon": F.col(lon), "t": F.col(t), "v": F.col(speed)})
    step = geo.distance(F.col("prev_lat"), F.col("prev_lon"), F.col(lat), F.col(lon))
    out = rows.groupBy(session).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("path_m"), F.coalesce(F.sum(F.col("prev_v") * (F.col(t) - F.col("prev_t"))), F.lit(0.0)).alias("integral_m"))
    ratio = F.try_divide("path_m", "integral_m")
    verdict = F.when(F.col("ratio").isNull(), "no speed").when(F.col("ratio") > high, "inflated").when(F.col("ratio") < low, "deflated").otherwise("ok")
    return out.withColumn("ratio", ratio).withColumn("verdict", verdict)


def despike(df: DataFrame, session: str, order: str, value: str, half: int, times: float = 3.0) -> DataFrame:
    """Values further than ``times`` the rolling MAD from the rolling median become the median; ends are repeated at the edges."""
    w = Window.partitionBy(session).orderBy(order)
    near = F.collect_list(F.col(value)).over(w.rowsBetween(-half, half))
    i = F.row_number().over(w) - 1
    after = F.count("*").over(Window.partitionBy(session)) - 1 - i
    rows = df.withColumns({"__near": near, "__i": i, "__after": after})
    first, last = F.element_at("__near", 1), F.element_at("__near", -1)
    full = F.concat(F.array_repeat(first, F.greatest(F.lit(0), half - F.col("__i")).cast("int")), F.col("__near"), F.array_repeat(last, F.greatest(F.lit(0), half - F.col("__after")).cast("int")))
    rows = rows.withColumn("__full", full)
    rows = rows.withColumn("__median", F.element_at(F.array_sort("__full"), half + 1))
    rows = rows.withColumn("__mad", F.element_at(F.array_sort(F.transform("__full", lambda x: F.abs(x - F.col("__median")))), half + 1))
    spike = (F.col("__mad") > 1e-9) & (F.abs(F.col(value) - F.col("__median")) > times * F.col("__mad"))
    return rows.withColumns({"is_spike": spike, "clean": F.when(spike, F.col("__median")).otherwise(F.col(value))}).drop("__near", "__i", "__after", "__full", "__median", "__mad")


def busiest_stretch(df: DataFrame, session: str, order: str, value: str, rows_each: int, least: int) -> DataFrame:
    """session, end_row, energy: the stretch of ``rows_each`` rows with the largest sum of absolute changes; the first of equals."""
    w = Window.partitionBy(session).orderBy(order)
    rows = df.withColumn("__dv", F.abs(F.col(value) - F.lag(value).over(w)))
    frame = w.rowsBetween(-(rows_each - 1), 0)
    rows = rows.withColumns({"__e": F.sum("__dv").over(frame), "__n": F.count("__dv").over(frame)}).filter(F.col("__n") >= least)
    return rows.groupBy(session).agg(F.max(F.struct(F.col("__e"), -F.col(order))).alias("__m")).select(session, (-F.col("__m")["col2"]).alias("end_row"), F.col("__m")["__e"].alias("energy"))


def persistence(df: DataFrame, session: str, t: str, order: list[str], value: str, gap: float = 1.0, name: str = "y_pred") -> DataFrame:
    """The value one step earlier, where the row before is exactly ``gap`` away; else null."""
    rows = with_previous(df, session, t, order, {"t": F.col(t), "y": F.col(value)})
    near = F.abs(F.col(t) - F.col("prev_t") - gap) < 1e-6
    return rows.withColumn(name, F.when(near, F.col("prev_y"))).drop("prev_t", "prev_y")


def label_stability(labels: DataFrame, session: str, order: str, value: str, ahead: int = 5, least: int = 50) -> DataFrame:
    """session, n, mean, stability_pct: mean change over ``ahead`` labels as a percentage of the mean label.

    Nulls are left out first, so a gap collapses.
    """
    known = labels.filter(F.col(value).isNotNull())
    rows = known.withColumn("__d", F.abs(F.lead(value, ahead).over(Window.partitionBy(session).orderBy(order)) - F.col(value)))
    out = rows.groupBy(session).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg("__d").alias("__change")).filter(F.col("n") >= least)
    return out.select(session, "n", "mean", (100 * F.try_divide("__change", "mean")).alias("stability_pct"))


def offset_sensitivity(labels: DataFrame, session: str, order: str, value: str, offsets: list[int]) -> DataFrame:
    """session, offset, change_pct: mean change between a label and the one ``offset`` rows on, in percent of the mean."""
    w = Window.partitionBy(session).orderBy(order)
    known = labels.filter(F.col(value).isNotNull())
    moved = F.array(*(F.struct(F.lit(o).alias("offset"), F.abs(F.lead(value, o).over(w) - F.col(value)).alias("d")) for o in offsets))
    rows = known.withColumn("__all", moved).withColumn("__x", F.explode("__all")).groupBy(session, F.col("__x.offset").alias("offset")).agg(F.avg("__x.d").alias("change"))
    means = known.groupBy(session).agg(F.avg(value).alias("mean"))
    return rows.join(means, session).select(session, "offset", (100 * F.try_divide("change", "mean")).alias("change_pct"))


def apply_offset(df: DataFrame, offsets: DataFrame, session: str, t: str) -> DataFrame:
    """Times moved by each session's lag_ms; a session without a lag is an error, never a default."""
    rows = df.join(offsets.select(session, "lag_ms"), session, "left")
    lag = F.when(F.col("lag_ms").isNull() | F.isnan("lag_ms"), F.raise_error(F.concat(F.lit("no lag for session "), F.col(session).cast("string")))).otherwise(F.col("lag_ms"))
    return rows.withColumn(t, F.col(t) - lag / 1000).drop("lag_ms")


def gap_mask(points: DataFrame, grid: DataFrame, session: str, t: str, value: str, gap: float) -> DataFrame:
    """Interpolated values, null where the nearest sample is further than ``gap`` away."""
    near = asof(mean_by_time(points, session, t, value), grid, session, t, value)
    closest = F.least(F.col(t) - F.col("__t0"), F.col("__t1") - F.col(t))
    rest = [c for c in grid.columns if c not in (session, t)]
    return near.select(session, t, *rest, F.when(closest <= gap, between(t, F.struct(F.col("__t0").alias("t"), F.col("__v0").alias("v")), F.struct(F.col("__t1").alias("t"), F.col("__v1").alias("v")))).alias(value))


def rows_zipped(a: DataFrame, b: DataFrame, session: str, row: str) -> DataFrame:
    """Rows of two recordings of a session aligned by row number, as long as both last."""
    return a.join(b, [session, row], "inner")


def wheel_speed(pairs: DataFrame, session: str, reference: str, wheels: list[str], least: float = 2.0) -> DataFrame:
    """Mean wheel rate times the radius, the median of reference / rate where the reference is over ``least``."""
    rate = sum((F.col(w) for w in wheels[1:]), F.col(wheels[0])) / len(wheels)
    rows = pairs.withColumn("__rate", rate)
    radius = rows.filter(F.col(reference) > least).groupBy(session).agg(F.percentile(F.try_divide(F.col(reference), F.col("__rate")), 0.5).alias("radius"))
    return rows.join(radius, session, "left").withColumn("wheel_speed", F.col("__rate") * F.col("radius")).drop("__rate")


def duplicate_times(df: DataFrame, session: str, t: str) -> DataFrame:
    """session, n, share of rows whose time another row has too; counts alone are shuffled."""
    times = df.groupBy(session, t).agg(F.count("*").alias("c"))
    return times.groupBy(session).agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("share"))


def time_regularity(df: DataFrame, session: str, t: str, row: str) -> DataFrame:
    """session, monotone, duplicates: whether time never falls in row order, and how many steps are 0."""
    own = Window.partitionBy(session).orderBy(row)
    rows = df.withColumn("__d", F.col(t) - F.lag(t).over(own))
    return rows.groupBy(session).agg(F.coalesce(F.bool_and(F.col("__d") >= 0), F.lit(True)).alias("monotone"), F.count_if(F.col("__d") == 0).alias("duplicates"))
