"""Predictors of an outage's seconds from windows, models and forces, and the tables that compare them.

A predictor's output is a relation (session, t0, k, distance, heading), as in
``replay``; all outages are predicted at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.angles import wrap
from tarmac.operators import metrics
from tarmac.operators import roadgraph as rg
from tarmac.operators.sliced import WIDTH, asof
from tarmac.scratch import Scratch

#: Standard gravity in m/s^2.
G = 9.80665
START = ["session", "t0"]


# ---------------------------------------------------------------- at an outage's start


def start_heading(samples: DataFrame, outages: DataFrame, t: str, row: str, heading: str, width: float = WIDTH) -> DataFrame:
    """session, t0, heading0 in radians: the first sample's at or after the start; else the session's first known one, else 0."""
    points = samples.select("session", t, F.col(row).cast("double").alias("__row"))
    at = asof(points, outages.select("session", F.col("t0").alias(t)), "session", t, "__row", width).select("session", F.col(t).alias("t0"), F.col("__v1").alias("__row"))
    own = samples.select("session", F.col(row).cast("double").alias("__row"), F.col(heading).alias("__h"))
    first = samples.groupBy("session").agg(F.min_by(heading, F.when(F.col(heading).isNotNull(), F.col(row))).alias("__f"))
    rows = at.join(own, ["session", "__row"], "left").join(first, "session", "left")
    return rows.select("session", "t0", F.radians(F.coalesce("__h", "__f", F.lit(0.0))).alias("heading0"))


def mount_before(blocks: DataFrame, outages: DataFrame, t: str, forward: str, lateral: str, c1: str, c2: str, weight: str, lookback: float = 180.0, **limits) -> DataFrame:
    """session, t0 and mount_yaw's columns from the blocks of the ``lookback`` seconds before the start: nothing at or after it is read.

    An outage meets the two slices of that length that its past lies in.
    """
    from tarmac.operators.replay import mount_yaw

    cut = F.floor(F.col("t0") / lookback)
    asked = outages.select("session", "t0", F.explode(F.array(cut - 1, cut)).alias("__s"))
    rows = blocks.withColumn("__s", F.floor(F.col(t) / lookback)).join(asked, ["session", "__s"]).filter((F.col(t) < F.col("t0")) & (F.col(t) >= F.col("t0") - lookback))
    found = mount_yaw(rows.withColumn("__key", F.struct("session", "t0")), "__key", forward, lateral, c1, c2, weight, **limits)
    found = found.select(F.col("__key.session").alias("session"), F.col("__key.t0").alias("t0"), "phi", "observable", "phi_safe")
    # Without any block before it an outage's yaw is not observable: 0.
    out = outages.select("session", "t0").join(found, START, "left")
    return out.withColumns({"observable": F.coalesce("observable", F.lit(False)), "phi_safe": F.coalesce("phi_safe", F.lit(0.0))})


# ---------------------------------------------------------------- forces


def forward_acceleration(grid: DataFrame, starts: DataFrame, k: str, rows_a_second: int, h1: str, h2: str) -> DataFrame:
    """session, t0, k, a_fwd of each second: mean force along the mount's direction, null where the grid doesn't cover the second.

    ``starts`` has session, t0, start (grid row), seconds, phi.
    """
    seconds = starts.withColumn("second", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seconds").cast("long") - 1)))
    first = F.col("start") + F.col("second") * rows_a_second
    asked = seconds.withColumn(k, F.explode(F.sequence(first.cast("long"), (first + rows_a_second - 1).cast("long"))))
    met = asked.join(grid.select("session", F.col(k).cast("long").alias(k), h1, h2), ["session", k], "left")
    force = F.col(h1) * F.cos("phi") + F.col(h2) * F.sin("phi")
    out = met.groupBy("session", "t0", "second").agg(F.when(F.count(force) == rows_a_second, F.avg(force)).alias("a_fwd"))
    return out.select("session", "t0", (F.col("second") + 1).alias("k"), "a_fwd")


def speed_fused(inner: DataFrame, forces: DataFrame, **noise) -> DataFrame:
    """A predictor whose distances are fused with the forward force by the scalar filter; headings stay. Its own sigma counts where it has one."""
    from tarmac.operators.replay import speed_fusion

    sigma = F.col("sigma") if "sigma" in inner.columns else F.lit(None).cast("double")
    rows = inner.join(forces, [*START, "k"], "left").select(*START, "k", F.col("distance").alias("mu"), sigma.alias("sigma"), "a_fwd")
    fused = speed_fusion(rows, START, **noise).withColumnRenamed("fused", "distance")
    return inner.drop("distance", "sigma").join(fused, [*START, "k"])


def phone_magnitude(acceleration: list[Column], gravity: list[Column]) -> Column:
    """Length of the acceleration without gravity; null if any part is."""
    return F.sqrt(sum(((a - g) * (a - g) for a, g in zip(acceleration[1:], gravity[1:], strict=True)), (acceleration[0] - gravity[0]) * (acceleration[0] - gravity[0])))


def ecu_magnitude(along: Column, across: Column) -> Column:
    """Length of a horizontal acceleration given in g."""
    return F.hypot(along * G, across * G)


def straight_and_accelerating(windows: DataFrame, keys: list[str], rate: str, h1: str, h2: str, most_rate: float = 0.02, least_force: float = 0.3) -> DataFrame:
    """keys, mean_rate, force, accepted: windows that don't turn and push, on which a mount can be aligned."""
    out = windows.groupBy(*keys).agg(F.avg(F.abs(F.col(rate))).alias("mean_rate"), F.hypot(F.avg(h1), F.avg(h2)).alias("force"))
    return out.withColumn("accepted", (F.col("mean_rate") <= most_rate) & (F.col("force") >= least_force))


# ---------------------------------------------------------------- models


def model_outputs(raw: DataFrame, valid: str = "valid") -> DataFrame:
    """``raw`` (mu, log_var, logit) with mu, sigma and p_stationary; windows that aren't valid have 0, 5 and 0."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    return raw.withColumns({"mu": F.when(ok, F.col("mu")).otherwise(0.0), "sigma": F.when(ok, F.exp(0.5 * F.col("log_var"))).otherwise(5.0), "p_stationary": F.when(ok, 1 / (1 + F.exp(-F.col("logit")))).otherwise(0.0)})


def sigmas(sigma: Column, least: float = 1.5, otherwise: float = 3.0) -> Column:
    """A predictor's own sigma, or a constant where it has none."""
    return F.coalesce(sigma, F.lit(max(least, otherwise)))


def gated(outputs: DataFrame, strict: bool = False) -> DataFrame:
    """``outputs`` with mu and yaw scaled by the chance of moving; ``strict`` stops them wholly where likeliness, speed, turning and shaking all say rest.

    ``outputs`` has mu, yaw, p_stationary and, for ``strict``, gyro and deviation.
    """
    from tarmac.operators.learning import zero_velocity

    moving = F.when(zero_velocity(F.col("p_stationary"), F.col("mu"), F.col("gyro"), F.col("deviation")), 0.0).otherwise(1.0) if strict else 1 - F.col("p_stationary")
    return outputs.withColumn("__moving", moving).withColumns({"mu": F.col("mu") * F.col("__moving"), "yaw": F.col("yaw") * F.col("__moving")}).drop("__moving")


def model_steps(outputs: DataFrame, starts: DataFrame) -> DataFrame:
    """session, t0, k, distance, heading of a model: the heading is the start's and the running turn; an invalid window holds the distance before it.

    ``outputs`` has session, t0, k, mu, yaw, valid; ``starts`` has heading0. One
    outage's seconds are a window.
    """
    own = Window.partitionBy(*START).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = outputs.join(starts.select(*START, "heading0"), START)
    held = F.coalesce(F.last(F.when(F.col("valid"), F.col("mu")), ignorenulls=True).over(own), F.lit(0.0))
    turn = F.sum(F.when(F.col("valid"), F.col("yaw")).otherwise(0.0)).over(own)
    return rows.select(*START, "k", held.alias("distance"), (F.col("heading0") + turn).alias("heading"))


def displacements(primed: DataFrame, demanded: DataFrame) -> DataFrame:
    """session, t0, k, distance: what was predicted beforehand, else what was asked for now."""
    a, b = primed.select(*START, "k", F.col("distance").alias("__a")), demanded.select(*START, "k", F.col("distance").alias("__b"))
    return a.join(b, [*START, "k"], "full").select(*START, "k", F.coalesce("__a", "__b").alias("distance"))


def probe_replay(windows: DataFrame, prediction: Column, starts: DataFrame, rate: str | None = None) -> DataFrame:
    """A window predictor replayed over outages: 0 metres where the window isn't valid; the heading is held, or follows the rate of each window's last second."""
    ok = F.coalesce(F.col("valid"), F.lit(False))
    mu = F.when(ok, F.greatest(F.lit(0.0), prediction)).otherwise(0.0)
    own = Window.partitionBy(*START).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.lit(0.0) if rate is None else F.sum(F.when(ok, F.col(rate)).otherwise(0.0)).over(own)
    rows = windows.join(starts.select(*START, "heading0"), START)
    return rows.select(*START, "k", mu.alias("distance"), (F.col("heading0") + turn).alias("heading"))


def assembled(windows: DataFrame, x: str, mean: list[float], std: list[float], dropped: dict[int, float] | None = None, rate: int | None = None) -> DataFrame:
    """Flat windows made ready for a model: each channel standardised and, if ``dropped``, scaled; ``turn`` is the channel ``rate`` of the result."""
    n = len(mean)
    scale = [(dropped or {}).get(c, 1.0) for c in range(n)]
    at = lambda values, i: F.element_at(F.array(*(F.lit(float(v)) for v in values)), (i % n + 1).cast("int"))
    out = windows.withColumn(x, F.transform(x, lambda v, i: (v - at(mean, i)) / at(std, i) * at(scale, i)))
    return out if rate is None else out.withColumn("turn", F.filter(x, lambda _, i: i % n == rate))


def linear_prediction(x: str, weights: list[float], bias: float) -> Column:
    """A linear model over a flat window, as an expression: batches are the engine's."""
    products = F.zip_with(x, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(bias)), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


# ---------------------------------------------------------------- roads at a point


def candidates(points: DataFrame, segs: DataFrame, roads: DataFrame, radius: float, keep: int = 3, tolerance: float = math.radians(60), weight: float = 20.0) -> DataFrame:
    """id, d, offset, distance, score, rank: up to ``keep`` edges at each point (id, lat, lon, heading), each in its better direction.

    More edges are fetched than kept, since the bearing gate rejects some; a point
    whose roads are all rejected has them without the gate. They rank by distance
    and a mild penalty for their bearing; ``distance`` is the plain one.
    """
    near = rg.nearest_edges(points, segs, radius, max(4 * keep, 12)).select("id", "edge", "distance", F.col("offset").alias("__o")).join(points.select("id", "heading"), "id")
    rows = near.join(roads.filter("passable").select("d", "edge", "reverse", "length"), "edge")
    along = F.when(F.col("reverse"), F.col("length") - F.col("__o")).otherwise(F.col("__o"))
    rows = rows.withColumn("offset", F.greatest(F.lit(0.0), F.least(F.col("length"), along)))
    bearing = segs.groupBy("edge").agg(F.array_sort(F.collect_list(F.struct("cum", "metres", "lat1", "lon1", "lat2", "lon2"))).alias("__s"))
    rows = rows.join(bearing, "edge")
    last = F.element_at(F.filter("__s", lambda s: s["cum"] <= F.col("__o") + 1e-9), -1)
    rows = rows.withColumn("__b", rg.geo.azimuth(last["lat1"], last["lon1"], last["lat2"], last["lon2"]))
    off = F.abs(wrap(F.when(F.col("reverse"), F.col("__b") + F.pi()).otherwise(F.col("__b")) - F.col("heading")))
    rows = rows.withColumn("off", off).withColumn("__gated", F.coalesce(F.col("off") <= tolerance, F.lit(False)))
    rows = rows.withColumn("__any", F.bool_or("__gated").over(Window.partitionBy("id"))).filter("__gated or not __any")
    rows = rows.withColumn("score", F.col("distance") + F.when(F.col("__any"), weight * F.col("off") / F.pi()).otherwise(0.0))
    best = rows.groupBy("id", "edge").agg(F.min(F.struct("score", "d", "offset", "distance")).alias("m")).select("id", "edge", "m.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("score", "edge")))
    return ranked.filter(F.col("rank") <= keep).select("id", "edge", "d", "offset", "distance", "score", "rank")


def start_hypotheses(found: DataFrame, radius: float, keep: int = 3) -> DataFrame:
    """id, d, offset, weight: the ``keep`` nearest candidates, sorted before they are cut, with log weights -distance / radius that begin at 0."""
    own = Window.partitionBy("id")
    rows = found.withColumn("__k", F.row_number().over(own.orderBy("distance", "d"))).filter(F.col("__k") <= keep)
    return rows.select("id", "d", "offset", ((F.min("distance").over(own) - F.col("distance")) / max(radius, 1e-6)).alias("weight"))


def rematched_track(steps: DataFrame, starts: DataFrame, parts: DataFrame, segs: DataFrame, roads: DataFrame, seconds: int, radius: float, every: int = 10, settings=None) -> DataFrame:
    """outage, k, d, offset of the greedy tracker, matched again to the roads every ``every`` seconds unless the match is ambiguous.

    All outages go on together: a round tracks ``every`` seconds of each, places
    their ends and looks their candidates up, so there are seconds / every rounds.
    Each round is written, so its plan does not grow with the rounds before it.
    """
    from tarmac.operators.mapmatch import track
    from tarmac.operators.reports import ambiguous

    scratch = Scratch(steps.sparkSession, "rematch")
    parts, segs, roads = scratch.write("parts", parts), scratch.write("segments", segs), scratch.write("roads", roads)
    now, out = starts.select("outage", "d", "offset", "weight"), None
    for begin in range(0, seconds, every):
        own = steps.filter((F.col("k") > begin) & (F.col("k") <= begin + every)).withColumn("k", F.col("k") - begin)
        path = scratch.write(f"path-{begin}", track(own, now, parts, "greedy", settings))
        shown = path.filter("k > 0" if begin else "k >= 0").withColumn("k", F.col("k") + begin)
        ends = path.filter(F.col("k") == every).select(F.col("outage").alias("id"), "d", "offset")
        if begin + every <= seconds and ends.limit(1).count():
            at = rg.position_at(ends, roads, segs)
            found = candidates(at.select("id", "lat", "lon", F.col("bearing").alias("heading")), segs, roads, radius)
            clear = ambiguous(found, "id", "edge", "distance").filter(~F.col("ambiguous")).select("id")
            best = found.filter("rank = 1").join(clear, "id", "left_semi").select("id", F.col("d").alias("__d"), F.col("offset").alias("__o"))
            ends = ends.join(best, "id", "left").select(F.col("id").alias("outage"), F.coalesce("__d", "d").alias("d"), F.coalesce("__o", "offset").alias("offset"))
            ends = scratch.write(f"ends-{begin}", ends)
            moved = ends.select("outage", F.lit(begin + every).cast("long").alias("k"), "d", "offset")
            shown = shown.join(moved.select("outage", "k"), ["outage", "k"], "left_anti").select("outage", "k", "d", "offset").unionByName(moved)
            now = ends.withColumn("weight", F.lit(0.0))
        else:
            now = now.limit(0)
        out = shown if out is None else out.unionByName(shown)
    return out


# ---------------------------------------------------------------- comparisons


def predictor_names(inner: DataFrame, backends: DataFrame, trackers: DataFrame) -> DataFrame:
    """name, inner, backend, tracker: every predictor alone and under every tracker and backend; all three tables are lists of names."""
    wrapped = inner.crossJoin(F.broadcast(backends)).crossJoin(F.broadcast(trackers))
    named = wrapped.select(F.concat_ws("_", "tracker", F.lit("matched"), "backend", "inner").alias("name"), "inner", "backend", "tracker")
    none = F.lit(None).cast("string")
    return inner.select(F.col("inner").alias("name"), "inner", none.alias("backend"), none.alias("tracker")).unionByName(named)


def ablation(scores: DataFrame, variant: str, drift: str) -> DataFrame:
    """One row a variant: n, mean, median, p90, share under 100 m, and how many outages were skipped (no drift)."""
    d = F.col(drift)
    out = scores.groupBy(variant).agg(F.count(d).alias("n"), F.avg(d).alias("mean_m"), F.percentile(d, F.array(F.lit(0.5), F.lit(0.9))).alias("p"), (100 * F.avg((d < 100).cast("double"))).alias("pct_under_100m"), F.count_if(d.isNull()).alias("skipped"))
    return out.filter("n > 0").select(variant, "n", "mean_m", F.col("p")[0].alias("median_m"), F.col("p")[1].alias("p90_m"), "pct_under_100m", "skipped")


def windowed_metrics(pairs: DataFrame, run: str, role: str, truth: str, predicted: str) -> DataFrame:
    """run, role, bucket-mean and pooled MAE of each run's windows on each split."""
    return metrics.bucket_mean_mae(pairs, truth, predicted, [run, role])


def drift_rows(totals: DataFrame, keys: list[str], distance: str, seconds: float, drift: str, signed: str) -> DataFrame:
    """keys, bucket (of the outage's mean speed), n, mean drift and mean signed error, by variant."""
    rows = totals.withColumn("bucket", metrics.bucket(F.col(distance) / seconds))
    return rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.avg(drift).alias("crse"), F.avg(signed).alias("cae"))


def evaluation(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: pooled and bucket-mean MAE and the MAE of each bucket."""
    e = F.abs(F.col(predicted) - F.col(truth))
    b = metrics.bucket(F.col(truth))
    per = pairs.agg(*(F.avg(F.when(b == k, e)).alias(f"mae_{k}") for k in range(4)))
    return metrics.bucket_mean_mae(pairs, truth, predicted).select("pooled_mae", "bucket_mean_mae").crossJoin(per)  # one row each


def scenario_mae(windows: DataFrame, keys: list[str], rate: Column, truth: str, predicted: str, least: int = 30) -> DataFrame:
    """keys, scenario, n, mae, bias, label_mean for scenarios of ``least`` windows or more; other windows have none."""
    from tarmac.operators.learning import scenario

    e = F.col(predicted) - F.col(truth)
    rows = windows.withColumn("scenario", scenario(rate, F.col(truth))).filter("scenario <> 'other'")
    out = rows.groupBy(*keys, "scenario").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.avg(truth).alias("label_mean"))
    return out.filter(F.col("n") >= least)


def split_sessions(windows: DataFrame, catalogue: DataFrame, roles: list[str], family: str = "S") -> DataFrame:
    """session, role, windows, note: the sessions of the wanted roles and family with their usable windows, and those without any."""
    wanted = catalogue.filter(F.col("role").isin(roles) & (F.col("family") == family)).select("session", "role")
    n = windows.filter("keep").groupBy("session").agg(F.count("*").alias("windows"))
    rows = wanted.join(n, "session", "left").withColumn("windows", F.coalesce("windows", F.lit(0)).cast("long"))
    return rows.withColumn("note", F.when(F.col("windows") == 0, "no usable windows"))


def rate_regimes(windows: DataFrame, regime: str, session: str, features: list[str], truth: str, in_train: Column, least_windows: int = 100, least_sessions: int = 4) -> DataFrame:
    """regime, sessions fitted and evaluated, windows, MAE of the mean and of a ridge fit, improvement; regimes of too few sessions are noted.

    Sessions go whole to one side. The regimes are few: one small fit each.
    """
    from tarmac.operators.learning import fit_ridge

    spark = windows.sparkSession
    sizes = windows.groupBy(regime, session).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least_windows)
    rows = windows.join(sizes.drop("__n"), [regime, session], "left_semi").withColumn("__train", in_train)
    many = {r[0]: r[1] for r in sizes.groupBy(regime).agg(F.count("*")).collect()}
    out = []
    for name in sorted(r[0] for r in windows.select(regime).distinct().collect()):
        own = rows.filter(F.col(regime) == name)
        if many.get(name, 0) < least_sessions:
            out.append((name, 0, 0, 0, None, None, None, "too few sessions"))
            continue
        train, rest = own.filter("__train"), own.filter("not __train")
        model = fit_ridge(train, features, truth)
        mean = train.agg(F.avg(truth)).first()[0]
        e = rest.agg(F.countDistinct(session), F.count("*"), F.avg(F.abs(F.col(truth) - mean)), F.avg(F.abs(model.predict() - F.col(truth)))).first()
        out.append((name, train.select(session).distinct().count(), e[0], e[1], e[2], e[3], 100 * (1 - e[3] / e[2]) if e[2] else None, None))
    return spark.createDataFrame(out, f"`{regime}` string, n_sessions_fit long, n_sessions_eval long, n_windows_eval long, mean_mae_m double, ridge_mae_m double, ridge_improvement_pct double, note string")
