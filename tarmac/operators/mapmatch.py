"""Map matching along the road graph: greedy, beam and Viterbi trackers.

An outage meets only the part of the graph it can reach: directions and their
successors are joined to it by start cell and reach, and one task holds one
outage and that part. The trackers are sequential by nature, so they run in a
cogrouped function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Likely top speeds (m/s) by road class.
CLASS_MAX_MS = {
    "motorway": 40.0, "motorway_link": 30.0, "trunk": 36.0, "trunk_link": 25.0, "primary": 30.0, "primary_link": 22.0, "secondary": 27.0, "secondary_link": 20.0,
    "tertiary": 25.0, "tertiary_link": 18.0, "unclassified": 22.0, "residential": 16.0, "living_street": 9.0, "service": 12.0,
}
FLOOR = -60.0


def wrapped(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


@dataclass
class Settings:
    """Tuning of the trackers; angles in radians, lengths in metres."""

    max_turn_mismatch: float = math.radians(75)
    turn_sigma: float = math.radians(20)
    step_turn_sigma: float = math.radians(12)
    min_sigma: float = 1.5
    sigma_scale: float = 1.0
    class_penalty: float = 2.0
    beam: int = 5
    viterbi_beam: int = 12
    quantum: float = 8.0
    hops: int = 200


@dataclass
class Roads:
    """A reachable part of the graph: by direction its length, bearings, class and the directions that follow."""

    length: dict[int, float]
    entry: dict[int, float]
    leave: dict[int, float]
    highway: dict[int, str]
    follows: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, frame: pd.DataFrame) -> Roads:
        by = lambda c: dict(zip(frame["d"].tolist(), frame[c].tolist(), strict=True))
        starts: dict[int, list[int]] = {}
        for d, node, ok in zip(frame["d"].tolist(), frame["d_from"].tolist(), frame["passable"].tolist(), strict=True):
            if ok:
                starts.setdefault(node, []).append(d)
        follows = {d: sorted(starts.get(node, [])) for d, node in zip(frame["d"].tolist(), frame["d_to"].tolist(), strict=True)}
        return cls(by("length"), by("entry"), by("exit"), by("highway"), follows)

    def branches(self, d: int, turn: float, s: Settings) -> list[tuple[int, float]]:
        """Directions to go on with and their log weights, best first at 0: forced ones alone, else those near the observed turn, else the straightest."""
        out = self.follows.get(d, [])
        ahead = [x for x in out if x >> 1 != d >> 1]
        if len(ahead) < 2:
            return [(x, 0.0) for x in (ahead or out[:1])]
        angles = [wrapped(self.leave[x] - self.entry[d]) for x in ahead]
        misses = [abs(wrapped(a - turn)) for a in angles]
        near = sorted((m, k) for k, m in enumerate(misses) if m <= s.max_turn_mismatch)
        if not near:
            return [(ahead[min(range(len(ahead)), key=lambda k: (abs(angles[k]), k))], 0.0)]
        weight = lambda m: -0.5 * (m / s.turn_sigma) ** 2
        return [(ahead[k], weight(m) - weight(near[0][0])) for m, k in near]

    def advance(self, d: int, offset: float, metres: float, turn, s: Settings, fork: bool) -> list[tuple[int, float, float]]:
        """(direction, offset, log weight) after ``metres``; ``turn`` gives the observed turn at a fraction of the step.

        A walk that finds no way on stops at the end of its edge.
        """
        done, open_ = [], [(d, offset, metres, 0.0, 0)]
        while open_:
            d, offset, left, weight, hops = open_.pop()
            room = self.length[d] - offset
            if left < room or hops > s.hops or left <= 0:
                done.append((d, offset + max(left, 0.0) if left < room else offset, weight))
                continue
            left -= max(room, 0.0)
            nexts = self.branches(d, turn(1 - left / metres if metres > 0 else 1.0), s)
            if not nexts:
                done.append((d, self.length[d], weight))
            for n, w in (nexts if fork else nexts[:1])[::-1]:
                open_.append((n, 0.0, left, weight + w, hops + 1))
        return done


def greedy(roads: Roads, start: tuple[int, float], distances: list[float], turns: list[float], s: Settings) -> list[tuple[int, float]]:
    """One position a second, the best branch at each junction."""
    path = [start]
    for metres, turn in zip(distances, turns, strict=True):
        d, offset, _ = roads.advance(*path[-1], metres, lambda _, t=turn: t, s, fork=False)[0]
        path.append((d, offset))
    return path


def beam(roads: Roads, starts: list[tuple[int, float, float]], distances: list[float], turns: list[float], s: Settings) -> list[tuple[int, float]]:
    """All plausible branches, the best hypothesis an edge, ``s.beam`` of them a second."""
    hypotheses = [(w, [(d, o)]) for d, o, w in starts]
    for metres, turn in zip(distances, turns, strict=True):
        best: dict[int, tuple[float, list]] = {}
        for weight, path in hypotheses:
            for d, o, w in roads.advance(*path[-1], metres, lambda _, t=turn: t, s, fork=True):
                if d not in best or weight + w > best[d][0]:
                    best[d] = (weight + w, [*path, (d, o)])
        hypotheses = sorted(best.values(), key=lambda h: (-h[0], h[1][-1]))[: s.beam]
    return hypotheses[0][1]


def emission(observed: float, imposed: float, s: Settings) -> float:
    """Log likelihood of the observed turn where the road turns by ``imposed``."""
    return max(-0.5 * (wrapped(observed - imposed) / s.step_turn_sigma) ** 2, FLOOR)


def transition(travelled: float, predicted: float, sigma: float, s: Settings) -> float:
    """Log likelihood of the road travelled for the predicted distance."""
    return max(-0.5 * ((travelled - predicted) / max(sigma * s.sigma_scale, s.min_sigma)) ** 2, FLOOR)


def class_prior(highway: str | None, speed: float, s: Settings) -> float:
    """Log prior of a speed on a road class: falls by ``class_penalty`` for every multiple of the likely top speed beyond it; classes that aren't listed have none."""
    excess = speed / CLASS_MAX_MS.get(highway or "", math.inf) - 1
    return -s.class_penalty * excess if excess > 0 else 0.0


def viterbi(roads: Roads, starts: list[tuple[int, float, float]], distances: list[float], turns: list[float], sigmas: list[float], s: Settings) -> list[tuple[int, float]]:
    """The most likely path: states by direction and offset quantum, the best ``s.viterbi_beam`` of a second, read back from the best last one.

    The branches' own weights are left out: the emission scores the whole step's turn.
    """
    lattice = [[(w, d, o, -1) for d, o, w in starts]]
    for metres, turn, sigma in zip(distances, turns, sigmas, strict=True):
        best: dict[tuple[int, int], tuple] = {}
        for back, (weight, d, o, _) in enumerate(lattice[-1]):
            for d2, o2, _ in roads.advance(d, o, metres, lambda _, t=turn: t, s, fork=True):
                travelled = abs(o2 - o) if d2 == d else metres
                imposed = wrapped(roads.leave[d2] - roads.leave[d]) if d2 != d else 0.0
                w = weight + transition(travelled, metres, sigma, s) + emission(turn, imposed, s) + class_prior(roads.highway.get(d2), travelled, s)
                key = (d2, int(o2 // s.quantum))
                if key not in best or w > best[key][0]:
                    best[key] = (w, d2, o2, back)
        if not best:
            break
        kept = sorted(best.values(), key=lambda x: (-x[0], x[1], x[2]))[: s.viterbi_beam]
        lattice.append([(w - kept[0][0], d, o, b) for w, d, o, b in kept])
    at = max(range(len(lattice[-1])), key=lambda k: (lattice[-1][k][0], -k))
    path = []
    for states in reversed(lattice):
        _, d, o, at_before = states[at]
        path.append((d, o))
        at = at_before
    path.reverse()
    return path + [path[-1]] * (len(distances) + 1 - len(path))


def reachable(outages: DataFrame, roads: DataFrame, edges: DataFrame, reach: str = "reach", cell: float = 0.01) -> DataFrame:
    """outage and the directions whose edge has a segment in a cell within its reach (metres).

    ``outages`` has outage, lat, lon and the reach; ``edges`` are segments with their ends.
    """
    degrees = F.col(reach) / 110_540.0 + cell
    wide = F.col(reach) / (111_320.0 * F.greatest(F.lit(0.05), F.cos(F.radians("lat")))) + cell
    cells = lambda c, by: F.sequence(F.floor((c - by) / cell), F.floor((c + by) / cell))
    asked = outages.withColumn("cy", F.explode(cells(F.col("lat"), degrees))).withColumn("cx", F.explode(cells(F.col("lon"), wide))).select("outage", "cy", "cx")
    box = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    filed = edges.withColumn("cy", box("lat1", "lat2")).withColumn("cx", box("lon1", "lon2")).select("edge", "cy", "cx").distinct()
    return asked.join(filed, ["cy", "cx"]).select("outage", "edge").distinct().join(roads, "edge")


def track(steps: DataFrame, starts: DataFrame, parts: DataFrame, method: str = "viterbi", settings: Settings | None = None) -> DataFrame:
    """outage, k, d, offset: positions each second from k = 0.

    ``steps`` has outage, k (from 1), distance, turn, sigma; ``starts`` has outage,
    d, offset, weight (several make hypotheses); ``parts`` is reachable(). An outage
    without a start has no rows.
    """
    s = settings or Settings()
    empty = pd.DataFrame({"outage": pd.Series(dtype="int64"), "k": pd.Series(dtype="int64"), "d": pd.Series(dtype="int64"), "offset": pd.Series(dtype="float64")})
    own = starts.select("outage", F.lit(-1).cast("long").alias("k"), F.col("offset").alias("distance"), F.col("weight").alias("turn"), F.lit(0.0).alias("sigma"), "d")
    both = own.unionByName(steps.select("outage", F.col("k").cast("long").alias("k"), "distance", "turn", "sigma", F.lit(None).cast("long").alias("d")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        begin, moves = left[left["k"] < 0].sort_values(["turn", "d"], ascending=[False, True]), left[left["k"] > 0].sort_values("k")
        if begin.empty or right.empty:
            return empty
        roads = Roads.of(right)
        first = [(int(d), float(o), float(w)) for d, o, w in zip(begin["d"], begin["distance"], begin["turn"], strict=True) if int(d) in roads.length]
        if not first:
            return empty
        distances, turns, sigmas = moves["distance"].tolist(), moves["turn"].tolist(), moves["sigma"].tolist()
        if method == "greedy":
            path = greedy(roads, first[0][:2], distances, turns, s)
        elif method == "beam":
            path = beam(roads, first, distances, turns, s)
        else:
            path = viterbi(roads, first, distances, turns, sigmas, s)
        return pd.DataFrame({"outage": int(left["outage"].iloc[0]), "k": np.arange(len(path)), "d": [d for d, _ in path], "offset": [float(o) for _, o in path]})

    kept = parts.select((F.col("outage") + F.lit(0)).alias("outage"), "d", "d_from", "d_to", "passable", "length", "entry", "exit", "highway")
    return both.groupBy("outage").cogroup(kept.groupBy("outage")).applyInPandas(run, "outage long, k long, d long, offset double")


def gyro_sign(blocks: DataFrame, keys: list[str], turn: str, heading_change: str, speed: str, least: int = 60, fast: float = 8.0, clear: float = 0.3) -> DataFrame:
    """keys, slope, sign: sign of the slope of heading change on integrated rate over fast blocks; -1 where it isn't clear."""
    fit = blocks.filter(F.col(speed) > fast).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(heading_change, turn).alias("slope"))
    sure = (F.col("n") >= least) & (F.abs("slope") > clear)
    return fit.select(*keys, "slope", F.when(sure, F.signum("slope")).otherwise(-1.0).alias("sign"))


def teacher_forcing(epoch: F.Column, epochs: int, k: float = 5.0, linear: bool = False) -> F.Column:
    """Probability of using the truth at an epoch; the last epoch has none."""
    p = 1 - epoch / max(epochs - 1, 1) if linear else k / (k + F.exp(epoch / k))
    return F.when(epoch >= epochs - 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def ladder(start: float, step: float, rungs: int) -> list[float]:
    """Values to try around a parameter: start * step ** i for i in -rungs .. rungs but 0."""
    return [start * step**i for i in range(-rungs, rungs + 1) if i]


def coordinate_descent(objective, start: dict[str, float], step: float = 1.5, rungs: int = 2, sweeps: int = 3) -> tuple[dict[str, float], float]:
    """Moves one parameter at a time to its ladder's best rung while that helps.

    ``objective`` takes a list of parameter sets and gives their losses, so a whole
    ladder is one distributed evaluation.
    """
    now, loss = dict(start), objective([start])[0]
    for _ in range(sweeps):
        before = loss
        for name in sorted(start):
            tries = [{**now, name: v} for v in ladder(now[name], step, rungs)]
            found = objective(tries)
            k = min(range(len(tries)), key=lambda i: (found[i], i))
            if found[k] < loss:
                now, loss = tries[k], found[k]
        if loss >= before:
            break
    return now, loss


def settings_losses(candidates: list[Settings], steps: DataFrame, starts: DataFrame, parts: DataFrame, true: DataFrame, roads: DataFrame, segs: DataFrame, method: str = "greedy") -> list[float]:
    """Mean metres between the track of each candidate and the true positions (outage, k, lat, lon): one evaluation for all of them.

    The candidates are a ladder's rungs, so their union stays small.
    """
    from tarmac.functions import geo
    from tarmac.operators.roadgraph import position_at

    tracks = [track(steps, starts, parts, method, s).withColumn("candidate", F.lit(i)) for i, s in enumerate(candidates)]
    every = tracks[0]
    for t in tracks[1:]:
        every = every.unionByName(t)
    at = position_at(every.select(F.struct("candidate", "outage", "k").alias("id"), "d", "offset"), roads, segs).select("id.*", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    off = geo.equirectangular(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))
    found = {r["candidate"]: r["loss"] for r in at.join(true, ["outage", "k"]).groupBy("candidate").agg(F.avg(off).alias("loss")).collect()}
    return [found.get(i, math.inf) for i in range(len(candidates))]


def leave_one_out(objective, groups: list, start: dict[str, float], **search) -> list[tuple]:
    """(group, parameters, loss) of each group: the parameters are fitted on all others pooled, the loss is on the group itself.

    ``objective`` takes a list of parameter sets and a list of groups and gives one loss a set.
    """
    out = []
    for group in groups:
        others = [g for g in groups if g != group]
        best, _ = coordinate_descent(lambda sets, others=others: objective(sets, others), start, **search)
        out.append((group, best, objective([best], [group])[0]))
    return out
