"""The road graph as relations: nodes, edges split at junctions, segments, directed edges.

Nearest-road search is an equi-join on grid cells. A segment is filed under every
cell of its bounding box, so a point finds it from the cells within the radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geo
from tarmac.functions.angles import wrap

CELL = 0.01


def split_at_junctions(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge, refs, oneway, highway: ways (way, refs, oneway, highway) cut at nodes used twice or more and at their ends.

    References to nodes that aren't there go first. An edge is named way * 10000 + part.
    """
    rows = ways.select("way", "oneway", "highway", F.posexplode("refs").alias("i", "node")).join(nodes.select("node"), "node")
    uses = rows.groupBy("node").agg(F.count("*").alias("uses"))
    own = Window.partitionBy("way").orderBy("i")
    rows = rows.join(uses, "node").withColumns({"at": F.row_number().over(own), "n": F.count("*").over(Window.partitionBy("way"))})
    cut = (F.col("uses") >= 2) & (F.col("at") > 1) & (F.col("at") < F.col("n"))
    rows = rows.withColumn("cut", cut).withColumn("part", F.sum(F.col("cut").cast("int")).over(own))
    # A node at a cut ends one part and begins the next.
    both = rows.withColumn("p", F.explode(F.when(F.col("cut"), F.array(F.col("part") - 1, F.col("part"))).otherwise(F.array("part"))))
    parts = both.groupBy("way", "p", "oneway", "highway").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("x"))
    refs = F.transform("x", lambda s: s["node"])
    return parts.select((F.col("way") * 10_000 + F.col("p")).alias("edge"), refs.alias("refs"), "oneway", "highway").filter(F.size("refs") > 1)


def segments(edges: DataFrame, nodes: DataFrame, metres=geo.distance) -> DataFrame:
    """edge, i, from_node, to_node, lat1, lon1, lat2, lon2, metres, cum (metres before the segment)."""
    steps = F.transform(F.sequence(F.lit(1), F.size("refs") - 1), lambda i: F.struct(i.alias("i"), F.element_at("refs", i).alias("a"), F.element_at("refs", i + 1).alias("b")))
    rows = edges.select("edge", F.explode(steps).alias("s")).select("edge", "s.*")
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("lat").alias("lat1" if k == "a" else "lat2"), F.col("lon").alias("lon1" if k == "a" else "lon2"))
    rows = rows.join(at("a"), "a").join(at("b"), "b").withColumn("metres", metres(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    run = Window.partitionBy("edge").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("edge", "i", F.col("a").alias("from_node"), F.col("b").alias("to_node"), "lat1", "lon1", "lat2", "lon2", "metres", F.coalesce(F.sum("metres").over(run), F.lit(0.0)).alias("cum"))


def directed(edges: DataFrame, segs: DataFrame) -> DataFrame:
    """d, edge, reverse, d_from, d_to, passable, length, entry (bearing on arrival), exit (bearing on departure), highway.

    Direction d is 2 * edge forward and 2 * edge + 1 in reverse, which a one-way edge forbids.
    """
    bearing = geo.azimuth(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    ends = segs.withColumn("b", bearing).groupBy("edge").agg(F.sum("metres").alias("length"), F.min_by("b", "i").alias("first"), F.max_by("b", "i").alias("last"), F.min_by("from_node", "i").alias("a"), F.max_by("to_node", "i").alias("z"))
    rows = edges.select("edge", "oneway", "highway").join(ends, "edge")
    forward = rows.select((F.col("edge") * 2).alias("d"), "edge", F.lit(False).alias("reverse"), F.col("a").alias("d_from"), F.col("z").alias("d_to"), F.lit(True).alias("passable"), "length", F.col("last").alias("entry"), F.col("first").alias("exit"), "highway")
    back = rows.select((F.col("edge") * 2 + 1).alias("d"), "edge", F.lit(True).alias("reverse"), F.col("z").alias("d_from"), F.col("a").alias("d_to"), (~F.col("oneway")).alias("passable"), "length", wrap(F.col("first") + F.pi()).alias("entry"), wrap(F.col("last") + F.pi()).alias("exit"), "highway")
    return forward.unionByName(back)


def successors(roads: DataFrame) -> DataFrame:
    """d, next, turn: passable directions out of each direction's end, without U-turns, and the turn onto them."""
    out = roads.filter("passable").select(F.col("d").alias("next"), F.col("edge").alias("next_edge"), F.col("d_from").alias("node"), F.col("exit").alias("leaves"))
    rows = roads.filter("passable").join(out, F.col("d_to") == F.col("node")).filter("edge <> next_edge")
    return rows.select("d", "next", wrap(F.col("leaves") - F.col("entry")).alias("turn"))


def position_at(points: DataFrame, roads: DataFrame, segs: DataFrame) -> DataFrame:
    """``points`` (id, d, offset) with lat, lon and bearing: the offset, cut to the edge, along its direction."""
    rows = points.join(roads.select("d", "edge", "reverse", "length"), "d")
    cut = F.greatest(F.lit(0.0), F.least(F.col("offset"), F.col("length")))
    rows = rows.withColumn("along", F.when(F.col("reverse"), F.col("length") - cut).otherwise(cut))
    met = rows.join(segs, "edge").filter((F.col("cum") <= F.col("along") + 1e-9) & (F.col("along") <= F.col("cum") + F.col("metres") + 1e-9))
    one = met.groupBy("id", "d", "offset", "reverse", "along").agg(F.max(F.struct("cum", "metres", "lat1", "lon1", "lat2", "lon2")).alias("s"))
    f = F.coalesce(F.try_divide(F.col("along") - F.col("s.cum"), F.col("s.metres")), F.lit(0.0))
    bearing = geo.azimuth(F.col("s.lat1"), F.col("s.lon1"), F.col("s.lat2"), F.col("s.lon2"))
    return one.select("id", "d", "offset", (F.col("s.lat1") + (F.col("s.lat2") - F.col("s.lat1")) * f).alias("lat"), (F.col("s.lon1") + (F.col("s.lon2") - F.col("s.lon1")) * f).alias("lon"), F.when(F.col("reverse"), wrap(bearing + F.pi())).otherwise(bearing).alias("bearing"))


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def nearest_edges(points: DataFrame, segs: DataFrame, radius: float, limit: int = 8, cell: float = CELL) -> DataFrame:
    """id, edge, distance, offset, rank: for each point (id, lat, lon) the nearest distinct edges within ``radius`` metres."""
    box = [F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), F.least("lon1", "lon2"), F.greatest("lon1", "lon2")]
    filed = segs.withColumn("cy", F.explode(_cells(box[0], box[1], cell))).withColumn("cx", F.explode(_cells(box[2], box[3], cell)))
    dlat, dlon = radius / geo.METRES_LAT, radius / (geo.METRES_LON * F.greatest(F.lit(0.01), F.cos(F.radians("lat"))))
    asked = points.select("id", "lat", "lon").withColumn("cy", F.explode(_cells(F.col("lat") - dlat, F.col("lat") + dlat, cell))).withColumn("cx", F.explode(_cells(F.col("lon") - dlon, F.col("lon") + dlon, cell)))
    hit = geo.segment(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    met = asked.join(filed, ["cy", "cx"]).withColumn("hit", hit).filter(F.col("hit.distance") <= radius)
    best = met.groupBy("id", "edge").agg(F.min(F.struct(F.col("hit.distance").alias("distance"), "i", (F.col("cum") + F.col("hit.fraction") * F.col("metres")).alias("offset"))).alias("b"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("b.distance", "edge")))
    return ranked.filter(F.col("rank") <= limit).select("id", "edge", F.col("b.distance").alias("distance"), F.col("b.offset").alias("offset"), "rank")


def snapped(points: DataFrame, segs: DataFrame, roads: DataFrame, radius: float, tolerance: float = 1.0471975511965976, weight: float = 20.0) -> DataFrame:
    """id, d, offset, distance, score: the passable direction next to a point (id, lat, lon, heading in radians) that agrees with its heading.

    The score adds ``weight`` metres for a full reversal; directions off by over ``tolerance`` don't count.
    """
    near = nearest_edges(points, segs, radius, 32).join(points.select("id", "heading"), "id")
    both = near.join(roads.filter("passable").select("d", "edge", "reverse", "length"), "edge")
    both = both.withColumn("along", F.when(F.col("reverse"), F.col("length") - F.col("offset")).otherwise(F.col("offset")))
    at = both.join(segs.select("edge", "cum", "metres", geo.azimuth(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("b")), "edge").filter((F.col("cum") <= F.col("offset") + 1e-9) & (F.col("offset") <= F.col("cum") + F.col("metres") + 1e-9))
    bearing = F.when(F.col("reverse"), wrap(F.col("b") + F.pi())).otherwise(F.col("b"))
    off = F.abs(wrap(bearing - F.col("heading")))
    scored = at.withColumn("off", off).filter(F.col("off") <= tolerance).withColumn("score", F.col("distance") + weight * F.col("off") / F.pi())
    best = scored.groupBy("id").agg(F.min(F.struct("score", "d", "along", "distance")).alias("m"))
    return best.select("id", "m.d", F.col("m.along").alias("offset"), "m.distance", "m.score")


def by_node_pair(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """``pairs`` (id, a, b: node identifiers in either order) with the edge and segment that join them."""
    key = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    own = segs.select("edge", "i", key("from_node", "to_node").alias("pair"))
    return pairs.withColumn("pair", key("a", "b")).join(own, "pair").select("id", "a", "b", "edge", "i")


def session_box(fixes: DataFrame, session: str, lat: str, lon: str, km: float) -> DataFrame:
    """session, south, west, north, east around valid fixes, widened by ``km``."""
    ok = fixes.filter((F.col(lat) != 0) & (F.col(lon) != 0))
    box = ok.groupBy(session).agg(F.min(lat).alias("s"), F.min(lon).alias("w"), F.max(lat).alias("n"), F.max(lon).alias("e"))
    wide = geo.padded_box(F.col("s"), F.col("w"), F.col("n"), F.col("e"), km)
    return box.select(session, *(c.alias(n) for c, n in zip(wide, ("south", "west", "north", "east"), strict=True)))


def chords(track: DataFrame, keys: list[str], k: str, lat: str, lon: str) -> DataFrame:
    """keys, k, distance, heading of each step of a track; a step of no length keeps the heading before it, or 0."""
    own = Window.partitionBy(*keys).orderBy(k)
    rows = track.withColumns({"__la": F.lag(lat).over(own), "__lo": F.lag(lon).over(own)}).filter("__la is not null")
    rows = rows.withColumn("__g", geo.inverse(F.col("__la"), F.col("__lo"), F.col(lat), F.col(lon)))
    moving = F.when(F.col("__g.distance") > 0, F.col("__g.azimuth"))
    return rows.select(*keys, k, F.col("__g.distance").alias("distance"), moving.alias("__h")).withColumn("heading", F.coalesce(F.last("__h", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).drop("__h")
