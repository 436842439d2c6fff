"""Queries over sources, filters, the road graph, map matching, learning and streams, on literals and the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import geo, units
from tarmac.operators import estimators, learning, mapmatch
from tarmac.operators import roadgraph as rg
from tarmac.plans.metrics import rounded
from tarmac.plans.registry import query
from tarmac.sources import catalog, maps
from tarmac.views import PAIRS_SQL, SAMPLES_SQL, samples, table

S = f"WITH {SAMPLES_SQL}"

#: Files of a small corpus: (path).
FILES = [
    "Unsynchronised/Categorised/M/S-M1.csv", "Synchronised/Categorised/M/S-M1.csv", "Synchronised/Uncategorised/M/S-m1.csv", "Synchronised/Categorised/Vw/V-Vw12.csv", "Synchronised/Categorised/Vw/S-Vw12.csv",
    "Synchronised/Uncategorised/T/S-T2.csv", "Unsynchronised/Uncategorised/A/S-A1.csv", "Synchronised/Categorised/T/S-T9.csv", "Synchronised/Categorised/St/S-St1.csv", "Synchronised/Categorised/M/readme.txt",
]


def sessions(spark: SparkSession) -> DataFrame:
    found = catalog.discover(spark.createDataFrame([(f,) for f in FILES], "path string"))
    excluded = spark.createDataFrame([("T2", "inflated positions")], "session string, reason string")
    return catalog.with_roles(found, ["M", "Vw", "T", "A", "St", "S"], excluded, ["vw12"], ["T"], ["A"], ["S"], ["M", "St"])


@query("""WITH f(path) AS (VALUES """ + ", ".join(f"('{f}')" for f in FILES) + r"""), p AS (SELECT path, upper(regexp_extract(path, '([SV])-[^/]+\.csv$', 1)) AS family, regexp_extract(path, '[SV]-([^/]+)\.csv$', 1) AS session,
        CASE WHEN path LIKE 'Synchronised/Categorised%' THEN 0 WHEN path LIKE 'Synchronised/Unc%' THEN 1 WHEN path LIKE 'Unsynchronised/Cat%' THEN 2 ELSE 3 END AS pr FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY family, lower(session) ORDER BY pr, path) AS k FROM p WHERE session <> ''),
    g AS (SELECT family, session, path, CASE WHEN lower(session) LIKE 'vw%' THEN 'Vw' WHEN lower(session) LIKE 'st%' THEN 'St' WHEN lower(session) LIKE 'm%' THEN 'M' WHEN lower(session) LIKE 't%' THEN 'T' WHEN lower(session) LIKE 'a%' THEN 'A' WHEN lower(session) LIKE 's%' THEN 'S' ELSE '?' END AS "group",
        CASE WHEN family = 'S' AND lower(session) = 't2' THEN 'inflated positions' END AS exclusion_reason FROM k WHERE k = 1)
    SELECT *, CASE WHEN family = 'V' THEN 'stage0_only' WHEN exclusion_reason IS NOT NULL THEN 'excluded' WHEN lower(session) = 'vw12' THEN 'test' WHEN "group" = 'A' THEN 'robustness_2hz' WHEN "group" = 'T' THEN 'validate' ELSE 'train' END AS role FROM g""")
def session_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark).select("family", "session", "path", "group", "exclusion_reason", "role")


@query("SELECT unnest(['vw12']) AS session")
def paired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.paired(sessions(spark))


ROLE = "CASE session % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'robustness_2hz' WHEN 2 THEN 'test' ELSE 'excluded' END"


def roles() -> F.Column:
    r = F.pmod("session", F.lit(4))
    return F.when(r == 0, "train").when(r == 1, "robustness_2hz").when(r == 2, "test").otherwise("excluded")


@query(f"""{S}, r AS (SELECT session, {ROLE} AS role, avg(speed_ms) * 2 AS hz FROM samples GROUP BY session)
    SELECT session, role, round(hz, 6) AS hz, CASE role WHEN 'excluded' THEN true WHEN 'robustness_2hz' THEN hz BETWEEN 1.6 AND 2.4 ELSE hz BETWEEN 8 AND 12 END AS ok FROM r""")
def role_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = samples(spark, sf_dir).groupBy("session").agg((F.avg("speed_ms") * 2).alias("hz")).withColumn("role", roles())
    return rounded(catalog.rate_gate(rates), 6, "hz")


@query(f"""{S} SELECT session, count(*) AS n, count(CASE WHEN event_type <> 'error' AND lat <> 0 THEN 1 END) AS valid, count(CASE WHEN event_type <> 'error' AND lat <> 0 THEN 1 END) >= 20 AS usable FROM samples GROUP BY session""")
def fix_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("lat", F.when(F.col("event_type") != "error", F.col("lat")).otherwise(0.0))
    good = units.valid_fix(F.col("lat"), F.col("lon"), F.col("t"))
    out = rows.groupBy("session").agg(F.count("*").alias("n"), F.count_if(good).alias("valid"))
    return out.withColumn("usable", F.col("valid") >= 20)


@query("""SELECT CASE WHEN v < 0 THEN 'negative' WHEN v > 60 THEN 'too fast' ELSE 'ok' END AS verdict, count(*) AS n FROM (SELECT (l_quantity - 2) * 2 / 1.5::DOUBLE AS v FROM lineitem) GROUP BY ALL""")
def plausibility_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(units.plausible((F.col("l_quantity") - 2) * 2, 1.5).alias("verdict"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""{S}, e AS (SELECT session, min_by(lat, row_idx) AS a, min_by(lon, row_idx) AS b, max_by(lat, row_idx) AS c, max_by(lon, row_idx) AS d FROM samples GROUP BY session)
    SELECT session, round(a, 6) AS start_lat, round(c, 6) AS end_lat, a BETWEEN 51.502 AND 51.509 AND b BETWEEN -2.5 AND -2.4905 AND c BETWEEN 51.502 AND 51.509 AND d BETWEEN -2.5 AND -2.4905 AS inside FROM e""")
def country_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = samples(spark, sf_dir).groupBy("session").agg(F.min_by("lat", "row_idx").alias("start_lat"), F.min_by("lon", "row_idx").alias("b"), F.max_by("lat", "row_idx").alias("end_lat"), F.max_by("lon", "row_idx").alias("d"))
    box = (F.lit(51.502), F.lit(-2.5), F.lit(51.509), F.lit(-2.4905))
    inside = geo.box_contains(box, F.col("start_lat"), F.col("b")) & geo.box_contains(box, F.col("end_lat"), F.col("d"))
    return rounded(ends.select("session", "start_lat", "end_lat", inside.alias("inside")), 6, "start_lat", "end_lat")


@query("""SELECT CASE WHEN abs(r) >= 0.05 THEN 'cornering' WHEN abs(r) <= 0.02 AND d < 25 THEN 'straight' WHEN abs(r) <= 0.02 THEN 'motorway' ELSE 'other' END AS scenario, count(*) AS n, round(avg(d), 6) AS mean FROM (SELECT (l_discount - 0.05::DOUBLE) * 1.1 AS r, l_quantity AS d FROM lineitem) GROUP BY ALL""")
def scenario_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_discount") - 0.05) * 1.1).alias("r"), F.col("l_quantity").alias("d"))
    return rounded(rows.groupBy(learning.scenario(F.col("r"), F.col("d")).alias("scenario")).agg(F.count("*").alias("n"), F.avg("d").alias("mean")), 6, "mean")


@query("""WITH q AS (SELECT l_quantity * 2.1 AS hz, l_tax FROM lineitem) SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN abs(hz - 100) / 100 < 0.15 THEN '100 Hz' WHEN abs(hz - 50) / 50 < 0.15 THEN '50 Hz' WHEN abs(hz - 20) / 20 < 0.15 THEN '20 Hz' WHEN abs(hz - 10) / 10 < 0.15 THEN '10 Hz' WHEN abs(hz - 5) / 5 < 0.15 THEN '5 Hz'
    WHEN abs(hz - 2) / 2 < 0.15 THEN '2 Hz' WHEN abs(hz - 1) < 0.15 THEN '1 Hz' ELSE 'odd' END AS bucket FROM q) GROUP BY bucket""")
def hz_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(units.hz_bucket(F.col("l_quantity") * 2.1).alias("bucket"))
    return rows.groupBy(F.when(F.col("bucket").endswith("(odd)"), "odd").otherwise(F.col("bucket")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_returnflag AS "group", l_linestatus AS family, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY ALL), f AS (SELECT l_linestatus AS family, quantile_cont(l_extendedprice, 0.5) AS fam FROM lineitem GROUP BY ALL)
    SELECT "group", family, round(med, 4) AS median, round(fam, 4) AS family_median, abs(med / fam - 1) > 0.005 AS flagged FROM m JOIN f USING (family)""")
def unit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_linestatus").alias("family"), "l_extendedprice")
    return rounded(units.family_verdicts(rows, ["group"], "family", "l_extendedprice", 0.005), 4, "median", "family_median")


@query("""WITH r AS (SELECT unnest([9.8, 0.102, 3.6, 1.9, 57.0, 1.5]) AS ratio) SELECT ratio::DOUBLE AS ratio, CASE WHEN abs(ratio / 9.80665 - 1) <= 0.2 THEN 'g' WHEN abs(ratio * 9.80665 - 1) <= 0.2 THEN '1/g' WHEN abs(ratio / 3.6 - 1) <= 0.2 THEN '3.6' WHEN abs(ratio / 2 - 1) <= 0.2 THEN '2' WHEN abs(ratio / 57.29577951308232 - 1) <= 0.2 THEN '57.3' ELSE 'unknown' END AS diagnosis FROM r""")
def unit_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in (9.8, 0.102, 3.6, 1.9, 57.0, 1.5)], "ratio double")
    return rows.select("ratio", units.diagnosis(F.col("ratio")).alias("diagnosis"))


@query("""WITH b AS (SELECT o_orderpriority AS "group", CASE o_orderstatus WHEN 'F' THEN '10 Hz' WHEN 'O' THEN '2 Hz' ELSE 'odd' END AS bucket, o_totalprice / 3600 AS hours FROM orders), u AS (SELECT * FROM b UNION ALL SELECT 'ALL', bucket, hours FROM b)
    SELECT "group", count(CASE WHEN bucket = '10 Hz' THEN 1 END) AS files_10, count(CASE WHEN bucket = '2 Hz' THEN 1 END) AS files_2, count(CASE WHEN bucket = 'odd' THEN 1 END) AS files_odd, round(sum(hours), 4) AS hours, count(DISTINCT bucket) > 1 AS mixed FROM u GROUP BY "group" """)
def rate_distribution_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("o_orderstatus") == "F", "10").when(F.col("o_orderstatus") == "O", "2").otherwise("odd")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("group"), b.alias("bucket"), (F.col("o_totalprice") / 3600).alias("hours"))
    counts = [F.count_if(F.col("bucket") == v).alias(f"files_{v}") for v in ("10", "2", "odd")]
    out = rows.rollup("group").agg(*counts, F.sum("hours").alias("hours"), (F.countDistinct("bucket") > 1).alias("mixed"))
    return rounded(out.withColumn("group", F.coalesce("group", F.lit("ALL"))), 4, "hours")


@query("""WITH h(name, cols) AS (VALUES ('a', ['lat', 'lon', 'speed']), ('b', ['lat', 'lon']), ('c', ['lat', 'speed', 'yaw']))
    SELECT x.name AS a, y.name AS b, list_sort(list_filter(x.cols, lambda q: NOT list_contains(y.cols, q))) AS only_a, list_sort(list_filter(y.cols, lambda q: NOT list_contains(x.cols, q))) AS only_b, len(list_filter(x.cols, lambda q: list_contains(y.cols, q)))::INT AS shared FROM h x, h y WHERE x.name < y.name""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("a", ["lat", "lon", "speed"]), ("b", ["lat", "lon"]), ("c", ["lat", "speed", "yaw"])], "name string, cols array<string>")
    return units.schema_differences(rows, "name", "cols")


@query("""WITH w AS (SELECT l_suppkey AS session, CASE WHEN l_suppkey = 3 AND l_linenumber = 1 THEN 'test' ELSE 'train' END AS role, 1 AS build, l_orderkey * 10 + l_linenumber AS t0 FROM lineitem)
    SELECT 'one_role' AS "check", 1::BIGINT AS failures UNION ALL SELECT 'one_build', 0 UNION ALL SELECT 'one_width', 0 UNION ALL SELECT 'rising_starts', (SELECT count(*) FROM (SELECT t0 - lag(t0) OVER (PARTITION BY session ORDER BY t0) AS d FROM w) WHERE d <= 0)
    UNION ALL SELECT 'listed_role', 1""")
def leakage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session"), F.when((F.col("l_suppkey") == 3) & (F.col("l_linenumber") == 1), "test").otherwise("train").alias("role"), F.lit(1).alias("build"), F.lit(100).alias("width"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t0"),
    )
    return catalog.leakage(rows.withColumn("position", F.col("t0")), rows.select("session", F.lit("train").alias("role")).distinct())


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS quality FROM orders), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS ecu FROM lineitem GROUP BY k) SELECT k, quality, round(ecu, 4) AS ecu FROM a JOIN b USING (k) WHERE quality > 200000""")
def quality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("quality")).filter("quality > 200000")
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("ecu"))
    return rounded(a.join(b, "k"), 4, "ecu")


# ---------------------------------------------------------------- geodesics and the road graph


@query(f"""WITH RECURSIVE {SAMPLES_SQL}, p AS (SELECT session, row_idx, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM samples WINDOW w AS (PARTITION BY session ORDER BY row_idx)),
    q AS (SELECT session, row_idx, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(plat))) AS u1, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat))) AS u2, radians(lon) - radians(plon) AS l, plat = lat AND plon = lon AS same FROM p WHERE plat IS NOT NULL),
    i AS (SELECT session, row_idx, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l, l AS lam, 0 AS k FROM q WHERE NOT same UNION ALL
        SELECT session, row_idx, s1, c1, s2, c2, l, l + (1 - cc) * f * sa * (sg + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1))), k + 1 FROM (
            SELECT *, f / 16 * ca * (4 + f * (4 - 3 * ca)) AS cc FROM (SELECT *, 1 - sa * sa AS ca, cs - 2 * s1 * s2 / (1 - sa * sa) AS c2m, atan2(ss, cs) AS sg FROM (SELECT *, c1 * c2 * sin(lam) / ss AS sa FROM (
                SELECT *, 1 / 298.257223563::DOUBLE AS f, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM i WHERE k < 6)))) t),
    z AS (SELECT *, 1 - sa * sa AS ca, cs - 2 * s1 * s2 / (1 - sa * sa) AS m, atan2(ss, cs) AS sg FROM (SELECT *, c1 * c2 * sin(lam) / ss AS sa FROM (SELECT *, sqrt(power(c2 * sin(lam), 2) + power(c1 * s2 - s1 * c2 * cos(lam), 2)) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs FROM i WHERE k = 6))),
    y AS (SELECT *, ca * (power(6378137.0::DOUBLE, 2) - power(6356752.314245179::DOUBLE, 2)) / power(6356752.314245179::DOUBLE, 2) AS uu FROM z),
    x AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ba, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM y),
    d AS (SELECT session, row_idx, 6356752.314245179::DOUBLE * ba * (sg - bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1) - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) AS metres, atan2(c2 * sin(lam), c1 * s2 - s1 * c2 * cos(lam)) AS az FROM x)
    SELECT session, row_idx, round(metres, 3) AS metres, round(abs(az), 5) AS azimuth FROM d UNION ALL SELECT session, row_idx, 0, 0 FROM q WHERE same""")
def geodesic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("session").orderBy("row_idx")
    rows = samples(spark, sf_dir).select("session", "row_idx", "lat", "lon", F.lag("lat").over(own).alias("plat"), F.lag("lon").over(own).alias("plon")).filter("plat is not null")
    out = rows.withColumn("g", geo.inverse(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")))
    return rounded(rounded(out.select("session", "row_idx", F.col("g.distance").alias("metres"), F.abs("g.azimuth").alias("azimuth")), 3, "metres"), 5, "azimuth")


#: A crossroads: centre 1, north 2, south 3, east 4, west 5; and a one-way street from the north.
NODES = {1: (51.5000, -2.5000), 2: (51.5010, -2.5000), 3: (51.4990, -2.5000), 4: (51.5000, -2.4986), 5: (51.5000, -2.5014), 6: (51.5010, -2.4986)}
WAYS = [([3, 1, 2], False), ([5, 1, 4], False), ([2, 6, 4], True)]
CROSS_SQL = f"""n(node, lat, lon) AS (VALUES {", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in NODES.items())}),
    w(way, refs, oneway) AS (VALUES {", ".join(f"({k}, {r}, {str(o).lower()})" for k, (r, o) in enumerate(WAYS))}),
    r AS (SELECT way, oneway, unnest(refs) AS node, generate_subscripts(refs, 1) AS idx, len(refs) AS n FROM w), u AS (SELECT node, count(*) AS uses FROM r GROUP BY node),
    c AS (SELECT r.*, (uses >= 2 AND idx > 1 AND idx < n)::INT AS cut FROM r JOIN u USING (node)), p AS (SELECT *, sum(cut) OVER (PARTITION BY way ORDER BY idx) AS part FROM c),
    s AS (SELECT way, part, oneway, idx, node FROM p UNION ALL SELECT way, part - 1, oneway, idx, node FROM p WHERE cut = 1),
    e AS (SELECT way * 10000 + part AS edge, any_value(oneway) AS oneway, list(node ORDER BY idx) AS refs FROM s GROUP BY way, part),
    g AS (SELECT edge, unnest(range(1, len(refs))) AS i, refs FROM e), sg AS (SELECT edge, i, a.node AS from_node, b.node AS to_node, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, 111320.0::DOUBLE * sqrt(power(b.lat - a.lat, 2) + power((b.lon - a.lon) * cos(radians(a.lat)), 2)) AS metres
        FROM g JOIN n a ON a.node = refs[i] JOIN n b ON b.node = refs[i + 1])"""


def flat_metres(lat1, lon1, lat2, lon2) -> F.Column:
    return 111_320.0 * F.sqrt(F.pow(lat2 - lat1, 2) + F.pow((lon2 - lon1) * F.cos(F.radians(lat1)), 2))


def crossroads(spark: SparkSession, metres=flat_metres) -> maps.RoadGraph:
    return maps.RoadGraph.build(*maps.from_ways(spark, NODES, WAYS, "residential"), metres)


@query(f"WITH {CROSS_SQL} SELECT edge::BIGINT AS edge, array_to_string(refs, '-') AS refs, oneway FROM e")
def junction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = rg.split_at_junctions(*reversed(maps.from_ways(spark, NODES, WAYS)))
    return edges.select("edge", F.concat_ws("-", F.transform("refs", lambda x: x.cast("string"))).alias("refs"), "oneway")


@query(f"WITH {CROSS_SQL} SELECT edge::BIGINT AS edge, i::INT AS i, from_node::BIGINT AS from_node, to_node::BIGINT AS to_node, round(metres, 4) AS metres, round(coalesce(sum(metres) OVER (PARTITION BY edge ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS cum FROM sg")
def edge_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crossroads(spark).segments.select("edge", "i", "from_node", "to_node", "metres", "cum"), 4, "metres", "cum")


@query(f"""WITH {CROSS_SQL}, x AS (SELECT edge, oneway, refs[1] AS a, refs[-1] AS z FROM e), d AS (SELECT edge * 2 AS d, edge, a AS f, z AS t FROM x UNION ALL SELECT edge * 2 + 1, edge, z, a FROM x WHERE NOT oneway)
    SELECT p.d::BIGINT AS d, q.d::BIGINT AS "next" FROM d p JOIN d q ON p.t = q.f AND p.edge <> q.edge""")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.successors(crossroads(spark).directed).select("d", "next")


POINTS_SQL = f"""{SAMPLES_SQL}, pt AS (SELECT event_id AS id, 51.4995::DOUBLE + (event_id % 11) * 1e-4::DOUBLE AS lat, -2.5005::DOUBLE + (event_id % 13) * 1e-4::DOUBLE AS lon FROM samples)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(F.col("event_id").alias("id"), (51.4995 + F.pmod("event_id", F.lit(11)) * 1e-4).alias("lat"), (-2.5005 + F.pmod("event_id", F.lit(13)) * 1e-4).alias("lon"), F.radians("heading_deg").alias("heading"))


@query(f"""WITH {POINTS_SQL}, {CROSS_SQL}, v AS (SELECT id, edge, i, (lon1 - lon) * 111320 * cos(radians(lat)) AS x1, (lat1 - lat) * 110540 AS y1, (lon2 - lon1) * 111320 * cos(radians(lat)) AS dx, (lat2 - lat1) * 110540 AS dy FROM pt, sg),
    f AS (SELECT *, greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) AS f FROM v), h AS (SELECT id, edge, min(round(sqrt(power(x1 + f * dx, 2) + power(y1 + f * dy, 2)), 4)) AS distance FROM f GROUP BY ALL),
    k AS (SELECT id, edge, distance, row_number() OVER (PARTITION BY id ORDER BY distance, edge) AS k FROM h WHERE distance <= 60)
    SELECT id, min(distance) AS nearest, max(distance) AS furthest, count(*) AS n FROM k WHERE k <= 3 GROUP BY id""")
def nearest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = rounded(rg.nearest_edges(points(spark, sf_dir), crossroads(spark).segments, 60.0, 3, cell=0.001), 4, "distance")
    return near.groupBy("id").agg(F.min("distance").alias("nearest"), F.max("distance").alias("furthest"), F.count("*").alias("n"))


#: Directions of the crossroads: both ways of an edge, its length and its bearings on arrival and departure (geodesic to first order in the mid-latitude).
DIRECTED_SQL = """az AS (SELECT *, atan2((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), lat2 - lat1) - radians(lon2 - lon1) / 2 * sin(radians((lat1 + lat2) / 2)) AS b, coalesce(sum(metres) OVER (PARTITION BY edge ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM sg),
    ends AS (SELECT edge, sum(metres) AS len, min_by(b, i) AS fb, max_by(b, i) AS lb, min_by(from_node, i) AS a, max_by(to_node, i) AS z FROM az GROUP BY edge),
    dir AS MATERIALIZED (SELECT edge * 2 AS d, edge, 0 AS r, a AS f, z AS t, len, lb AS entry, fb AS leave FROM ends UNION ALL SELECT edge * 2 + 1, edge, 1, z, a, len, fb + pi(), lb + pi() FROM ends JOIN e USING (edge) WHERE NOT oneway)"""


@query(f"""WITH {SAMPLES_SQL}, {CROSS_SQL}, {DIRECTED_SQL}, pt AS (SELECT event_id AS id, 51.4995::DOUBLE + (event_id % 11) * 1e-4::DOUBLE AS lat, -2.5005::DOUBLE + (event_id % 13) * 1e-4::DOUBLE AS lon, radians(heading_deg) AS heading FROM samples),
    v AS (SELECT id, heading, edge, i, b, cum, metres, (lon1 - lon) * 111320 * cos(radians(lat)) AS x1, (lat1 - lat) * 110540 AS y1, (lon2 - lon1) * 111320 * cos(radians(lat)) AS dx, (lat2 - lat1) * 110540 AS dy FROM pt, az),
    h AS (SELECT *, greatest(0, least(1, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) AS f FROM v), z AS (SELECT *, sqrt(power(x1 + f * dx, 2) + power(y1 + f * dy, 2)) AS distance, cum + f * metres AS o FROM h),
    q AS (SELECT *, row_number() OVER (PARTITION BY id, edge ORDER BY distance, i) AS first FROM z WHERE distance <= 60), o AS (SELECT id, edge, heading, distance, o FROM q WHERE first = 1),
    at_ AS (SELECT o.*, az.b FROM o JOIN az ON az.edge = o.edge AND cum <= o.o + 1e-9 AND o.o <= cum + metres + 1e-9), two AS (SELECT at_.*, d, CASE WHEN r = 1 THEN len - o ELSE o END AS along, b + r * pi() - heading AS raw FROM at_ JOIN dir ON dir.edge = at_.edge),
    k AS (SELECT *, distance + 20 * abs(atan2(sin(raw), cos(raw))) / pi() AS score FROM two WHERE abs(atan2(sin(raw), cos(raw))) <= 1.0471975511965976::DOUBLE), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, d, along, distance) AS first FROM k)
    SELECT id, d::BIGINT AS d, round(along, 4) AS "offset", round(distance, 4) AS distance, round(score, 4) AS score FROM m WHERE first = 1""")
def snap_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = crossroads(spark)
    return rounded(rg.snapped(points(spark, sf_dir), g.segments, g.directed, 60.0), 4, "offset", "distance", "score")


@query(f"WITH {CROSS_SQL}, q(id, a, b) AS (VALUES (1, 1, 2), (2, 4, 1), (3, 6, 2), (4, 2, 5)) SELECT id::BIGINT AS id, edge::BIGINT AS edge, i::INT AS i FROM q JOIN sg ON least(a, b) = least(from_node, to_node) AND greatest(a, b) = greatest(from_node, to_node)")
def node_pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, 1, 2), (2, 4, 1), (3, 6, 2), (4, 2, 5)], "id long, a long, b long")
    return rg.by_node_pair(asked, crossroads(spark).segments).select("id", "edge", "i")


@query(f"{S} SELECT session, round(min(lat) - 2 / 111.32::DOUBLE, 9) AS south, round(max(lat) + 2 / 111.32::DOUBLE, 9) AS north, round(min(lon) - 2 / 111.32::DOUBLE / cos(radians((min(lat) + max(lat)) / 2)), 9) AS west, round(max(lon) + 2 / 111.32::DOUBLE / cos(radians((min(lat) + max(lat)) / 2)), 9) AS east FROM samples GROUP BY session")
def session_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.session_box(samples(spark, sf_dir), "session", "lat", "lon", 2.0), 9, "south", "north", "west", "east")


def drives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps, starts and reachable roads of drives over the crossroads, one per whole session of the event stream."""
    rows = samples(spark, sf_dir)
    steps = rows.select(F.col("session").alias("outage"), F.col("row_idx").alias("k"), (F.col("speed_ms") / 2 + 2).alias("distance"), (F.col("gyr") * 12).alias("turn"), F.lit(3.0).alias("sigma"))
    ids = rows.select(F.col("session").alias("outage")).distinct()
    g = crossroads(spark)
    start = F.pmod("outage", F.lit(4)).cast("int")
    starts = ids.select("outage", F.element_at(F.array(*(F.lit(x) for x in (0, 3, 20000, 20003))), start + 1).cast("long").alias("d"), F.lit(5.0).alias("offset"), F.lit(0.0).alias("weight"))
    seen = ids.select("outage", F.lit(51.5).alias("lat"), F.lit(-2.5).alias("lon"), F.lit(500.0).alias("reach"))
    return steps, starts, mapmatch.reachable(seen, g.directed, g.segments)


#: One row a hop: a second's distance is used up along the edges, and at each junction the direction next to the observed turn is taken.
GREEDY_SQL = f"""{SAMPLES_SQL}, {CROSS_SQL}, {DIRECTED_SQL}, turn AS (SELECT session, row_idx AS k, speed_ms / 2 + 2 AS metres, gyr * 12 AS turn FROM samples),
    nx AS (SELECT p.d, q.d AS nd, p.edge = q.edge AS back, q.leave - p.entry AS raw FROM dir p JOIN dir q ON p.t = q.f), na AS (SELECT *, count(*) FILTER (NOT back) OVER (PARTITION BY d) AS ahead, atan2(sin(raw), cos(raw)) AS angle FROM nx),
    opt AS (SELECT session, k, d, nd, abs(angle) AS straight, abs(atan2(sin(angle - turn), cos(angle - turn))) AS miss, ahead FROM na, turn WHERE NOT back OR ahead = 0),
    ord AS (SELECT *, min(miss) OVER (PARTITION BY session, k, d) AS least FROM opt),
    ch AS (SELECT session, k, d, nd FROM (SELECT *, row_number() OVER (PARTITION BY session, k, d ORDER BY CASE WHEN ahead < 2 THEN nd WHEN least <= radians(75) THEN miss ELSE straight END, nd) AS first FROM ord) WHERE first = 1), nexts AS (SELECT session, k, MAP(list(d), list(nd)) AS nexts FROM ch GROUP BY session, k), tc AS MATERIALIZED (SELECT turn.session, turn.k, metres, nexts FROM turn JOIN nexts USING (session, k)),
    go AS (SELECT session, 0::BIGINT AS k, [0, 3, 20000, 20003][(session % 4 + 1)::INT]::BIGINT AS d, 5::DOUBLE AS o, 0::DOUBLE AS rest, true AS done FROM samples GROUP BY session
        UNION ALL SELECT session, k, CASE WHEN nd IS NULL OR done OR rest < room OR rest <= 0 THEN d ELSE nd END, CASE WHEN done THEN o WHEN rest < room THEN o + greatest(rest, 0) WHEN rest <= 0 THEN o WHEN nd IS NULL THEN len ELSE 0 END,
            CASE WHEN done THEN metres WHEN rest < room OR rest <= 0 THEN 0 ELSE rest - greatest(room, 0) END, NOT done AND (rest < room OR rest <= 0 OR nd IS NULL)
        FROM (SELECT go.session, go.k + go.done::INT AS k, go.d, go.o, go.rest, go.done, dir.len, dir.len - go.o AS room, tc.metres, element_at(tc.nexts, go.d)[1] AS nd FROM go JOIN dir ON dir.d = go.d JOIN tc ON tc.session = go.session AND tc.k = go.k + go.done::INT))"""


@query(f"""WITH RECURSIVE {GREEDY_SQL} SELECT session AS outage, k, d, round(o, 4) AS "offset" FROM go WHERE done""")
def greedy_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mapmatch.track(*drives(spark, sf_dir), "greedy"), 4, "offset")


#: The greedy tracks' positions.
PLACES_SQL = f"""{GREEDY_SQL}, gone AS (SELECT session, k, go.d, r, edge, greatest(0, least(o, len)) AS cut, len FROM go JOIN dir ON dir.d = go.d WHERE done), y AS (SELECT *, CASE WHEN r = 1 THEN len - cut ELSE cut END AS along FROM gone),
    lies AS (SELECT y.*, az.cum, az.metres, lat1, lon1, lat2, lon2, b, row_number() OVER (PARTITION BY session, k ORDER BY az.cum DESC) AS first FROM y JOIN az ON az.edge = y.edge AND az.cum <= along + 1e-9 AND along <= az.cum + az.metres + 1e-9),
    placed AS (SELECT session, k, lat1 + (lat2 - lat1) * (along - cum) / metres AS lat, lon1 + (lon2 - lon1) * (along - cum) / metres AS lon, b + r * pi() AS bearing FROM lies WHERE first = 1)"""


@query(f"""WITH RECURSIVE {PLACES_SQL} SELECT session AS outage, k, round(lat, 8) AS lat, round(lon, 8) AS lon, round(sin(bearing), 5) + 0.0::DOUBLE AS east, round(cos(bearing), 5) + 0.0::DOUBLE AS north FROM placed""")
def track_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the greedy tracks are each second, and the direction they go."""
    path = mapmatch.track(*drives(spark, sf_dir), "greedy").withColumn("id", F.struct("outage", "k"))
    g = crossroads(spark)
    at = rg.position_at(path.select("id", "d", "offset"), g.directed, g.segments)
    out = at.select("id.outage", "id.k", "lat", "lon", F.sin("bearing").alias("east"), F.cos("bearing").alias("north"))
    return rounded(rounded(out, 8, "lat", "lon"), 5, "east", "north")


@query()
def beam_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mapmatch.track(*drives(spark, sf_dir), "beam"), 4, "offset")


@query()
def viterbi_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mapmatch.track(*drives(spark, sf_dir), "viterbi"), 4, "offset")


@query(f"""WITH RECURSIVE {PLACES_SQL}, was AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM placed WINDOW w AS (PARTITION BY session ORDER BY k)), mid AS (SELECT *, radians((lat + la) / 2) AS m, radians(lat - la) AS dn, radians(lon - lo) AS de, 0.0066943799901413165::DOUBLE AS q FROM was WHERE la IS NOT NULL),
    flat AS (SELECT *, dn * 6378137 * (1 - q) / power(1 - q * power(sin(m), 2), 1.5) AS n, de * 6378137 * cos(m) / sqrt(1 - q * power(sin(m), 2)) AS ea FROM mid), h AS (SELECT *, CASE WHEN n <> 0 OR ea <> 0 THEN atan2(ea, n) - de / 2 * sin(m) END AS h FROM flat),
    kept AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY session ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS heading FROM h)
    SELECT session AS outage, k, round(sqrt(n * n + ea * ea), 3) AS distance, round(sin(heading), 3) + 0.0::DOUBLE AS east, round(cos(heading), 3) + 0.0::DOUBLE AS north FROM kept""")
def track_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chords of the greedy tracks: length and direction a second."""
    path = mapmatch.track(*drives(spark, sf_dir), "greedy").withColumn("id", F.struct("outage", "k"))
    g = crossroads(spark)
    at = rg.position_at(path.select("id", "d", "offset"), g.directed, g.segments).select("id.outage", "id.k", "lat", "lon")
    out = rg.chords(at, ["outage"], "k", "lat", "lon")
    return rounded(out.select("outage", "k", "distance", F.sin("heading").alias("east"), F.cos("heading").alias("north")), 3, "distance", "east", "north")


@query(f"""{S}, b AS (SELECT session, (row_idx - 1) // 2 AS k, sum(gyr) AS turn, avg(a2) AS change, avg(speed_ms) AS v FROM samples GROUP BY ALL HAVING count(*) = 2),
    f AS (SELECT session, count(*) AS n, regr_slope(change, turn) AS s FROM b WHERE v > 4 GROUP BY session) SELECT session, round(s, 6) AS slope, CASE WHEN n >= 10 AND abs(s) > 0.3 THEN sign(s)::DOUBLE ELSE -1 END AS sign FROM f""")
def gyro_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarmac.operators import windowing as wn

    rows = samples(spark, sf_dir).withColumn("k", F.col("row_idx") - 1)
    b = wn.blocks(rows, "session", "k", 2, {"turn": F.sum("gyr"), "change": F.avg("a2"), "v": F.avg("speed_ms")})
    return rounded(mapmatch.gyro_sign(b, ["session"], "turn", "change", "v", 10, 4.0), 6, "slope")


@query("SELECT e AS epoch, round(CASE WHEN e >= 9 THEN 0 ELSE 5 / (5 + exp(e / 5.0::DOUBLE)) END, 9) AS sigmoid, round(CASE WHEN e >= 9 THEN 0 ELSE 1 - e / 9.0::DOUBLE END, 9) AS linear FROM (SELECT unnest(range(0, 10)) AS e)")
def teacher_forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("id").cast("double")
    out = spark.range(10).select(F.col("id").alias("epoch"), mapmatch.teacher_forcing(e, 10).alias("sigmoid"), mapmatch.teacher_forcing(e, 10, linear=True).alias("linear"))
    return rounded(out, 9, "sigmoid", "linear")


# ---------------------------------------------------------------- filters with matrix state, learning


def low_pass_sql(order: int = 3, cutoff: float = 0.1) -> str:
    """The filter as two recursions over the odd extension of each session, with its coefficients as values."""
    b, a = estimators.butterworth(order, cutoff)
    z = estimators._steady(b, a)
    n = lambda x: f"{float(x)!r}::DOUBLE"
    step = lambda y: ", ".join(f"{f's{i + 1} + ' if i < order else ''}{n(b[i])} * x - {n(a[i])} * {y}" for i in range(1, order + 1))
    pad = 3 * (order + 1)
    states = ", ".join(f"s{i}" for i in range(1, order + 1))
    first = ", ".join(f"{n(v)} * x AS s{i + 1}" for i, v in enumerate(z))

    def run(name: str, source: str) -> str:
        y = f"({n(b[0])} * x + s1)"
        return f"""{name} AS (SELECT session, 0::BIGINT AS p, NULL::DOUBLE AS y, {first} FROM {source} WHERE p = 1 UNION ALL SELECT {name}.session, {source}.p, {y}, {step(y)} FROM {name} JOIN {source} ON {source}.session = {name}.session AND {source}.p = {name}.p + 1)"""

    return f"""WITH RECURSIVE {SAMPLES_SQL}, m AS (SELECT session, count(*) AS n, min_by(speed_ms, row_idx) AS f, max_by(speed_ms, row_idx) AS l FROM samples GROUP BY session),
    ext AS (SELECT session, row_idx + {pad} AS p, speed_ms AS x FROM samples JOIN m USING (session) WHERE n > {pad} UNION ALL SELECT session, {pad} + 2 - row_idx, 2 * f - speed_ms FROM samples JOIN m USING (session) WHERE n > {pad} AND row_idx BETWEEN 2 AND {pad} + 1
        UNION ALL SELECT session, {pad} + n + (n - row_idx), 2 * l - speed_ms FROM samples JOIN m USING (session) WHERE n > {pad} AND row_idx BETWEEN n - {pad} AND n - 1),
    {run('ahead', 'ext')}, turned AS (SELECT session, n + {2 * pad} + 1 - p AS p, y AS x FROM ahead JOIN m USING (session) WHERE p > 0), {run('back', 'turned')}
    SELECT session, n + {pad} + 1 - p AS row_idx, round(y, 6) + 0.0::DOUBLE AS smooth FROM back JOIN m USING (session) WHERE p > {pad} AND p <= n + {pad} UNION ALL SELECT session, row_idx, round(speed_ms, 6) FROM samples JOIN m USING (session) WHERE n <= {pad}"""


@query(low_pass_sql())
def low_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.low_pass(samples(spark, sf_dir), "session", "row_idx", "speed_ms"), 6, "smooth")


@query(f"""WITH RECURSIVE {SAMPLES_SQL}, r AS (SELECT session, row_idx AS k, gyr AS rate, speed_ms AS v, a2, speed_ms < 1 AS still FROM samples),
    z AS (SELECT session, 1::BIGINT AS k, 0 AS i, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS h, 0::DOUBLE AS b, 0.0025::DOUBLE AS hh, 0::DOUBLE AS hb, 0.0025::DOUBLE AS bb, 0::DOUBLE AS xh, 0::DOUBLE AS xb, 0::DOUBLE AS yh, 0::DOUBLE AS yb FROM r WHERE k = 1
        UNION ALL SELECT session, k + (i = 10)::INT, (i + 1) % 11, CASE WHEN i < 10 THEN x + dx ELSE x + g * (xb) END, CASE WHEN i < 10 THEN y + dy ELSE y + g * yb END,
            CASE WHEN i < 10 THEN h + (rate - b) * 0.1::DOUBLE ELSE h + g * hb END, CASE WHEN i < 10 THEN b ELSE b + g * bb END,
            CASE WHEN i < 10 THEN hh - 0.2::DOUBLE * hb + 0.01::DOUBLE * bb + 1e-6::DOUBLE ELSE hh - q * hb * hb END, CASE WHEN i < 10 THEN hb - 0.1::DOUBLE * bb ELSE hb - q * hb * bb END, CASE WHEN i < 10 THEN bb + 1e-11::DOUBLE ELSE bb - q * bb * bb END,
            CASE WHEN i < 10 THEN xh - dy * hh - 0.1::DOUBLE * (xb - dy * hb) ELSE xh - q * xb * hb END, CASE WHEN i < 10 THEN xb - dy * hb ELSE xb - q * xb * bb END,
            CASE WHEN i < 10 THEN yh + dx * hh - 0.1::DOUBLE * (yb + dx * hb) ELSE yh - q * yb * hb END, CASE WHEN i < 10 THEN yb + dx * hb ELSE yb - q * yb * bb END
        FROM (SELECT *, v / 10 * cos(h) AS dx, v / 10 * sin(h) AS dy, w * miss / s AS g, w * w / s AS q FROM (SELECT *, w * w * bb + CASE WHEN still THEN 1e-4::DOUBLE ELSE power(0.1::DOUBLE * (1 + 8 * abs(rate)), 2) END AS s
            FROM (SELECT z.*, r.rate, r.v, r.still, CASE WHEN still THEN 1::DOUBLE WHEN v >= 0.5 THEN v ELSE 0 END AS w, CASE WHEN still THEN rate - b ELSE a2 - v * (rate - b) END AS miss FROM z JOIN r ON z.session = r.session AND z.k = r.k))))
    SELECT session, k - 1 AS k, round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(h, 6) + 0.0::DOUBLE AS heading, round(b, 6) + 0.0::DOUBLE AS bias FROM z WHERE i = 0 AND k > 1""")
def eskf_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = samples(spark, sf_dir).select("session", F.col("row_idx").alias("k"), F.lit(0.0).alias("heading0"), F.lit(0.0).alias("mount"), F.col("gyr").alias("rate"), F.col("speed_ms").alias("distance"), "a1", "a2", (F.col("speed_ms") < 1).cast("double").alias("p_stationary"))
    return rounded(estimators.fused_headings(seconds), 6, "x", "y", "heading", "bias")


@query(f"""{S} SELECT session, round(atan2(avg(a2), avg(speed_ms)), 9) + 0.0::DOUBLE AS roll, round(atan2(-avg(a1), sqrt(power(avg(a2), 2) + power(avg(speed_ms), 2))), 9) + 0.0::DOUBLE AS pitch FROM samples GROUP BY session""")
def static_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimators.static_tilt(samples(spark, sf_dir), "session", "a1", "a2", "speed_ms"), 9, "roll", "pitch")


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, l_extendedprice / 1000 AS y FROM lineitem),
    c AS (SELECT sum(x * x) AS xx, sum(x) AS sx, count(*) AS n, sum(x * y) AS xy, sum(y) AS sy FROM s), w AS (SELECT (xy * (n + 1) - sx * sy) / ((xx + 1) * (n + 1) - sx * sx) AS a, ((xx + 1) * sy - sx * xy) / ((xx + 1) * (n + 1) - sx * sx) AS b FROM c)
    SELECT id, round(greatest(0, a * x + b), 4) AS prediction FROM s, w""")
def ridge_fit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    return rounded(rows.select("id", learning.fit_ridge(rows, ["l_quantity"], "y").predict().alias("prediction")), 4, "prediction")


@query()
def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"))
    split = learning.session_split(rows, "session")
    features = ["l_quantity", "l_discount", "l_tax"]
    model = learning.fit_trees(split.filter("in_train"), features, "y")
    out = learning.predict_trees(model, split.filter("not in_train"))
    return rounded(out.groupBy("session").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("mae")), 6, "mae")


@query(f"""{S}, r AS (SELECT session, t / 3600 AS t, speed_ms AS mu, a1 / 10 AS lv, a2 * 10 + 5 AS y, a2 AS logit, event_type = 'view' AS st, 1.0 AS w, a1 AS accel, gyr / 2 AS yh, gyr AS yt FROM samples),
    d AS (SELECT *, t - lag(t) OVER o AS gap, mu - lag(mu) OVER o AS ch FROM r WINDOW o AS (PARTITION BY session ORDER BY t)),
    x AS (SELECT 0.5 * (lv + power(y - mu, 2) * exp(-lv)) * w AS nll, 2 * st::INT * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0)) + (1 - st::INT) * (ln(1 + exp(-abs(logit))) + greatest(logit, 0)) AS bce,
        CASE WHEN gap <= 1.5 THEN power(greatest(0, abs(ch) - abs(accel) * gap), 2) END AS kinematic, abs(mu * sin(yh)) * (abs(yh) < 0.02)::INT AS sideways, abs(yh - yt) AS yaw, CASE WHEN gap <= 1.5 THEN abs(ch) END AS smooth FROM d),
    a AS (SELECT avg(nll) AS nll, avg(bce) AS bce, coalesce(avg(kinematic), 0) AS kinematic, avg(sideways) AS sideways, avg(yaw) AS yaw, coalesce(avg(smooth), 0) AS smooth FROM x)
    SELECT round(nll, 5) AS nll, round(bce, 6) AS bce, round(kinematic, 5) AS kinematic, round(sideways, 6) AS sideways, round(yaw, 6) AS yaw, round(smooth, 5) AS smooth, round(nll + 0.5 * bce + 0.3 * kinematic + 0.2 * sideways + 0.1 * yaw + 0.05 * smooth, 4) AS total FROM a""")
def loss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select(
        "session", (F.col("t") / 3600).alias("t"), F.col("speed_ms").alias("mu"), (F.col("a1") / 10).alias("log_var"), (F.col("a2") * 10 + 5).alias("y"), F.col("a2").alias("logit"), (F.col("event_type") == "view").alias("stationary"),
        F.lit(1.0).alias("weight"), F.col("a1").alias("accel"), (F.col("gyr") / 2).alias("yaw_hat"), F.col("gyr").alias("yaw_true"),
    )
    out = learning.losses(rows, "session", "t")
    return rounded(rounded(rounded(out, 5, "nll", "kinematic", "smooth"), 6, "bce", "sideways", "yaw"), 4, "total")


@query(f"""{S} SELECT session, count(CASE WHEN a1 > 0.5 AND speed_ms < 6 AND abs(gyr) < 0.02 AND abs(a2) < 0.35 THEN 1 END) AS at_rest, round(avg(speed_ms * (1 - 1 / (1 + exp(-a2)))), 6) AS gated FROM samples GROUP BY session""")
def zero_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = learning.zero_velocity(F.col("a1"), F.col("speed_ms") / 6, F.abs("gyr"), F.abs("a2"))
    return rounded(samples(spark, sf_dir).groupBy("session").agg(F.count_if(rest).alias("at_rest"), F.avg(learning.soft_gate(F.col("speed_ms"), F.col("a2"))).alias("gated")), 6, "gated")
