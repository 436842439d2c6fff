"""Map sources: OSM extracts as OPL text, region outlines, stored graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import geo
from tarmac.operators import roadgraph

#: Road classes one may drive on, and those that are one-way without saying so.
DRIVABLE = (
    "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential living_street service road"
).split()
ONEWAY_HIGHWAY, ONEWAY_JUNCTION = ("motorway", "motorway_link"), ("roundabout", "circular")


def read_opl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lat, lon) and drivable ways (way, refs, oneway, highway) of OPL lines."""
    return parse_opl(spark.read.text(path))


def _field(letter: str) -> Column:
    return F.regexp_extract("value", rf"(?:^| ){letter}(\S*)", 1)


def parse_opl(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of a DataFrame with one line a row in ``value``."""
    nodes = lines.filter("startswith(value, 'n')").select(F.regexp_extract("value", r"^n(-?\d+)", 1).try_cast("long").alias("node"), _field("y").try_cast("double").alias("lat"), _field("x").try_cast("double").alias("lon"))
    tags = F.str_to_map(_field("T"), F.lit(","), F.lit("="))
    ways = lines.filter("startswith(value, 'w')").select(F.regexp_extract("value", r"^w(-?\d+)", 1).try_cast("long").alias("way"), tags.alias("tags"), _field("N").alias("refs"))
    tag = lambda k: F.coalesce(F.element_at("tags", F.lit(k)), F.lit(""))
    kept = ways.filter(tag("highway").isin(*DRIVABLE) & ~tag("access").isin("no", "private"))
    refs = F.transform(F.filter(F.split("refs", ","), lambda r: r.startswith("n")), lambda r: F.substring(r, F.lit(2), F.length(r)).try_cast("long"))
    oneway = tag("oneway").isin("yes", "true", "1", "-1") | tag("highway").isin(*ONEWAY_HIGHWAY) | tag("junction").isin(*ONEWAY_JUNCTION)
    out = kept.select("way", F.when(tag("oneway") == "-1", F.reverse(refs)).otherwise(refs).alias("refs"), oneway.alias("oneway"), tag("highway").alias("highway"))
    return nodes.filter("node is not null and lat is not null and lon is not null"), out.filter(F.size("refs") > 1)


def from_ways(spark: SparkSession, nodes: dict[int, tuple[float, float]], ways: list[tuple[list[int], bool]], highway: str = "") -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of literals."""
    n = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in nodes.items()], "node long, lat double, lon double")
    return n, spark.createDataFrame([(k, refs, one, highway) for k, (refs, one) in enumerate(ways)], "way long, refs array<long>, oneway boolean, highway string")


class RoadGraph:
    """Edges, segments and directions as tables; written once and read again."""

    TABLES = ("edges", "segments", "directed")

    def __init__(self, edges: DataFrame, segments: DataFrame, directed: DataFrame) -> None:
        self.edges, self.segments, self.directed = edges, segments, directed

    @classmethod
    def build(cls, nodes: DataFrame, ways: DataFrame, metres=geo.distance) -> RoadGraph:
        edges = roadgraph.split_at_junctions(ways, nodes)
        segments = roadgraph.segments(edges, nodes, metres)
        return cls(edges, segments, roadgraph.directed(edges, segments))

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RoadGraph:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES))

    @classmethod
    def open(cls, spark: SparkSession, path: str, build) -> RoadGraph:
        """The stored graph, or the one that ``build()`` gives, stored."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/directed/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            build().save(path)
        return cls.load(spark, path)


def outline_box(coordinates: Column) -> Column:
    """south, west, north, east of a multi-polygon: arrays of polygons of rings of [lon, lat]."""
    points = F.flatten(F.flatten(coordinates))
    of = lambda i, f: f(F.transform(points, lambda p: F.element_at(p, i)))
    return F.struct(of(2, F.array_min).alias("south"), of(1, F.array_min).alias("west"), of(2, F.array_max).alias("north"), of(1, F.array_max).alias("east"))


def select_regions(regions: DataFrame, root: str, box: tuple[float, float, float, float], depth: int = 8) -> DataFrame:
    """Leaves under ``root`` (id, parent, coordinates) whose outline's box meets ``box`` (south, west, north, east)."""
    below = regions.filter(F.col("id") == root).select("id")
    found = below
    for _ in range(depth):
        below = regions.join(below.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
        found = found.union(below)
    leaves = regions.join(found.distinct(), "id", "left_semi").join(regions.select(F.col("parent").alias("id")), "id", "left_anti")
    rows = leaves.withColumn("box", outline_box(F.col("coordinates")))
    own = tuple(F.col(f"box.{c}") for c in ("south", "west", "north", "east"))
    return rows.filter(geo.boxes_meet(own, tuple(F.lit(float(v)) for v in box))).select("id", "box.*")


def save_box(spark: SparkSession, box: dict[str, float], path: str) -> None:
    spark.createDataFrame([box]).coalesce(1).write.mode("overwrite").json(path)


def load_box(spark: SparkSession, path: str) -> dict[str, float]:
    return spark.read.json(path).first().asDict()
