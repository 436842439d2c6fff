"""Connected components by contraction: no links or labels ever reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id reachable.

    Each round every vertex joins its smallest neighbour if that is smaller, two
    pointer jumps follow, and edges are mapped to their ends' labels. All but
    local minima vanish in a round, so rounds grow with the logarithm of the
    vertices. The smallest vertex of a component never moves, so it stays as label.
    """
    edges = scratch.write(f"{name}-edges-0", edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = scratch.write(f"{name}-labels-0", edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("component")))
    for k in range(1, max_rounds + 1):
        if not edges.limit(1).count():
            break
        both = edges.union(edges.select("b", "a"))
        to = scratch.write(f"{name}-to-{k}", both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")))
        for _ in range(2):
            up = to.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            to = to.join(up, "p").select("v", F.col("pp").alias("p"))
        to = scratch.write(f"{name}-jump-{k}", to)
        new = edges.join(to.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(to.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        new = new.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        moved = labels.join(to, labels["component"] == to["v"], "left").select("id", F.coalesce("p", "component").alias("component"))
        edges, labels = scratch.write(f"{name}-edges-{k}", new), scratch.write(f"{name}-labels-{k}", moved)
        for old in (f"{name}-edges-{k - 1}", f"{name}-labels-{k - 1}", f"{name}-to-{k}", f"{name}-jump-{k}"):
            scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels
