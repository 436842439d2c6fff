"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone.

Sources share ``budget`` of all sizes by weight. A source whose share exceeds
``max_epochs`` times its size is clamped there and its excess goes to the others
by weight. The fixed point of that is found in one pass: with sources in the
order of cap / weight, the first j are clamped where the level that the rest
reach, (all - their caps) / (remaining weights), lies under the next ratio.

A source then takes every document floor(target / size) whole times, and a
fractional repetition in a seeded order of its documents: documents are taken
whole until the rest of the target, rounded to words, is reached; the one
document across that point gives its first words alone. The point is found by
two levels of 1024-bucket sums over the seeded hash, so no task orders a whole
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import Scratch, lookup, word_count

WEIGHTS = (3, 1, 2)
BITS = 10


def seeded(doc_id: Column, seed: int) -> Column:
    """60 bits of the MD5 of the identifier (null: empty) and the seed, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Adds ``target`` to (key, source, source_size): one row per source, so its windows are small."""
    everything = Window.partitionBy()
    order = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((order - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(max_epochs)
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "position")
    rows = sources.withColumn("position", order).withColumn("weight", weight).withColumn("cap", cap)
    rows = rows.withColumns(
        {
            "all": F.sum("source_size").over(everything) * F.lit(float(budget)),
            "caps": F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)),
            "weights": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # The level if all sources before this one are clamped; the first that it doesn't clamp sets the level.
    level = (F.col("all") - F.coalesce("caps", F.lit(0))) / F.col("weights")
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("position"), F.col("level")))).over(everything)
    fill = F.coalesce(F.least(F.col("cap").cast("double"), first["level"] * F.col("weight")), F.col("cap").cast("double"))
    return rows.select("key", "source", "source_size", "n_docs", fill.alias("target"))


def _cut(sums: DataFrame, by: str, start: str) -> DataFrame:
    """Per key, the bucket in which the running sum reaches ``extra``, and the sum before it."""
    running = Window.partitionBy("key").orderBy(by)
    low = F.col(start) + F.sum("words").over(running) - F.col("words")
    rows = sums.withColumn("low", low).filter((F.col("low") < F.col("extra")) & (F.col("low") + F.col("words") > F.col("extra")))
    # What lies wholly inside the point has no bucket across it; where the sum meets the point exactly, the next bucket is the first out.
    return rows.select("key", F.col(by).alias(f"cut_{by}"), F.col("low").alias(f"low_{by}"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, whole, seeded place.

    Size is the number of words (null text: 0). A null source is a source of its
    own, last in order. Documents without words take nothing and their source's
    target may be 0. Rows that repeat an identifier are separate rows; where the
    seeded order ties they are ordered by size, and rows that tie there too are
    interchangeable. An empty table gives no rows. Sums are exact, so reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    source = F.col(source_col)
    sized = scratch.write(
        "sized",
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            source.alias("source"),
            F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string"))).alias("key"),
            word_count(F.col(text_col)).alias("size"),
            seeded(F.col(id_col), seed).alias("place"),
        ),
    )
    per_source = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = water_fill(per_source, budget, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("extra", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    targets = scratch.write("targets", targets)
    b1 = F.shiftright("place", 60 - BITS)
    b2 = F.shiftright("place", 60 - 2 * BITS) % (1 << BITS)
    total = sized.count()
    plan = targets.select("key", "source_size", "target", "whole", "extra", "n_docs")

    first = sized.groupBy("key", b1.alias("b1")).agg(F.sum("size").alias("words"))
    cut1 = _cut(first.join(plan, "key").withColumn("zero", F.lit(0).cast("long")), "b1", "zero")
    second = sized.withColumn("b1", b1).join(cut1.select("key", F.col("cut_b1").alias("b1"), "low_b1"), ["key", "b1"])
    second = second.groupBy("key", "low_b1", b2.alias("b2")).agg(F.sum("size").alias("words"))
    cut2 = _cut(second.join(plan, "key"), "b2", "low_b1")
    # Sums up to each cut decide every bucket that isn't across the point.
    ends = first.join(plan, "key").withColumn("low", F.sum("words").over(Window.partitionBy("key").orderBy("b1")) - F.col("words"))
    past1 = ends.filter(F.col("low") >= F.col("extra")).groupBy("key").agg(F.min("b1").alias("past_b1"))
    ends2 = second.join(plan, "key").withColumn("low", F.col("low_b1") + F.sum("words").over(Window.partitionBy("key").orderBy("b2")) - F.col("words"))
    past2 = ends2.filter(F.col("low") >= F.col("extra")).groupBy("key").agg(F.min("b2").alias("past_b2"))
    cuts = plan.join(cut1, "key", "left").join(past1, "key", "left").join(cut2, "key", "left").join(past2, "key", "left")
    cuts = scratch.write("cuts", cuts)

    rows = lookup(sized, cuts, "key", "n_docs", total, "inner").withColumn("b1", b1).withColumn("b2", b2)
    across = F.coalesce((F.col("b1") == F.col("cut_b1")) & (F.col("b2") == F.col("cut_b2")), F.lit(False))
    inside = (
        F.when(F.col("b1") == F.col("cut_b1"), F.coalesce(F.col("b2") < F.col("past_b2"), F.lit(True)))
        .otherwise(F.coalesce(F.col("b1") < F.col("past_b1"), F.lit(True)))
    )
    plain = rows.filter(~across).withColumn("part", F.when(inside, F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("key").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("low_b2") + F.sum("size").over(order) - F.col("size")
    edge = rows.filter(across).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - before)).cast("long"))
    both = plain.unionByName(edge)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part", "place")


def take(docs: DataFrame, budget: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken.

    The one document a source takes in part is taken whole if at least half of it
    is. Rows alike in identifier, source and size share their repetitions evenly,
    the first by text first. Documents without words are never taken. The columns
    of ``docs`` may have any names.
    """
    part = F.when(F.col("size") == 0, 0).when(F.col("part") * 2 >= F.col("size"), 1).otherwise(0)
    taken = mix(docs, budget=budget, max_epochs=max_epochs, seed=seed).select("doc_id", "source", "size", (F.when(F.col("size") > 0, F.col("whole")).otherwise(0) + part).alias("times"))
    taken = taken.groupBy(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("size").alias("t_size")).agg(F.sum("times").alias("times"), F.count("*").alias("alike"))
    sized = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("own"), word_count(F.col("text")).alias("words"))
    same = F.col("id").eqNullSafe(F.col("t_id")) & F.col("own").eqNullSafe(F.col("t_source")) & (F.col("words") == F.col("t_size"))
    rows = sized.join(taken.filter("times > 0"), same)
    number = F.row_number().over(Window.partitionBy("t_id", "t_source", "t_size").orderBy(F.col("row.text")))
    alone = rows.filter("alike = 1").withColumn("copies", F.col("times"))
    several = rows.filter("alike > 1").withColumn("copies", F.floor(F.col("times") / F.col("alike")) + (number <= F.col("times") % F.col("alike")).cast("long"))
    out = alone.unionByName(several).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies"))))
    return out.filter("copy > 0").select("row.*")
