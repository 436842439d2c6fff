"""URL filters by a temporal list join, in DataFrame functions alone.

A list is a log of dated entries that add or remove a pattern: a host, which
covers its subdomains, or a prefix, a host with leading path segments. Each
addition becomes a validity interval up to the next entry of the same pattern. A
capture is looked up under its host's suffixes and its prefixes, and the entries
active at its fetch time decide: the longest pattern wins, then the latest entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import Scratch, lookup

#: Rows of a list that are broadcast (about 20 MB); a longer list is joined by shuffle.
BROADCAST_ROWS = 200_000

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """entry_id, kind, pattern, category, valid_from, valid_to (exclusive, null: open) of every addition that is ever active.

    ``entries`` has entry_id, listed_on, action (add, remove), kind (host, prefix),
    pattern, category. Of entries of a pattern with one date the largest entry_id
    counts. Entries without a date or pattern are left out.
    """
    log = entries.filter("listed_on is not null and pattern is not null").withColumn("pattern", F.lower("pattern"))
    own = Window.partitionBy("kind", "pattern").orderBy("listed_on", "entry_id")
    rows = log.withColumn("valid_to", F.lead("listed_on").over(own)).filter("action = 'add' and (valid_to is null or valid_to > listed_on)")
    return rows.select("entry_id", "kind", "pattern", "category", F.col("listed_on").alias("valid_from"), "valid_to")


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def _keys(segments: int) -> Column:
    """Lookup keys of a capture: its host's suffixes and its prefixes of up to ``segments`` path segments."""
    labels = F.split(F.col("host"), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern")))
    parts = F.filter(F.split(F.lower("path"), "/"), lambda p: p != "")
    depth = F.least(F.size(parts), F.lit(segments))
    prefix = lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern"))
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), prefix)).otherwise(F.expr("cast(array() as array<struct<kind: string, pattern: string>>)"))
    return F.when(F.col("host") == "", F.array(F.struct(F.lit("none").alias("kind"), F.lit("").alias("pattern")))).otherwise(F.concat(hosts, prefixes))


def evaluate(captures: DataFrame, entries: DataFrame, allow: str = "allow") -> DataFrame:
    """page_id, url, fetched_on, host, copies, n_active, entry_id, category, blocked: one row per distinct capture.

    ``captures`` has page_id, url, fetched_on. Captures that repeat all three are
    one row with their number. A null or malformed URL has host '' and matches
    nothing; a capture without a fetch time matches nothing. Only the three
    columns are read. ``blocked`` is true if the deciding entry's category isn't ``allow``.
    """
    active = intervals(entries)
    sizes = active.agg(F.count("*").alias("n"), F.max(F.size(F.split("pattern", "/")) - 1).alias("segments")).first()
    url = F.coalesce(F.col("url"), F.lit(""))
    capture = ["page_id", "url", "fetched_on"]
    rows = captures.groupBy(*capture).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", F.regexp_extract(url, PATH, 1))
    keyed = rows.withColumn("key", F.explode(_keys(sizes["segments"] or 0))).select(*capture, "host", "copies", "key")
    during = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    own = active.withColumn("key", F.struct("kind", "pattern"))
    deciding = F.max(F.when(F.col("entry_id").isNotNull(), F.struct(F.length("pattern").alias("size"), "valid_from", "entry_id", "category"))).alias("best")
    if sizes["n"] <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(own.drop("kind")).withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & during, "left")
        out = met.groupBy(*capture, "host", "copies").agg(F.count("entry_id").alias("n_active"), deciding)
    else:
        out = _shuffled(rows.select(*capture, "host", "copies"), keyed.select(*capture, "key"), own, during, deciding, capture)
    blocked = F.coalesce(F.col("best.category") != allow, F.lit(False))
    return out.select("page_id", "url", "fetched_on", "host", "copies", "n_active", F.col("best.entry_id").alias("entry_id"), F.col("best.category").alias("category"), blocked.alias("blocked"))


def _shuffled(rows: DataFrame, keyed: DataFrame, active: DataFrame, during: Column, deciding: Column, capture: list[str]) -> DataFrame:
    """The join with a list too long to broadcast. Keys that no entry has never move with their captures, and those that very many captures have are broadcast."""
    scratch = Scratch(rows.sparkSession, "url-filter")
    keyed = scratch.write("keys", keyed)
    fields = ["entry_id", "pattern", "category", "valid_from", "valid_to"]
    listed = active.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("entries"))
    weights = keyed.groupBy("key").agg(F.count("*").alias("weight"))  # partial sums first: a hot key has a row a task
    listed = scratch.write("listed", listed.join(weights, "key"))
    met = lookup(keyed, listed, "key", "weight", keyed.count(), "inner").withColumn("e", F.explode("entries")).select(*capture, *(F.col(f"e.{c}").alias(c) for c in fields)).filter(during)
    best = met.groupBy(*(F.col(c).alias(f"b_{c}") for c in capture)).agg(F.count("entry_id").alias("n_active"), deciding)
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in capture]
    return rows.join(best, same[0] & same[1] & same[2], "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))
