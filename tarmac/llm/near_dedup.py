"""MinHash near-dedup with bottom-k sketches from one hash function.

1. *Sketch*: a document's set of five-word shingles is hashed once; its k smallest
   values are its sketch. Equal sets form a class; one representative goes on.
2. *Inverted lists* of retained values that several representatives share. Two
   sets at the threshold share ``need`` retained values but for a chance under
   1e-9 (all of them, for sets that fit their sketches), so a representative with s
   shared values is listed under its s - need + 1 rarest alone: passages that
   many documents share produce no candidates unless they fill most of a sketch.
3. *Pivots*: members of a list are paired with the list's most central one, not
   with one another: its cluster.
4. *Estimate*: the bottom k of the union of two sketches estimates the Jaccard
   likeness; pairs far under the threshold go.
5. *Verification*: exact Jaccard on the full shingle sets of whole texts.
6. *Rest*: links are merged into components. What a pivot did not join is
   compared with its whole cluster, block by block inside a task; of the pairs
   there, only links that join components are ever written as rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Scratch, WordHasher, chunks, lookup, lowered, mix64, released
from tarmac.llm.components import components

SHINGLE, PERCENT = 5, 75
SKETCH, NEED, LEAST_ESTIMATE = 64, 24, 0.40
#: Identifiers or verification requests that may be broadcast (about 30 MB); more are joined by shuffle.
BROADCAST_ROWS = 400_000
#: Texts in a block; a cell holds two blocks at most.
BLOCK = 256


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Per text its distinct shingles' 63-bit hashes, ascending; a text of fewer words has one of all its words."""
    with np.errstate(over="ignore"):
        odd = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : k + n] * odd[k]
        rolled = mix64(rolled) >> np.uint64(1)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = mix64(np.array([short * np.uint64(31) + w]))[0]
                out.append(np.array([short >> np.uint64(1)], np.uint64))
            else:
                out.append(rolled[:0])
    return out


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """doc_id, n (set size), set_key (digest of the set), sketch (its k smallest values, ascending)."""

    def run(batches):
        hasher = WordHasher()
        for ids, texts in chunks(batches, ["doc_id", "text"]):
            sets = shingle_hashes(*hasher.words([lowered(t) for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:k].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "set_key", "sketch"],
            )

    return docs.mapInArrow(released(run), "doc_id long, n long, set_key binary, sketch array<long>")


def _similar_size(a: str, b: str, percent: int) -> F.Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _postings(reps: DataFrame, scratch: Scratch, k: int, need: int, percent: int) -> DataFrame:
    """v, id, n, central: representatives under the rarest of the retained values that they share."""
    listed = reps.select("id", "n", F.explode("sketch").alias("v"))
    common = scratch.write("common", listed.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"))
    total = reps.select(F.sum(F.size("sketch"))).first()[0] or 0
    shared = lookup(listed, common, "v", "df", total, "inner")
    least = F.least(F.lit(need), F.ceil(F.col("n") * F.lit(percent) / 100)).cast("int")
    per_doc = shared.groupBy("id", "n").agg(F.array_sort(F.collect_set(F.struct("df", "v"))).alias("values"))
    per_doc = per_doc.withColumn("extra", F.size("values") - least + 1).filter("extra > 0")
    central = F.aggregate("values", F.lit(0.0), lambda s, x: s + F.log(x["df"].cast("double")))
    rows = per_doc.select("id", "n", central.alias("central"), F.explode(F.slice("values", F.lit(1), F.col("extra"))).alias("x"))
    return scratch.write("postings", rows.select(F.col("x.v").alias("v"), "id", "n", "central"))


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs (a, b) whose union sketch estimates a likeness of ``least`` or more."""
    a = reps.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    b = reps.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = pairs.join(a, "a").join(b, "b").withColumn("u", union)
    likeness = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))) / F.size("u")
    return both.filter(likeness >= least).select("a", "b").distinct()


def _candidates(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Texts of the documents that are in some cluster."""
    ids = clusters.select(F.col("id").alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _requested(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (doc_id, ...) with their texts; few of them are broadcast, more meet the texts in a shuffle."""
    few = requests.count() <= BROADCAST_ROWS
    return texts.select("doc_id", "text").join(F.broadcast(requests) if few else requests, "doc_id")


def verify(texts: DataFrame, pairs: DataFrame, percent: int = PERCENT, group: int = 256) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least this Jaccard likeness.

    A group is one text a and about ``group`` partners, so a text with very many
    partners is sent once for each such group and no task holds more than two texts.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = lookup(pairs, counts, "a", "m", pairs.count(), "inner").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / group)))
    requests = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("doc_id")).unionByName(
        dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct()
    )

    def run(batches):
        held, own, hasher = None, None, WordHasher()
        for keys, parts, roles, ids, texts in chunks(batches, ["a", "part", "role", "doc_id", "text"]):
            sets = shingle_hashes(*hasher.words([lowered(t) for t in texts]))
            found = []
            for key, part, role, i, s in zip(keys, parts, roles, ids, sets, strict=True):
                if role == 0:
                    held, own = (key, part), s
                elif held == (key, part):
                    inter = len(np.intersect1d(own, s, assume_unique=True))
                    if inter and 100 * inter >= percent * (len(own) + len(s) - inter):
                        found.append((key, i))
            if found:
                yield _links(found)

    ordered = _requested(texts, requests).repartition("a", "part").sortWithinPartitions("a", "part", "role").select("a", "part", "role", "doc_id", "text")
    return ordered.mapInArrow(released(run), "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def shared_counts(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Sizes of the intersections of the sets before ``first`` (rows) with those from ``first`` on, or of all with all if it is 0."""
    sizes = np.array([len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, keep = np.repeat(np.arange(len(sets)), sizes), times[column] > 1
    owner, column = owner[keep], column[keep]
    new = np.cumsum(times > 1) - 1
    column = new[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, width = int(column[-1]) + 1 if len(column) else 0, 4096
    out = np.zeros((first or len(sets), len(sets) - first), np.int64)
    cuts = np.searchsorted(column, np.arange(0, n + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        m = np.zeros((len(sets), min(width, n - k * width)), np.float32)
        m[owner[a:b], column[a:b] - k * width] = 1
        out += np.rint(m[: first or len(sets)] @ m[first:].T).astype(np.int64)
    return out


def _across(clusters: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a cluster in different components, enough to join those that are linked.

    ``clusters`` has a (its pivot) and id. Members in the pivot's component are one
    another's already; the others are compared with all. Both kinds are dealt to
    blocks of about BLOCK texts, and each pair of blocks that must meet is a cell;
    a cell's pairs are counted in its task and only links that join components leave it.
    """
    known = clusters.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = labels.select(F.col("id").alias("a"), F.col("component").alias("base"))
    known = known.join(own, "a", "left").withColumn("rest", F.col("component") != F.coalesce("base", "a"))
    sizes = known.groupBy("a").agg(F.count_if("rest").alias("u"), F.count_if(~F.col("rest")).alias("l")).filter("u > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = known.join(sizes.select("a", blocks("u").alias("bu"), blocks("l").alias("bl")), "a")
    own_block = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("bu")).otherwise(F.col("bl"))).cast("int")
    rows = rows.withColumn("own", own_block)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    within = F.transform(upto("bu"), lambda j: cell("uu", F.least(F.col("own"), j), F.greatest(F.col("own"), j), F.when(j < F.col("own"), one).otherwise(zero)))
    to_linked = F.transform(upto("bl"), lambda j: cell("ul", F.col("own"), j, zero))
    from_linked = F.transform(upto("bu"), lambda i: cell("ul", i, F.col("own"), one))
    cells = rows.withColumn("c", F.explode(F.when(F.col("rest"), F.concat(within, to_linked)).otherwise(from_linked)))
    requests = cells.select(F.col("id").alias("doc_id"), "a", "c.kind", "c.i", "c.j", "c.side", "component")

    def run(batches):
        hasher, held, key = WordHasher(), [], None

        def joined():
            sets = [s for _, _, _, s in held]
            ids, comps = [i for i, *_ in held], np.array([c for _, c, *_ in held])
            first = sum(1 for *_, side, _ in held if side == 0) if key[1] == "ul" or key[2] != key[3] else 0
            if len(held) < 2 or first == len(held):
                return []
            n, top = np.array([len(s) for s in sets]), first or len(held)
            both = shared_counts(sets, first)
            close = (100 * both >= percent * (n[:top, None] + n[None, first:] - both)) & (comps[:top, None] != comps[None, first:])
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            found = []
            for x, y in np.argwhere(close).tolist():
                y += first
                p, q = root(int(comps[x])), root(int(comps[y]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((ids[x], ids[y]))
            return found

        for *keys, sides, comps, ids, texts in chunks(batches, ["a", "kind", "i", "j", "side", "component", "doc_id", "text"]):
            sets = shingle_hashes(*hasher.words([lowered(t) for t in texts]))
            found = []
            for k, side, comp, i, own in zip(zip(*keys, strict=True), sides, comps, ids, sets, strict=True):
                if k != key:
                    found += joined() if held else []
                    held, key = [], k
                held.append((i, comp, side, own))
            if found:
                yield _links(found)
        if held and (found := joined()):
            yield _links(found)

    by = ["a", "kind", "i", "j"]
    ordered = _requested(texts, requests).repartition(*by).sortWithinPartitions(*by, "side", "doc_id").select(*by, "side", "component", "doc_id", "text")
    return ordered.mapInArrow(released(run), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SKETCH, need: int = NEED, least: float = LEAST_ESTIMATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; a text of one to four words has one shingle of them all;
    a text without words (null, empty or blank) has none, links with nothing and
    is its own component. Rows that repeat an identifier are versions of one
    document and share its links. Rows without an identifier cannot be named by
    a link: they are kept, with a null component. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.filter(F.col("doc_id").isNotNull())
    sketched = scratch.write("sketches", sketches(docs, k))
    classes = sketched.filter("n > 0 and doc_id is not null").groupBy("set_key", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("members"))
    classes = scratch.write("classes", classes)
    reps = sketched.join(classes.select("set_key", F.col("id").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    reps = scratch.write("representatives", reps.select(F.col("doc_id").alias("id"), "n", "sketch"))
    postings = _postings(reps, scratch, k, need, percent)

    central = F.max_by(F.struct("id", "n"), F.struct("central", -F.col("id"))).alias("pivot")
    pivots = postings.groupBy("v").agg(central, F.count("*").alias("m"))
    members = lookup(postings, pivots.select("v", "m", F.col("pivot.id").alias("a"), F.col("pivot.n").alias("na")), "v", "m", postings.count(), "inner")
    clusters = scratch.write("clusters", members.select("a", "na", "id", "n").distinct())
    texts = scratch.write("texts", _candidates(named, clusters))
    star = clusters.filter((F.col("a") != F.col("id")) & _similar_size("na", "n", percent)).select("a", F.col("id").alias("b"))
    tested = scratch.write("star", _estimated(star, reps, k, least))
    links = scratch.write("links-1", verify(texts, tested, percent))
    labels = components(links, scratch, "first")
    more = scratch.write("links-2", _across(clusters.select("a", "id"), labels, texts, percent))
    labels = components(links.union(more), scratch, "all")

    named_class = classes.join(labels, "id", "left").select("set_key", "members", F.coalesce("component", "id").alias("component_id"))
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    found = lookup(full, named_class, "set_key", "members", full.count(), "inner").select("doc_id", "n_shingles", "component_id")
    rest = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.unionByName(rest)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that near_dedup keeps: one document of each group, and rows without an identifier.

    Rows that repeat an identifier stay or go together. The columns may have any names.
    """
    gone = near_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    gone = Scratch(docs.sparkSession, "near-copies").write("gone", gone)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
