"""SpotSigs document fingerprints.

A spot is a common word (an anchor); its signature is the anchor with the chain
of the next CHAIN content words, DISTANCE apart, that follow it. A document's
fingerprint is its set of signatures, each hashed to 32 bits. A text without a
full chain is one signature of all its words; a text without words has none.

``near_pairs`` compares fingerprints: documents are partitioned by the length
of their set, with borders so far apart that a partner at the threshold is in
the same or the next partition; under its rarest signatures alone a set is
listed, and the Jaccard likeness is computed only where lengths allow it.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import Scratch, WordHasher, lookup, mix64, released

CHAIN, DISTANCE, PERCENT = 2, 1, 75
#: Ranges of a few thousand rows that texts are dealt by, and rows that the driver holds for them.
MOST_RANGES = 1_000_000

#: The anchors, common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or said she that the their they this to was were which will with you "
    "auf das dem den der des die ein eine er es ich im ist mit nicht sich sie sind und von war wird zu "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les ne ou par pas pour que qui se sont sur un une "
    "al como con del el ella era fue la las lo los más no o para pero por se si sin su sus y "
).split()

#: Bytes that part words: all ASCII but letters and digits.
GAPS = bytes(c for c in range(128) if not chr(c).isalnum())


class Spotter:
    """Signature sets of many texts at once."""

    def __init__(self, chain: int = CHAIN, distance: int = DISTANCE, anchors: tuple[str, ...] = tuple(ANCHORS)) -> None:
        self.chain, self.distance, self.hasher = chain, distance, WordHasher(GAPS, seed=3)
        known = self.hasher.words([a.encode() for a in sorted(set(anchors))])[0]
        self.slots = np.zeros(1 << 16, np.uint64)
        taken: dict[int, int] = {}
        self.more = []
        for h in known.tolist():
            if h & 0xFFFF in taken:
                self.more.append(h)
            taken.setdefault(h & 0xFFFF, h)
        for slot, h in taken.items():
            self.slots[slot] = h

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        words, bounds = self.hasher.words([t.encode("utf-8", "replace").lower() for t in texts])
        anchor = self.slots[words & np.uint64(0xFFFF)] == words
        for h in self.more:
            anchor |= words == np.uint64(h)
        content = words[~anchor]
        spots = np.flatnonzero(anchor)
        begin = spots - np.arange(len(spots))  # content words before the spot: where its chain begins
        doc = np.searchsorted(bounds, spots, side="right") - 1
        end = (bounds - np.concatenate([[0], np.cumsum(anchor)])[bounds])[doc + 1]  # content words up to the text's end
        full = begin + (self.chain - 1) * self.distance < end
        spots, begin, doc = spots[full], begin[full], doc[full]
        with np.errstate(over="ignore"):
            mixed = words[spots] * np.uint64(0x9E3779B97F4A7C15)
            for k in range(self.chain):
                mixed = mix64(mixed + content[begin + k * self.distance] * np.uint64(0xC2B2AE3D27D4EB4F))
        signatures = (mixed >> np.uint64(32)).astype(np.uint32)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                out.append(np.unique(signatures[a:b]))
            else:
                own = words[bounds[k] : bounds[k + 1]]
                out.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=4).digest(), np.uint32) if len(own) else signatures[:0])
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate([a, b]))
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return inter / (len(a) + len(b) - inter)


def text_of(signatures: np.ndarray) -> str:
    """A set as text: base64 of its values, ascending, as little-endian 32-bit integers."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def _ranges(docs: DataFrame, rows_each: int = 4000) -> DataFrame:
    """Adds ``range``, ascending with doc_id (null first) and ``tie``, of about ``rows_each`` rows.

    Borders are approximate quantiles. An identifier that several quantiles fall on
    fills that many ranges, and so do rows without one; these are split by ``tie``.
    """
    count, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(MOST_RANGES, count // rows_each))
    cuts = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else None
    times = Counter(cuts or [])
    borders = sorted(times)
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))
    if borders:
        splits = [-math.inf, *(float(x) for x in borders), math.inf]
        rows = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(docs.withColumn("place", place)).drop("place")
    else:
        rows = docs.withColumn("bucket", F.lit(0.0))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("bucket").cast("int")))
    heavy = [(k + 1, v, times[v]) for k, v in enumerate(borders) if times[v] > 1] + [(-1, None, max(1, nulls // rows_each))]
    most = max(n for *_, n in heavy) + 1
    split = F.broadcast(docs.sparkSession.createDataFrame(heavy, "bucket int, v long, pieces int"))  # a row a border at most
    own = (F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("pieces")
    piece = F.when(F.col("pieces").isNotNull() & F.col("doc_id").eqNullSafe(F.col("v")), F.least(F.floor(own), F.col("pieces") - 1)).otherwise(F.lit(most - 1))
    return rows.join(split, "bucket", "left").withColumn("range", F.col("bucket").cast("long") * most + piece).drop("bucket", "v", "pieces")


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """Gives ``run`` each range's rows in order, followed by the first row of the next range.

    Rows are dealt by ranges of a few thousand rows, so whole texts are shuffled
    once and no task holds more than its range. The last range is followed by the first row of all.
    Batches have columns doc_id, text, range and extra (1 for the added row).
    """
    ranged = _ranges(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")))
    heads = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("head")).collect()  # a row a range
    order = sorted(r["range"] for r in heads)
    before = {r: order[k - 1] for k, r in enumerate(order)}
    spark = docs.sparkSession
    table = [(r["range"], r["head"]["doc_id"], r["head"]["tie"], before[r["range"]]) for r in heads]
    first = F.broadcast(spark.createDataFrame(table, "r long, d long, t long, previous long"))
    hit = (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    rows = ranged.join(first, hit, "left")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("extra"))
    added = F.struct(F.col("previous").alias("range"), F.lit(1).alias("extra"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("previous").isNotNull(), F.array(own, added)).otherwise(F.array(own))))
    rows = rows.select(F.col("to.range").alias("range"), F.col("to.extra").alias("extra"), "doc_id", "tie", "text")
    parts = max(len(order), 1)
    dealt = rows.repartition(parts, "range").sortWithinPartitions("range", "extra", "doc_id", "tie")
    return dealt.select("range", "extra", "doc_id", "text").mapInArrow(released(run), schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """doc_id, n_signatures, signatures (ascending, as longs) for every row; a null text is empty."""

    def run(batches):
        spotter = Spotter(chain, distance)
        for b in batches:
            sets = spotter.sets([t or "" for t in b.column("text").to_pylist()])
            lists = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), lists], ["doc_id", "n_signatures", "signatures"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), "doc_id long, n_signatures long, signatures array<long>")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses; one row per row of ``docs``.

    The edited text has its last floor(n / 4) code points replaced by the first as
    many, or all, of the next row's text, in ascending order of doc_id (null first,
    ties by a hash of the text); the last row is followed by the first, and a
    single row by itself. Null text is empty. Equal texts have equal fingerprints,
    and two empty fingerprints have likeness 1. An empty table gives no rows; rows
    that repeat an identifier, or have none, are separate rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        spotter = Spotter()

        def done(rows: list[tuple]) -> pa.RecordBatch:
            """Of rows (range, extra, doc_id, text): results of each that has its next row here."""
            texts = [r[3] for r in rows]
            own = spotter.sets(texts)
            pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
            edits = []
            for k in pairs:
                n = len(texts[k])
                edits.append(texts[k][: n - n // 4] + texts[k + 1][: n // 4])
            new = spotter.sets(edits)
            shown = [text_of(s) for s in own]
            columns = [
                pa.array([rows[k][2] for k in pairs], pa.int64()),
                pa.array([len(texts[k]) for k in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edits], pa.string()),
                pa.array([shown[k] for k in pairs], pa.string()),
                pa.array([text_of(s) for s in new], pa.string()),
                pa.array([likeness(own[k], s) for k, s in zip(pairs, new, strict=True)], pa.float64()),
                pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("range", "extra", "doc_id")), (t or "" for t in b.column("text").to_pylist()), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= 1 << 20 and len(held) > 1:
                    yield done(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield done(held)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(prints: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, likeness for every pair of fingerprint classes at the threshold or over it; ``members`` says who is in a class.

    ``prints`` is fingerprints(). Equal non-empty sets form a class named by its
    smallest doc_id; rows without an identifier and empty sets link with nothing.
    Sets are listed under the signatures that prefix filtering needs, rarest first.
    """
    scratch = Scratch(prints.sparkSession, "spotsigs")
    sets = prints.filter("n_signatures > 0 and doc_id is not null").groupBy("signatures").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("signatures"))
    sets = scratch.write("sets", sets)
    listed = sets.select("id", "n", F.explode("signatures").alias("s"))
    common = scratch.write("common", listed.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"))
    total = sets.select(F.sum("n")).first()[0] or 0
    shared = lookup(listed, common, "s", "df", total, "inner")
    per = shared.groupBy("id", "n").agg(F.array_sort(F.collect_set(F.struct("df", "s"))).alias("x"))
    per = per.withColumn("take", (F.size("x") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1).cast("int")).filter("take > 0")
    step = math.log(100 / percent)
    part = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    rows = per.select("id", "n", part.alias("part"), F.explode(F.slice("x", F.lit(1), F.col("take"))).alias("y"))
    rows = scratch.write("postings", rows.select("id", "n", "part", F.col("y.s").alias("s")))
    left = rows.select("s", "part", F.col("id").alias("a"), F.col("n").alias("na"))
    right = rows.select("s", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("part").alias("own"), F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    once = (F.col("own") > F.col("part")) | (F.col("a") < F.col("b"))
    met = left.join(right, ["s", "part"]).filter(fits & once & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    a = sets.select(F.col("id").alias("a"), F.col("signatures").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("signatures").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    jaccard = inter / (F.size("sa") + F.size("sb") - inter)
    return met.join(a, "a").join(b, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard.alias("likeness")).filter(F.col("likeness") * 100 >= percent)


def members(prints: DataFrame) -> DataFrame:
    """doc_id, class_id: the smallest doc_id of the rows with an equal, non-empty set (their own otherwise)."""
    full = prints.filter("n_signatures > 0 and doc_id is not null").select("doc_id", F.xxhash64("signatures").alias("h"), "signatures")
    classes = full.groupBy("signatures").agg(F.min("doc_id").alias("class_id"))
    rest = prints.filter("n_signatures = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return full.join(classes, "signatures").select("doc_id", "class_id").unionByName(rest)
