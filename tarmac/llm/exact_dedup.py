"""Exact dedup by a log-structured merge index of text digests.

1. *Log*: one pass over the texts writes (doc_id, digest) to the scratch folder.
2. *Memtables*: each task gathers log entries in a table of bounded size; when it
   is full it is flushed as a run sorted by digest, one entry a digest with the
   smallest identifier so far and a count. Runs are stored, each with a Bloom
   filter of its digests.
3. *Compaction*: each task has a range of digests of all runs in digest order and
   merges neighbours: equal digests keep their smallest identifier and the sum of
   their counts. Digests that several rows have are the index.
4. *Hits*: the filters of the index's runs, or where they are too large to be sent
   to every task a join of log and index, tell which rows' bytes are read again.
5. *Byte verification*: a hit's bytes are compared with those of the row that
   its group keeps. Groups in which any comparison fails are formed anew by
   digest and bytes, so truncated or colliding digests cannot merge texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import HEAVY, Scratch, lookup, lowered, released


def _log(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            digests = [hashlib.sha256(lowered(t)).digest() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary())], ["doc_id", "sha"])

    return docs.mapInArrow(released(run), "doc_id long, sha binary")


#: Bits of a run's filter for each of its digests, and places of a digest in it; bytes of all filters that are sent to every task.
BITS_A_KEY, PLACES, SENT = 12, 4, 32 << 20
#: Rows that may be broadcast (about 40 MB); more are joined by shuffle.
BROADCAST_ROWS = 400_000


def _places(keys: list[bytes], size: int) -> list[np.ndarray]:
    """The keys' places in a filter of ``size`` bits, from two numbers of each."""
    pair = np.frombuffer(b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys), np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        return [((pair[:, 0] + np.uint64(i) * (pair[:, 1] | np.uint64(1))) % np.uint64(size)).astype(np.int64) for i in range(PLACES)]


def filter_of(keys: list[bytes]) -> bytes:
    """A Bloom filter; its size follows the number of keys."""
    bits = np.zeros(max(64, -(-BITS_A_KEY * len(keys) // 8) * 8), bool)
    for at in _places(keys, len(bits)):
        bits[at] = True
    return np.packbits(bits).tobytes()


def part_of(key: bytes, parts: int) -> int:
    """The range that a digest is in."""
    return int.from_bytes(key[:4].ljust(4, b"\0"), "big") * parts >> 32


def maybe_held(keys: list[bytes], filters: dict[int, list[np.ndarray]], parts: int) -> np.ndarray:
    """Whether a filter of its range may hold each key."""
    out, by = np.zeros(len(keys), bool), {}
    for k, key in enumerate(keys):
        by.setdefault(part_of(key, parts), []).append(k)
    for part, own in by.items():
        for bits in filters.get(part, ()):
            hit = np.ones(len(own), bool)
            for at in _places([keys[k] for k in own], len(bits)):
                hit &= bits[at]
            out[own] |= hit
    return out


ENTRY = "part int, key binary, rank long, n long, filter binary"


def _run(entries: list[tuple], part: int) -> pa.RecordBatch:
    """A sorted run's entries (key, rank, n), the first of which carries the run's filter."""
    keys, ranks, n = zip(*entries, strict=True)
    filters = [filter_of(list(keys)), *[None] * (len(keys) - 1)]
    columns = [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array(ranks, pa.int64()), pa.array(n, pa.int64()), pa.array(filters, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "key", "rank", "n", "filter"])


def _flush(log: DataFrame, memtable_rows: int, sign: int, parts: int) -> DataFrame:
    """Sorted runs by ranges of digests; rank is sign * doc_id, null if all identifiers of the digest are null."""

    def run(batches):
        table: dict[bytes, list] = {}

        def flushed():
            runs: dict[int, list] = {}
            for key in sorted(table):
                runs.setdefault(part_of(key, parts), []).append((key, *table[key]))
            table.clear()
            for part, entries in runs.items():
                yield _run(entries, part)

        for b in batches:
            for i, key in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), strict=True):
                rank = None if i is None else sign * i
                if (entry := table.get(key)) is None:
                    table[key] = [rank, 1]
                    if len(table) >= memtable_rows:
                        yield from flushed()
                else:
                    entry[1] += 1
                    if rank is not None and (entry[0] is None or rank < entry[0]):
                        entry[0] = rank
        if table:
            yield from flushed()

    return log.select("doc_id", "key").mapInArrow(released(run), ENTRY)


def _compact(runs: DataFrame, parts: int, most: int = 1 << 17) -> DataFrame:
    """Merges the runs of each range in digest order; digests that several rows have go on, as runs of ``most`` entries at most."""

    def run(batches):
        held, part, out = None, 0, []
        for b in batches:
            for own, key, rank, n in zip(*(b.column(c).to_pylist() for c in ("part", "key", "rank", "n")), strict=True):
                if held and held[0] == key:
                    ranks = [r for r in (held[1], rank) if r is not None]
                    held = (key, min(ranks, default=None), held[2] + n)
                    continue
                if held and held[2] > 1:
                    out.append(held)
                    if len(out) == most:
                        yield _run(out, part)
                        out = []
                held, part = (key, rank, n), own
        if held and held[2] > 1:
            out.append(held)
        if out:
            yield _run(out, part)

    return runs.select("part", "key", "rank", "n").repartition(parts, "part").sortWithinPartitions("part", "key").mapInArrow(released(run), ENTRY)


def _probe(docs: DataFrame, digest_bytes: int, held) -> DataFrame:
    """Rows whose digest may be ``held`` (a function of digests), with their bytes."""

    def run(batches):
        for b in batches:
            bodies = [lowered(t) for t in b.column("text").to_pylist()]
            keys = [hashlib.sha256(x).digest()[:digest_bytes] for x in bodies]
            hit = np.flatnonzero(held(keys)).tolist()
            ids = b.column("doc_id").to_pylist()
            for at in range(0, len(hit), 1000):
                own = hit[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in own], pa.int64()), pa.array([keys[k] for k in own], pa.binary()), pa.array([bodies[k] for k in own], pa.binary())], ["doc_id", "key", "body"])

    return docs.mapInArrow(released(run), "doc_id long, key binary, body binary")


def _hits(docs: DataFrame, log: DataFrame, index: DataFrame, total: int, parts: int, digest_bytes: int, sent: int) -> DataFrame:
    """Rows whose bytes must be read again: by the filters of the index's runs, or by a join where those are over ``sent`` bytes."""
    runs = index.filter("filter is not null")
    if (runs.agg(F.sum(F.length("filter"))).first()[0] or 0) <= sent:
        filters: dict[int, list[np.ndarray]] = {}
        for r in runs.select("part", "filter").collect():  # ``sent`` bytes at most
            filters.setdefault(r["part"], []).append(np.unpackbits(np.frombuffer(r["filter"], np.uint8)).astype(bool))
        return _probe(docs, digest_bytes, lambda keys: maybe_held(keys, filters, parts))
    ids = lookup(log.select("doc_id", "key"), index.select("key", "n"), "key", "n", total, "inner").select(F.col("doc_id").alias("hit")).distinct()
    return _probe(docs.join(ids, docs["doc_id"].eqNullSafe(ids["hit"]), "left_semi"), digest_bytes, lambda keys: np.ones(len(keys), bool))


def _mismatches(probe: DataFrame, index: DataFrame, total: int, salts: int = 64) -> DataFrame:
    """Keys of several rows of which any row's bytes differ from those of the row that is kept. ``probe`` is stored: four branches read it."""
    held = index.select("key", "keep_id", "n")
    heavy = F.col("n") * HEAVY > total
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))

    def differing(hits: DataFrame, *salt: str) -> DataFrame:
        first = hits.filter(own).groupBy("key").agg(F.min("body").alias("kept_body"))
        if salt:
            first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return hits.join(first, ["key", *salt]).filter(F.col("body") != F.col("kept_body")).select("key")

    hot = probe.join(F.broadcast(held.filter(heavy)), "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    cold = probe.join(held.filter(~heavy), "key")
    out = differing(cold)
    if index.filter(heavy).limit(1).count():
        out = out.unionByName(differing(hot, "salt"))
    return out.distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = 1 << 17, digest_bytes: int = 32, sent: int = SENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty. Of equal texts the row with the smallest (or ``keep="largest"``)
    identifier stays. Rows without an identifier come last: they stay only in
    groups where no row has one (keep_id is then null). Of rows that repeat both
    identifier and text exactly one is kept. Other columns are not read, so
    their names cannot clash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch, sign = Scratch(spark, "exact-dedup"), -1 if keep == "largest" else 1
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    log = scratch.write("log", _log(docs).withColumn("key", F.expr(f"substring(sha, 1, {int(digest_bytes)})")).withColumn("sha", F.lower(F.hex("sha"))))
    total = log.count()
    parts = max(8, -(-total // memtable_rows))
    runs = scratch.write("runs", _flush(log, memtable_rows, sign, parts))
    compacted = scratch.write("compacted", _compact(runs, parts))
    index = compacted.select("key", (F.col("rank") * sign).alias("keep_id"), "n")
    probe = scratch.write("hits", _hits(docs, log, compacted, total, parts, digest_bytes, sent))
    bad = scratch.write("mismatches", _mismatches(probe, index, total))

    alone = F.col("n").isNull()
    found = lookup(log, index, "key", "n", total).withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "n": F.coalesce("n", F.lit(1)).cast("long")})
    if bad.limit(1).count():
        found = found.join(bad, "key", "left_anti").select("doc_id", "sha", "key", "keep_id", "n").unionByName(_by_bytes(docs, bad, sign, digest_bytes))
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept, twice = found.filter(own & (F.col("n") == 1)), found.filter(own & (F.col("n") > 1))
    first = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("n")) == 1
    out = kept.withColumn("kept", F.lit(True)).unionByName(twice.withColumn("kept", first)).unionByName(found.filter(~own).withColumn("kept", F.lit(False)))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def _by_bytes(docs: DataFrame, bad: DataFrame, sign: int, digest_bytes: int) -> DataFrame:
    """Groups by bytes for rows whose key several texts share; only there do texts meet in a shuffle."""
    sha = F.sha2(F.col("low"), 256)
    low = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary").alias("low"))
    rows = low.withColumn("sha", sha).withColumn("key", F.expr(f"substring(unhex(sha), 1, {int(digest_bytes)})")).join(bad, "key", "left_semi")
    groups = rows.groupBy("key", "low").agg((F.min(F.col("doc_id") * sign) * sign).alias("keep_id"), F.count("*").alias("n"))
    return rows.join(groups, ["key", "low"]).select("doc_id", "sha", "key", "keep_id", "n")


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, all columns, that exact_dedup keeps.

    A row is told by its identifier, null too, and its text's digest: rows alike in
    both are copies of one another and one of them stays. Texts move only where
    many rows go. The columns of ``docs`` may have any names.
    """
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    found = exact_dedup(docs, keep=keep).groupBy(F.col("doc_id").alias("go_id"), F.col("text_sha256").alias("go_sha")).agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n"))
    found = Scratch(docs.sparkSession, "exact-copies").write("found", found.filter("not stays or n > 1"))
    gone, several = found.filter("not stays"), found.filter("stays")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), sha.alias("sha"))
    few = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    same = F.col("id").eqNullSafe(F.col("go_id")) & (F.col("sha") == F.col("go_sha"))
    rows = rows.join(few(gone), same, "left_anti")
    if several.limit(1).count():
        rows = rows.join(few(several), same, "left_anti").unionByName(rows.join(few(several), same, "left_semi").dropDuplicates(["id", "sha"]))
    return rows.select("row.*")
