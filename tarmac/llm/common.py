"""What the training-data operators share: scratch tables, skew-safe lookups, word hashing."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.scratch import Scratch, scratch_dir

__all__ = ["HEAVY", "SPACES", "Scratch", "WordHasher", "chunks", "lookup", "lowered", "mix64", "release", "release_heaps", "released", "rows", "scratch_dir", "table", "word_count"]

#: A key that holds more than 1/HEAVY of all rows is heavy; at most HEAVY keys can be.
HEAVY = 1024

#: White space of the word definition: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- joins


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Joins ``right``, which has each key once, to ``left`` without a hot task.

    ``weight`` is the number of rows of ``left`` that a key of ``right`` has and
    ``total`` their sum or more. Keys with over 1/HEAVY of all rows, at most
    HEAVY of them by that definition, are broadcast; what remains is shuffled.
    ``left`` is read twice, so it should be a stored table.
    """
    heavy = right.filter(F.col(weight) * F.lit(HEAVY) > F.lit(int(total)))
    light = right.filter(~(F.col(weight) * F.lit(HEAVY) > F.lit(int(total))))
    hot = left.join(F.broadcast(heavy), key, "inner")
    cold = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return hot.unionByName(cold.select(hot.columns))


# ---------------------------------------------------------------- words


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of all words of many texts at once.

    Bytes are mapped to random 64-bit values and summed with powers of an odd
    base, so a word's hash is a difference of two prefix sums; it depends on
    the word alone. ``spaces`` are the byte values that part words.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, spaces: bytes = SPACES, seed: int = 1) -> None:
        self.gap = np.zeros(256, bool)
        self.gap[list(spaces)] = True
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        """Makes room for ``n`` bytes at once."""
        if len(self.up) <= n:
            size = n + n // 4 + 1024
            inverse = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, and where each text's words begin (one more at the end)."""
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.powers(len(joined))
        gap = self.gap[joined].copy()
        gap[np.cumsum(lengths) - 1] = True
        edge = np.diff(gap.astype(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum(self.values[joined] * self.up[: len(joined)])
            before = np.where(starts > 0, sums[starts - 1], np.uint64(0)) if len(starts) else sums[:0]
            hashes = mix64((sums[ends - 1] - before) * self.down[starts] + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        return hashes, bounds


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z alone lower-cased; null counts as empty."""
    return b"" if text is None else text.encode().lower()


def release() -> None:
    """Gives a worker's freed memory back to the system: workers are reused, and their executor counts what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def released(run):
    """A task over Arrow batches that releases its memory at its end, also where it fails or is stopped."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release_heaps(spark: SparkSession) -> None:
    """Asks the executors' JVMs to collect, by which they give unused heap back to the system.

    A heap grows by what one step after the other leaves behind, up to its limit, beside the Python workers. One small
    task goes to each executor that is idle; a busy one may be left out, and nothing but its memory depends on that.
    """
    known = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()  # the driver is one of them
    n = max(1, known - 1)
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()  # a row an executor


def rows(batches, columns: list[str], size: int = 256):
    """Rows of Arrow batches as tuples; ``size`` rows of a batch are Python values at a time, not all."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def chunks(batches, columns: list[str], size: int = 1 << 20):
    """Rows of Arrow batches as lists of columns, in chunks of about ``size`` characters of the last column."""
    held: list[list] = [[] for _ in columns]
    n = 0
    for row in rows(batches, columns):
        for out, value in zip(held, row, strict=True):
            out.append(value)
        n += len(row[-1] or "")
        if n >= size or len(held[0]) >= 20_000:
            yield held
            held, n = [[] for _ in columns], 0
    if held[0]:
        yield held
