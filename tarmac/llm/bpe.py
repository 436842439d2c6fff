"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task cuts whole texts to pre-tokens and numbers its distinct words. Its
   block is two kinds of rows: the documents as word numbers by position, and
   the words themselves, dealt to buckets by hash.
2. Words meet in their bucket, where each distinct word is encoded once; the
   ids go back to the blocks that asked.
3. Per block, word numbers are replaced by ids in order of position. Decoding
   joins each id with the token-byte table.

Numbers are given by falling frequency and packed by bytes, so that the shuffled
documents are about a third of their text. A block is bounded in characters;
a text longer than that is a block of its own.
"""

from __future__ import annotations

import base64
import functools
from array import array
import re
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import released, rows

#: Characters of a block of documents, and of the texts whose distinct words a bucket holds a share of.
BLOCK_CHARS, BUCKET_CHARS = 16_000_000, 16_000_000

#: White space as Unicode has it; the interpreter's own \\s holds more.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(maxsize=2)
def _token_bytes(ranks: bytes) -> list[bytes]:
    pairs = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return [pairs.get(k, b"") for k in range(max(pairs, default=-1) + 1)]


@functools.lru_cache(maxsize=2)
def _splitters(pattern: str):
    """Pre-token matchers for ASCII and for other texts; the same language, white space made explicit."""
    import regex

    explicit = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
    ascii_only = explicit.replace("[^" + WHITE + "\\p{L}\\p{N}]", f"[^{WHITE}A-Za-z0-9]").replace("\\p{L}", "[A-Za-z]").replace("\\p{N}", "[0-9]")
    return re.compile(ascii_only).findall, regex.compile(explicit).findall


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as three compressed byte planes."""
    planes = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    parts = [squeeze(planes[:, k].tobytes()) for k in range(4)]
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def _unpack(data: bytes) -> np.ndarray:
    sizes = np.frombuffer(data[:16], "<u4")
    at, out, grow = 16, None, zstandard.ZstdDecompressor().decompress
    for k, n in enumerate(sizes.tolist()):
        plane = np.frombuffer(grow(data[at : at + n]), np.uint8).astype(np.uint32) << np.uint32(8 * k)
        out = plane if out is None else out | plane
        at += n
    return out


ROW = "dest long, block long, kind int, bucket int, words binary, ids binary, counts binary, buckets binary"
FIELDS = ["dest", "block", "kind", "bucket", "words", "ids", "counts", "buckets"]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], FIELDS)


def _blocks(docs: DataFrame, pattern: str, buckets: int, block_chars: int) -> DataFrame:
    """Rows of kind 0 (a block's documents) and 1 (a bucket of a block's words)."""

    def run(batches):
        plain, full = _splitters(pattern)
        base, number = TaskContext.get().partitionId() << 24, 0

        def done(ids, valid, counts, numbers, words):
            nonlocal number
            block = base + number
            number += 1
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            numbers.clear()
            times = np.zeros(len(words), np.int64)
            for at in range(0, len(flat), 1 << 19):  # bincount copies what it counts
                times += np.bincount(flat[at : at + (1 << 19)], minlength=len(words))
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            ranked = [words[k].encode() for k in order.tolist()]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in ranked), np.uint32, len(ranked))
            head = np.array(ids, np.int64).tobytes() + np.array(valid, np.uint8).tobytes()
            flat = _pack(rank[flat])
            yield _batch([(-1 - block, block, 0, 0, flat, zlib.compress(head, 1), _pack(np.array(counts, np.uint32)), _pack(bucket))])
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            squeeze = zstandard.ZstdCompressor(level=3).compress
            found = []
            for k in range(buckets):
                if cuts[k] < cuts[k + 1]:
                    part = [ranked[j] for j in by[cuts[k] : cuts[k + 1]].tolist()]
                    # A word cannot hold a byte 0xFF: it isn't UTF-8.
                    found.append((k, block, 1, k, squeeze(b"\xff".join(part)), None, None, None))
            for at in range(0, len(found), 64):
                yield _batch(found[at : at + 64])

        ids, valid, counts, numbers, size = [], [], [], [], 0
        known = defaultdict(count().__next__)
        for i, t in rows(batches, ["doc_id", "text"]):
            t = t or ""
            if ids and size + len(t) > block_chars:
                yield from done(ids, valid, counts, numbers, list(known))
                ids, valid, counts, numbers, size = [], [], [], [], 0
                known = defaultdict(count().__next__)
            found = (plain if t.isascii() else full)(t)
            numbers.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            ids.append(i or 0)
            valid.append(i is not None)
            counts.append(len(found))
            size += len(t)
        if ids:
            yield from done(ids, valid, counts, numbers, list(known))

    return docs.mapInArrow(released(run), ROW)


def _encode_words(asked: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Kind 1 rows become kind 2, the words' ids; each distinct word of a bucket is encoded once. Others pass."""

    def run(batches):
        encode = _encoding(ranks, pattern)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}  # a word's ids, four bytes each
        grow = zstandard.ZstdDecompressor().decompress
        for row in rows(batches, FIELDS, 16):
            dest, block, kind, bucket, words, *_ = row
            if kind == 0:
                yield _batch([row])
                continue
            found = []
            for w in grow(words).split(b"\xff"):
                if (ids := known.get(w)) is None:
                    ids = known[w] = array("I", encode(w)).tobytes()
                found.append(ids)
            sizes = np.fromiter(map(len, found), np.uint32, len(found)) // np.uint32(4)
            yield _batch([(dest, block, 2, bucket, None, _pack(np.frombuffer(b"".join(found), np.uint32)), _pack(sizes), None)])

    return asked.mapInArrow(released(run), ROW)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode_too: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, decoded bytes.

    ``ranks`` is the content of a vocabulary file, a base64 token and its rank a
    line; ``pattern`` cuts texts to pre-tokens. One row per row of ``docs``, null
    text as empty, repeated and null identifiers as they are; other columns are
    not read. No special tokens.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-chars // BUCKET_CHARS))  # so a bucket's words, which its task holds, don't grow with the corpus
    asked = _blocks(docs, pattern, buckets, block_chars)
    answered = _encode_words(asked.repartition(buckets, "dest"), ranks, pattern)

    def run(batches):
        tokens = _token_bytes(ranks) if decode_too else []
        held: dict = {}

        def done():
            head = zlib.decompress(held["head"])
            n = len(head) // 9
            doc_ids, valid = np.frombuffer(head[: 8 * n], np.int64), np.frombuffer(head[8 * n :], np.uint8)
            counts, numbers, bucket = _unpack(held["counts"]), _unpack(held["numbers"]), _unpack(held["buckets"])
            sizes, starts, flat, at = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64), [], 0
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for k, ids, own in held["answers"]:
                where = by[cuts[k] : cuts[k + 1]]
                own = _unpack(own).astype(np.int64)
                sizes[where] = own
                starts[where] = at + np.cumsum(own) - own
                flat.append(_unpack(ids))
                at += len(flat[-1])
            table = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            held.clear()
            cut = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            out: list[tuple] = []
            size = 0
            for k in range(n):
                w = numbers[cut[k] : cut[k + 1]]
                own = sizes[w]
                ids = table[np.repeat(starts[w] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
                row = (int(doc_ids[k]) if valid[k] else None, len(ids), ids.astype("<u4").tobytes())
                out.append((*row, b"".join([tokens[x] for x in ids.tolist()])) if decode_too else row)
                size += len(row[2])
                if size > 4_000_000:
                    yield out
                    out, size = [], 0
            if out:
                yield out

        def shaped(own):
            kinds, names = [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["doc_id", "n_tokens", "ids", "decoded"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), kinds, strict=False)], names[: len(own[0])])

        for kind, bucket, words, ids, counts, asked_of in rows(batches, FIELDS[2:], 16):
            if kind == 0:
                if held:
                    yield from map(shaped, done())
                held |= {"head": ids, "numbers": words, "counts": counts, "buckets": asked_of, "answers": []}
            else:
                held["answers"].append((bucket, ids, counts))
        if held:
            yield from map(shaped, done())

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode_too
    return answered.repartition(max(8, 2 * (-(-chars // BLOCK_CHARS))), "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(released(run), schema)


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the ids, each joined with the token-byte table (bounded by the vocabulary)."""
    names = encoded.columns

    def run(batches):
        tokens = _token_bytes(ranks)
        for b in batches:
            texts = [b"".join([tokens[x] for x in np.frombuffer(i or b"", "<u4").tolist()]) for i in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(released(run), ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes) + ", decoded binary")


def vocabulary(path: str) -> bytes:
    """A vocabulary file's content, read at the driver (bounded by the vocabulary, about 1 MB) and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()
