import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tarmac.llm import bpe
from tarmac.llm.queries import public_vocabulary

ODD = ["", None, " ", "a\x1cb \x85 c\xa0d", "it's  I'LL we'll\n\n x", "٣٤ Ⅷ² x²y ñ́ 日本語テスト  。", "​᠎ a b", "a" * 5000, "\x00\x01\xff", "👩‍👩‍👧 ok", " \t\n ", "don't_do__it 123abc", "\x1f\x1e x", "ﬁ ß ẞ ϐ"]


def test_matches_the_library(spark, documents):
    ranks, pattern = public_vocabulary()
    library = bpe._encoding(ranks, pattern)
    df = spark.createDataFrame([(k if k % 5 else None, t) for k, t in enumerate(ODD)], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    texts = [r.text or "" for r in df.collect()]
    want = sorted((np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for t in texts)
    for size in (10, bpe.BLOCK_CHARS):
        out = bpe.encode(df.repartition(3), ranks, pattern, decode_too=True, block_chars=size).collect()
        assert sorted((bytes(r.ids), bytes(r.decoded)) for r in out) == want
        assert all(r.n_tokens * 4 == len(r.ids) for r in out)


def test_decode_round_trip(documents):
    ranks, pattern = public_vocabulary()
    out = bpe.decode(bpe.encode(documents, ranks, pattern), ranks)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in out.collect())


def test_odd_rows_and_empty(odd):
    ranks, pattern = public_vocabulary()
    got = bpe.encode(odd, ranks, pattern, decode_too=True).collect()
    assert sorted(hashlib.md5(bytes(r.decoded)).hexdigest() for r in got) == sorted(hashlib.md5((r.text or "").encode()).hexdigest() for r in odd.collect())
    assert bpe.encode(odd.limit(0), ranks, pattern).count() == 0


class _Tasks:
    """In place of a DataFrame: gives the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        return run


def test_batch_is_not_held_as_python_values(monkeypatch):
    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = [f"{k} " + "word " * 800 for k in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    size = sum(map(len, texts))
    del texts
    run = bpe._blocks(_Tasks(), public_vocabulary()[1], 8, 200_000)
    tracemalloc.start()
    try:
        blocks = sum(sum(b.column("kind").to_pylist()) == 0 for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert blocks > 20 and peak < size / 2
