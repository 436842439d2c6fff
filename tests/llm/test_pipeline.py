"""The pipeline against a plain version of its stages."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
from tarmac.llm import bpe, language_id
from tarmac.llm.queries import public_vocabulary
from tests.llm.conftest import low
from tests.llm.test_near_dedup import brute


def test_stages_take_effect(spark, sf, documents):
    docs, kept = documents, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        rows, before = out.collect(), docs.collect()
        if name != "byte_bpe":
            assert sorted(out.columns) == sorted(documents.columns)
            kept[name] = rows
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in rows} == {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}
        elif name == "exact_dedup":
            first = {}
            for r in before:
                first[low(r.text)] = min(r.doc_id, first.get(low(r.text), r.doc_id))
            assert sorted(r.doc_id for r in rows) == sorted(first.values())
        elif name == "near_dedup":
            comp = brute([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(i for i, c in comp.items() if i == c)
        elif name == "source_mixing":
            assert set(Counter(r.doc_id for r in rows).values()) <= {1, 2}
        else:
            library = bpe._encoding(*public_vocabulary())
            texts = {r.doc_id: r.text for r in before}
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in before)
            for r in rows:
                assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        docs = spark.createDataFrame(rows, out.schema)


def test_stages_survive_odd_and_empty_rows(spark, odd, sf):
    for start in (odd, odd.limit(0)):
        docs = start
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            docs = spark.createDataFrame(rows, out.schema)
    assert cp.STAGES[0][1](spark, odd, sf).columns == odd.columns and language_id.held_out() is not None


def _full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_stages_begin_with_released_heaps(spark, documents, sf):
    for _, stage in cp.STAGES:
        before = _full_collections(spark)
        stage(spark, documents.limit(20), sf)
        assert _full_collections(spark) > before
