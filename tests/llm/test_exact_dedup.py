import hashlib
from collections import defaultdict

from tarmac.llm.exact_dedup import drop_exact_copies, exact_dedup
from tests.llm.conftest import low


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[low(t)].append(i)
    return by


def check(df, out, pick):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    by = groups(rows)
    got = sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in out)
    want = sorted(str((i, pick([x for x in by[low(t)] if x is not None]), len(by[low(t)]), hashlib.sha256(low(t).encode()).hexdigest())) for i, t in rows)
    assert got == want
    kept = defaultdict(int)
    for r in out:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def best(f):
    return lambda ids: f(ids) if ids else None


def test_documents(documents):
    check(documents, exact_dedup(documents, keep="largest").collect(), best(max))


def test_odd_rows(odd):
    check(odd, exact_dedup(odd).collect(), best(min))
    check(odd, exact_dedup(odd, keep="largest", memtable_rows=2).collect(), best(max))


def test_colliding_digests_are_parted_by_bytes(odd, documents):
    check(odd, exact_dedup(odd, digest_bytes=1).collect(), best(min))
    check(documents, exact_dedup(documents, digest_bytes=1, memtable_rows=16, sent=0).collect(), best(min))


def test_empty(odd):
    assert exact_dedup(odd.limit(0)).count() == 0


def test_stage_keeps_columns_and_one_row_a_text(odd):
    out = drop_exact_copies(odd)
    assert out.columns == odd.columns
    texts = [low(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({low(r.text) for r in odd.collect()})


def test_filters_hold_their_keys():
    import numpy as np

    from tarmac.llm import exact_dedup as ed

    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(4000)]
    filters = {}
    for part in range(4):
        own = [k for k in keys[:2000] if ed.part_of(k, 4) == part]
        filters[part] = [np.unpackbits(np.frombuffer(ed.filter_of(own), np.uint8)).astype(bool)]
    held = ed.maybe_held(keys, filters, 4)
    assert held[:2000].all() and held[2000:].mean() < 0.03
    assert not ed.maybe_held([], filters, 4).size


def test_stage_with_its_own_names_as_columns(odd):
    from pyspark.sql import functions as F

    named = odd.withColumns({c: F.lit("mine") for c in ("sha", "row", "id", "go_id", "go_sha", "kept", "__text_sha")})
    out = drop_exact_copies(named)
    assert out.columns == named.columns and {r.sha for r in out.collect()} == {"mine"} and out.count() == drop_exact_copies(odd).count()
