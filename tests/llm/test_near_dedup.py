import random
from itertools import combinations

import numpy as np

from tarmac.llm.components import components
from tarmac.llm.common import Scratch
from tarmac.llm.near_dedup import drop_near_copies, near_dedup, shared_counts
from tests.llm.conftest import WORD, low


def shingles(text):
    w = WORD.findall(low(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute([r for r in rows if r[0] is not None])
    out = near_dedup(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in out) == sorted(len(shingles(t)) for _, t in rows)


def test_documents(documents):
    check(documents)


def test_odd_rows(odd):
    check(odd)


def test_near_cluster_and_common_passage(spark):
    """Copies with edits of every strength, some linked only through others, and a passage many texts share."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for k in range(90):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = word()
        rows.append((k, " ".join(text)))
    rows += [(100 + k, " ".join(passage + [word() for _ in range(rng.randrange(10, 60))])) for k in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty(spark, odd):
    assert near_dedup(odd.limit(0)).count() == 0
    assert drop_near_copies(odd.limit(0)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, 5000)) for _ in range(6)]
    for first in (0, 2):
        got = shared_counts(sets, first)
        for i, a in enumerate(sets[: first or 6]):
            for j, b in enumerate(sets[first:], first):
                assert i == j or got[i, j - first] == len(np.intersect1d(a, b))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
