from collections import defaultdict

from tarmac.llm.mixing import mix, take
from tests.llm.conftest import WORD


def filled(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    """Water-filling by repeated clamping."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    clamped = {}
    while True:
        left = budget * sum(sizes.values()) - sum(clamped.values())
        open_ = [s for s in names if s not in clamped]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > epochs * sizes[s]]
        if not over:
            return clamped | {s: left * weight[s] / total for s in open_}
        clamped |= {s: float(epochs * sizes[s]) for s in over}


def check(df):
    rows = df.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = filled(dict(sizes))
    out = mix(df).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5001
    assert sorted(map(str, out)) == sorted(map(str, mix(df).collect()))


def test_documents(documents):
    check(documents)


def test_odd_rows(odd):
    check(odd)


def test_empty(odd):
    assert mix(odd.limit(0)).count() == 0


def test_take_repeats_rows(documents, odd):
    for df in (documents, odd):
        out = take(df)
        assert out.columns == df.columns
        sizes, got = defaultdict(int), defaultdict(int)
        largest = defaultdict(int)
        for r in df.collect():
            n = len(WORD.findall(r.text or ""))
            sizes[r.source] += n
            largest[r.source] = max(largest[r.source], n)
        for r in out.collect():
            got[r.source] += len(WORD.findall(r.text or ""))
        for s, want in filled(dict(sizes)).items():
            assert abs(got[s] - want) <= largest[s] / 2 + 1
