import base64
import hashlib
import re
from itertools import combinations

import numpy as np

from tarmac.llm import spotsigs as s


def test_edited_texts(spark, odd, documents):
    for df in (odd, documents):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        tie = {(r.doc_id, r.text or ""): r.x for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS x").collect()}
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie[r]))
        want = []
        for k, (i, t) in enumerate(rows):
            cut = len(t) // 4
            want.append(str((i, len(t), hashlib.sha256((t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest())))
        out = s.edited_fingerprints(df).collect()
        assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in out) == sorted(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_signatures_follow_the_definition():
    spotter = s.Spotter()
    text = "The quick fox is on a red mat and the end."
    got = spotter.sets([text, "", "Hello", text.upper()])
    words = [w.lower() for w in text.replace(".", "").split()]
    content = [w for w in words if w not in s.ANCHORS]
    chains = set()
    for k, w in enumerate(words):
        rest = [x for x in words[k + 1 :] if x not in s.ANCHORS][:2]
        if w in s.ANCHORS and len(rest) == 2:
            chains.add((w, *rest))
    assert len(got[0]) == len(chains) and len(content) > 3
    assert not len(got[1]) and len(got[2]) == 1 and np.array_equal(got[0], got[3])


def test_near_pairs_match_brute_force(documents):
    prints = s.fingerprints(documents)
    sets = {r.doc_id: frozenset(r.signatures) for r in prints.collect()}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    want = {(min(a, b), max(a, b)) for (x, a), (y, b) in combinations(reps.items(), 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)}
    assert {(r.a, r.b) for r in s.near_pairs(prints).collect()} == want
    assert {r.doc_id: r.class_id for r in s.members(prints).collect()} == {i: reps[x] if x else i for i, x in sets.items()}


def plain(text):
    """The 32-bit signatures by the definition, one spot after the other."""
    mix = lambda x: int(s.mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])
    hasher = s.WordHasher(s.GAPS, seed=3)
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().lower())
    hashed = [int(hasher.words([w])[0][0]) for w in words]
    anchors = {a.encode() for a in s.ANCHORS}
    out = set()
    for k, w in enumerate(words):
        chain = [hashed[j] for j in range(k + 1, len(words)) if words[j] not in anchors][:2] if w in anchors else []
        if len(chain) == 2:
            x = hashed[k] * 0x9E3779B97F4A7C15
            for c in chain:
                x = mix(x + c * 0xC2B2AE3D27D4EB4F)
            out.add(x >> 32)
    if not out and words:
        out = {int.from_bytes(hashlib.blake2b(np.array(hashed, np.uint64).tobytes(), digest_size=4).digest(), "little")}
    return out


def test_fingerprints_and_likenesses_match_brute_force(spark, odd, documents):
    shown = lambda x: base64.b64encode(np.array(sorted(x), "<u4").tobytes()).decode()
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    short = documents.filter("length(text) < 3000 and doc_id % 3 = 0")
    for df in (odd.filter("doc_id is null or doc_id <> 6"), short):
        tie = {(r.doc_id, r.text or ""): r.x for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS x").collect()}
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, tie[r]))
        sets, want = [plain(t) for _, t in rows], []
        for k, (i, t) in enumerate(rows):
            after = (k + 1) % len(rows)
            edited = plain(t[: len(t) - len(t) // 4] + rows[after][1][: len(t) // 4])
            want.append(str((i, shown(sets[k]), shown(edited), alike(sets[k], edited), alike(sets[k], sets[after]))))
        got = [str((r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)) for r in s.edited_fingerprints(df).collect()]
        assert sorted(got) == sorted(want)


def test_rows_without_and_with_one_identifier_are_split(spark):
    rows = [(None, f"text {k} of the null rows") for k in range(300)] + [(7, f"text {k} of the seventh") for k in range(300)] + [(k, f"text {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "xxhash64(text) AS tie")
    ranged = s._ranges(df, rows_each=50).collect()
    order = sorted(ranged, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.range for r in order] == sorted(r.range for r in ranged)
    sizes = {}
    for r in ranged:
        sizes[r.range] = sizes.get(r.range, 0) + 1
    assert max(sizes.values()) < 160 and len(sizes) >= 10


def test_empty_and_single(spark, odd):
    assert s.edited_fingerprints(odd.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "the end of the long road"), (None, None)], "doc_id long, text string")
    assert s.edited_fingerprints(nameless).count() == 2
    assert s.near_pairs(s.fingerprints(odd)).count() >= 0 and s.members(s.fingerprints(odd)).count() == odd.count()
    one = spark.createDataFrame([(5, "the end of the long road is near the old mill")], "doc_id long, text string")
    assert s.edited_fingerprints(one).first().near_next == 1.0
    assert s.near_pairs(s.fingerprints(odd.limit(0))).count() == 0
