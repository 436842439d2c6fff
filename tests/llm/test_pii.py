import hashlib
import re

from pyspark.sql import functions as F

from tarmac.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        worth = [int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group()))
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in found)


ODD = [
    "", None, "a@b.c.d@e.f x_y@z.w", "a@b.cx_y@z.w", "1.2.3.4.5.6.7.8 999.1.1.1", "00255.0.0.1 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (743) 555-3824 +49.30.1234567. +12", "1 2 3 " * 4000, "9" * 30_000,
    "a." * 9000 + "@", "x@" + "a." * 9000, "é日本 a@b.co ß 1.1.1.1 𝒳𝒳 +4912345678901", "5  4111111111111111",
]


def test_base_spans(spark, documents):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").unionByName(documents.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.find(df).select("doc_id", pii.rendered("base").alias("base"), "spans").collect():
        assert r.base == base(texts[r.doc_id]), texts[r.doc_id][:80]
        assert len(r.spans) >= r.base.count(":") / 2
        assert all(any((x.start, x.k, x.end) == (int(a), list(PATTERNS).index(kind), int(b)) for x in r.spans) for kind, a, b in (x.split(":") for x in r.base.split(",") if x))


def test_boosted_candidates_add_spans_like_the_valid_ones(spark):
    """Candidates that look like valid ones are added once enough labelled cases show it."""
    rows = [(k, f"Please call +1 ({200 + k % 700}) 555-{1000 + k % 9000} today, item {k} of {k * 7}") for k in range(600)]
    rows += [(1000 + k, f"call ({200 + k}) 555-{2000 + k} now") for k in range(3)]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("base").alias("b"), F.size("spans").alias("s")).collect()
    assert all(r.b == 1 for r in out if r.doc_id < 1000) and all(r.b == 0 for r in out if r.doc_id >= 1000)
    assert all(r.s >= r.b for r in out)


def test_odd_rows_and_empty(odd):
    assert pii.find(odd).count() == odd.count()
    assert pii.find(odd.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or +1 743 555 3824 end"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "mail [email] or [phone] end", 2: ""}


def test_rows_are_redacted_by_their_own_spans(spark):
    rows = [(1, "x a@b.co y"), (1, "no address here but card 4111 1111 1111 1111"), (None, "mail me z@w.org"), (None, None)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in out) == ["", "mail me [email]", "no address here but card [card]", "x [email] y"]


def test_credentials_are_added_by_their_format(spark):
    """Also where no word for them stands before; long words, counts and rules are not."""
    digest = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'the token = "{digest(k)}" of item {k}') for k in range(200)]
    rows += [(1000 + k, f"see {digest(1000 + k)} there") for k in range(3)]
    rows += [(2000 + k, "Donaudampfschifffahrtsgesellschaft " + "=" * 30 + f" {k:025d} " + "-" * 40) for k in range(200)]
    out = {r.doc_id: [s.k for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    secret = pii.KINDS.index("secret")
    assert sum(secret in out[k] for k in range(200)) >= 195 and all(secret in out[1000 + k] for k in range(3))
    assert not any(secret in out[2000 + k] for k in range(200))


def test_spans_are_added_to_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in pii.find(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    has = lambda t: bool(re.search(r'token = "[0-9a-f]{40}"', t))
    added = {i: [texts[i][x.start : x.end] for x in r.spans if x.k == pii.KINDS.index("secret")] for i, r in out.items()}
    assert all(any(len(x) == 40 for x in added[i]) for i, t in texts.items() if has(t)) and sum(map(bool, added.values())) >= 10
    assert all(has(texts[i]) for i, x in added.items() if x)


def test_frequent_loose_forms_are_added(spark):
    """Obfuscated e-mails, spaced addresses and phones without a plus, more of them than strict forms, among numbers that are neither."""
    rows = [(k, f"write to user{k} (at) host{k % 9} (dot) com, item {k}") for k in range(400)]
    rows += [(1000 + k, f"call ({200 + k}) 555-{2000 + k} now") for k in range(400)]
    rows += [(2000 + k, f"the server 10 . 0 . {k % 200} . {k % 250} is up") for k in range(400)]
    rows += [(3000 + k, f"mail a{k}@b.com") for k in range(100)]
    rows += [(4000 + k, f"we met @ home{k}, on 2024-01-{10 + k % 19} {k % 10}, of 900 . 800 . {k} . 999") for k in range(400)]
    out = {r.doc_id: {s.k for s in r.spans} for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for first, kind in ((0, "email"), (1000, "phone"), (2000, "ip")):
        found = sum(pii.KINDS.index(kind) in out[first + k] for k in range(400))
        assert found >= 380, (kind, found)
    assert sum(bool(out[4000 + k]) for k in range(400)) <= 8


def test_loose_forms_alone_are_added(spark):
    rows = [(k, f"user{k} (at) host (dot) org") for k in range(200)]
    assert all(len(r.spans) == 1 for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_rare_forms_among_very_many_candidates_are_added(spark):
    """A dozen obfuscated e-mails show their precision also among 60,000 phone numbers."""
    rows = [(k, " ".join(f"+1 ({200 + j}) 555-{1000 + 7 * k + j}," for j in range(100))) for k in range(600)]
    rows += [(1000 + k, f"write to user{k} (at) host (dot) com") for k in range(12)]
    out = {r.doc_id: r.n for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).select("doc_id", F.size("spans").alias("n")).collect()}
    assert all(out[k] == 100 for k in range(600)) and all(out[1000 + k] == 1 for k in range(12))
