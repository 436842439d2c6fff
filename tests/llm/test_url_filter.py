from datetime import date

from pyspark.sql import functions as F

from tarmac.llm import url_filter as uf

ENTRY = "entry_id long, listed_on date, action string, kind string, pattern string, category string"
ENTRIES = [
    (1, date(2024, 1, 1), "add", "host", "bad.com", "spam"), (2, date(2024, 3, 1), "remove", "host", "bad.com", "spam"), (3, date(2024, 5, 1), "add", "host", "bad.com", "malware"), (4, date(2024, 1, 1), "add", "prefix", "site.org/a/b", "watch"),
    (5, date(2024, 1, 1), "add", "host", "ok.bad.com", "allow"), (6, date(2024, 2, 1), "add", "host", "same.com", "x"), (7, date(2024, 2, 1), "remove", "host", "same.com", "x"), (8, None, "add", "host", "never.com", "x"),
]
CAPTURES = [
    (1, "http://bad.com/x", date(2024, 2, 1)), (2, "http://www.BAD.com:80/x", date(2024, 2, 29)), (3, "http://bad.com", date(2024, 3, 1)), (4, "http://bad.com", date(2024, 6, 1)), (5, "http://notbad.com", date(2024, 2, 1)), (6, "http://ok.bad.com/", date(2024, 2, 1)),
    (7, "https://u:p@site.org/a/b/c?q#f", date(2024, 2, 1)), (8, "https://site.org/a/bc", date(2024, 2, 1)), (9, None, date(2024, 2, 1)), (10, "http://bad.com", None), (11, "::::", date(2024, 2, 1)), (12, "http://same.com", date(2024, 2, 1)), (13, "http://never.com", date(2024, 2, 1)),
    (1, "http://bad.com/x", date(2024, 2, 1)), (None, None, None), (14, "http://" + "a." * 3000 + "bad.com/" + "p/" * 3000, date(2024, 2, 1)),
]


def test_entries_active_at_the_fetch_decide(spark, monkeypatch):
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_on date").withColumns({c: F.lit("x") for c in ("host", "pattern", "kind", "valid_to")})
    entries = spark.createDataFrame(ENTRIES, ENTRY)
    want = {1: (1, True), 2: (1, True), 3: (None, False), 4: (3, True), 5: (None, False), 6: (5, False), 7: (4, True), 8: (None, False), 9: (None, False), 10: (None, False), 11: (None, False), 12: (None, False), 13: (None, False), None: (None, False), 14: (1, True)}
    for limit in (uf.BROADCAST_ROWS, 0):
        monkeypatch.setattr(uf, "BROADCAST_ROWS", limit)
        out = uf.evaluate(captures, entries).collect()
        assert {r.page_id: (r.entry_id, r.blocked) for r in out} == want
        assert {r.page_id: r.copies for r in out}[1] == 2 and len(out) == len(want)


def test_empty(spark):
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_on date")
    entries = spark.createDataFrame(ENTRIES, ENTRY)
    assert uf.evaluate(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in uf.evaluate(captures, entries.limit(0)).collect())
