import re

import pytest


def low(text):
    """A-Z lower-cased, nothing else."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "s1"),
        (2, "ALPHA beta gamma delta epsilon zeta eta theta", "en", "s1"),
        (2, "ALPHA beta gamma delta epsilon zeta eta theta", "en", "s1"),
        (3, None, "en", "s2"),
        (4, "", None, None),
        (5, " \t\n", "en", "s2"),
        (None, "Alpha beta gamma delta epsilon zeta eta theta", None, "s1"),
        (None, None, None, None),
        (6, "word " * 30_000, "en", "s2"),
        (7, "one two", "en", "s3"),
        (8, "9" * 20_000, "en", "s3"),
        (9, "größe ñandú 日本語 😀 Éa", "de", "s3"),
        (10, "alpha beta gamma delta epsilon zeta eta theta iota", "en", None),
        (11, "#### !!! ;;;", "en", "s1"),
    ]
    full = [(*r, len(r[1] or ""), "k", 1, 2, "x", True, 0.5) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, n long, size long, sha string, kept boolean, score double")
