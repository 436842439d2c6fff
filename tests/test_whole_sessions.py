"""Registered queries over whole sessions and all events, longer sessions than the test tables have."""

import pytest
from pyspark.sql import functions as F

from tarmac.plans.catalogue import QUERIES
from tests.test_queries import SF


@pytest.fixture(scope="module")
def long_sessions(spark, tmp_path_factory):
    """The events dealt to five sessions of 200."""
    at = str(tmp_path_factory.mktemp("long"))
    spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("event_id") % 5 + 1).write.parquet(f"{at}/events.parquet")
    return at


@pytest.mark.parametrize("name", ["greedy_track", "beam_track", "viterbi_decode"])
def test_tracks_reach_the_end_of_their_sessions(spark, long_sessions, name):
    ends = {r.outage: (r.n, r.last) for r in QUERIES[name](spark, long_sessions).groupBy("outage").agg(F.countDistinct("k").alias("n"), F.max("k").alias("last")).collect()}
    assert ends == {s: (201, 200) for s in range(1, 6)}


def test_chords_of_long_tracks_are_their_own(spark, long_sessions):
    out = QUERIES["track_chords"](spark, long_sessions)
    assert out.count() == out.select("outage", "k").distinct().count() == 1000


@pytest.mark.parametrize(("name", "key"), [("eskf_headings", ["session", "k"]), ("snap_heading", ["id"])])
def test_every_event_has_its_row(spark, long_sessions, name, key):
    assert QUERIES[name](spark, long_sessions).select(*key).distinct().count() == 1000
