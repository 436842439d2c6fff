"""Streams give what the same code gives on the whole table."""

import pytest
from pyspark.sql import functions as F

from tarmac.operators import replay
from tarmac.streaming import telemetry as tl

SCHEMA = "session long, k long, mu double, sigma double, a_fwd double, ts timestamp"


@pytest.fixture
def source(spark, tmp_path):
    rows = spark.range(120).select((F.col("id") % 3).alias("session"), F.floor(F.col("id") / 3).alias("k"), (10 + F.sin("id")).alias("mu"), F.lit(2.0).alias("sigma"), F.when(F.col("id") % 4 > 0, 0.1).alias("a_fwd"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    rows = rows.cache()
    for part in range(4):
        rows.filter((F.col("k") >= part * 10) & (F.col("k") < part * 10 + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path)


def drained(spark, frame, path, name, mode="append"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_filter_keeps_its_state(spark, source):
    rows, path = source
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    got = {(r.session, r.k): r.fused for r in drained(spark, tl.speed_fusion(stream, "session", "k"), path, "fused").collect()}
    want = {(r.session, r.k): r.fused for r in replay.speed_fusion(rows, ["session"]).collect()}
    assert got == pytest.approx(want)


def test_windows(spark, source):
    rows, path = source
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    n = {"n": F.count("*")}
    got = {(r.session, r.start): r.n for r in drained(spark, tl.tumbling(stream, "ts", "session", n, "10 seconds", "0 seconds"), path, "tumbling").collect()}
    want = {(r.session, r.start): r.n for r in tl.tumbling(rows, "ts", "session", n, "10 seconds").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 6
    parts = tl.segments(rows, "ts", "session", "5 seconds").collect()
    assert len(parts) == 3 and all(r.n == 40 for r in parts)
    assert tl.sliding(rows, "ts", "session", n).count() > tl.tumbling(rows, "ts", "session", n, "10 seconds").count()
