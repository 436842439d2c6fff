"""Telemetry views over the test tables, the same in Spark and in SQL.

``samples`` reads the events stream as one driving session per user: time,
speed, heading, position and three inertial channels. The SQL text defines the
same relation for an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID_STEP = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, row_idx, t, speed_ms, heading_deg, lat, lon, a1, a2, gyr, acc, event_id, event_type."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id")
    rows = events.withColumn("us", us).withColumns({"row_idx": F.row_number().over(own.orderBy("us", "event_id")), "t0": F.min("us").over(own)})
    return rows.select(
        F.col("user_id").alias("session"),
        F.col("row_idx").cast("long").alias("row_idx"),
        ((F.col("us") - F.col("t0")) / 1e6).alias("t"),
        (F.col("value") / 10.0).alias("speed_ms"),
        F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double").alias("heading_deg"),
        (51.5 + F.col("k") * 1e-4).alias("lat"),
        (-2.5 + F.pmod("event_id", F.lit(100)) * 1e-4).alias("lon"),
        ((F.col("k") - 50) / 25.0).alias("a1"),
        ((F.col("value") - 50) / 100.0).alias("a2"),
        ((F.pmod("event_id", F.lit(21)) - 10) / 100.0).alias("gyr"),
        F.pmod("event_id", F.lit(30)).cast("double").alias("acc"),
        "event_id",
        "event_type",
    )


SAMPLES_SQL = """samples AS (
    SELECT user_id AS session, row_number() OVER w AS row_idx,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))::DOUBLE / 1e6::DOUBLE AS t,
        value / 10.0::DOUBLE AS speed_ms, ((event_id * 37) % 360)::DOUBLE AS heading_deg,
        51.5::DOUBLE + json_extract(props, '$.k')::BIGINT * 1e-4::DOUBLE AS lat, -2.5::DOUBLE + (event_id % 100) * 1e-4::DOUBLE AS lon,
        (json_extract(props, '$.k')::BIGINT - 50) / 25.0::DOUBLE AS a1, (value - 50) / 100.0::DOUBLE AS a2,
        ((event_id % 21) - 10) / 100.0::DOUBLE AS gyr, (event_id % 30)::DOUBLE AS acc, event_id, event_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)
)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed truth and prediction: id, session, k, y_true, y_pred, from lineitem."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    truth = F.col("l_quantity") * 0.7
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_suppkey").alias("session"),
        truth.alias("y_true"),
        (truth + (F.col("l_discount") - 0.05) * 100).alias("y_pred"),
    )


PAIRS_SQL = """pairs AS (
    SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS session, l_quantity * 0.7::DOUBLE AS y_true,
        l_quantity * 0.7::DOUBLE + (l_discount - 0.05::DOUBLE) * 100 AS y_pred
    FROM lineitem
)"""
