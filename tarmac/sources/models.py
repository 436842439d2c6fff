"""Small fitted models (knots, norms, settings) as JSON in any folder Spark can write."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def save(spark: SparkSession, model: dict, path: str) -> None:
    """Writes a model of a few kilobytes; replaces one that is there."""
    text = json.dumps(model, sort_keys=True, separators=(",", ":"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> dict:
    """A model as it was saved; a folder without one is an error."""
    row = spark.read.text(path).first()
    if row is None:
        raise ValueError(f"no model in {path}")
    return json.loads(row["value"])
