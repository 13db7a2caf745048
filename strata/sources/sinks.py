"""Sinks: collections, files and the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "timestamp timestamp, level string, message string, context map<string, string>"


def write_log(entries: DataFrame, path: str) -> None:
    """Appends log entries as JSON lines below folders by date, hour and level: Error, or logs for all others."""
    kind = F.when(F.col("level") == "Error", "Error").otherwise("logs")
    out = entries.select("timestamp", "level", "message", "context", F.date_format("timestamp", "yyyyMMdd").alias("date"), F.hour("timestamp").alias("hour"), kind.alias("kind"))
    out.write.mode("append").partitionBy("date", "hour", "kind").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log entries below a path; filters on date, hour and kind prune folders."""
    return spark.read.schema(LOG_SCHEMA + ", date string, hour int, kind string").json(path)


def export(df: DataFrame, path: str, kind: str = "json", mode: str = "error") -> None:
    """A frame as JSON, CSV or Parquet files."""
    writer = df.write.mode(mode)
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[kind](path)
