"""Streams: filters and projections as they are, and counts by event-time window with a watermark.

Operators that need an order or positions raise on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.operators.query import Query


def stream_parquet(spark: SparkSession, path: str, schema, max_files: int | None = None) -> Query:
    """New Parquet files of a folder, as they come."""
    reader = spark.readStream.schema(schema)
    return Query.from_df((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path))


def windowed_counts(query: Query, ts: str, width: str, *keys: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and keys; state older than the watermark is let go."""
    rows = query.to_df().withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))


def stream_join(left: Query, right: Query, key: str, left_ts: str, right_ts: str, within: str, late: str = "10 minutes") -> DataFrame:
    """(left, right) of two streams with equal keys, the right one at most ``within`` after the left.

    Both sides have a watermark and the times are bound to one another, so each row is held for a bounded time only.
    """
    a = left.to_df().withColumn("__a", F.col(left_ts).cast("timestamp")).withWatermark("__a", late)
    b = right.to_df().withColumn("__b", F.col(right_ts).cast("timestamp")).withWatermark("__b", late)
    a = a.select("__a", F.col(key).alias("__ka"), left.item.alias("left"))
    b = b.select("__b", F.col(key).alias("__kb"), right.item.alias("right"))
    return a.join(b, F.expr(f"__ka = __kb and __b >= __a and __b <= __a + interval {within}")).select("left", "right")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then an end: appends with exactly-once files."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(df: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A function of each batch of rows; in mode ``complete`` a batch has all results so far."""
    return df.writeStream.foreachBatch(call).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
