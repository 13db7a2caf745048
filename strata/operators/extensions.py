"""Operators beyond the sequence API: joins, set operations and statistics over queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import InvalidQueryError
from strata.operators.query import Expression, Query, column_of

HINTS = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


def join(left: Query, right: Query, left_key: Expression, right_key: Expression, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """(left, right) structs by equal keys. Spark chooses how unless a strategy is given; broadcast only what is known to be small."""
    if strategy not in (None, *HINTS):
        raise InvalidQueryError(f"unknown strategy {strategy}")
    a = left.to_df().select(column_of(left_key).alias("k"), left.item.alias("left"))
    b = right.to_df().select(column_of(right_key).alias("k2"), right.item.alias("right"))
    b = b.hint(HINTS[strategy]) if strategy else b
    return a.join(b, F.col("k") == F.col("k2"), how).select("left", "right")


def cross_join(left: Query, right: Query) -> DataFrame:
    return left.to_df().select(left.item.alias("left")).crossJoin(right.to_df().select(right.item.alias("right")))


def group_join(left: Query, right: Query, left_key: Expression, right_key: Expression, *aggregates: Column) -> DataFrame:
    """Each left element with aggregates of the right ones of its key, which are aggregated before the join."""
    b = right.to_df().groupBy(column_of(right_key).alias("__k2")).agg(*aggregates)
    a = left.to_df().withColumn("__k", column_of(left_key))
    return a.join(b, F.col("__k") == F.col("__k2"), "left").drop("__k", "__k2")


def union(left: Query, right: Query) -> DataFrame:
    return left.to_df().union(right.to_df()).distinct()


def concat(left: Query, right: Query) -> DataFrame:
    return left.to_df().union(right.to_df())


def intersect(left: Query, right: Query) -> DataFrame:
    return left.to_df().intersect(right.to_df())


def except_(left: Query, right: Query) -> DataFrame:
    return left.to_df().subtract(right.to_df())


def performance_summary(df: DataFrame, value: Expression, bucket: Expression, accuracy: int | None = 10_000) -> DataFrame:
    """Count, least, greatest, mean, median, p95 and p99 of a value by bucket, in one pass.

    Percentiles are sketches of this accuracy; without one they are exact and interpolated, and what is held grows with
    the different values of a bucket.
    """
    v = column_of(value)
    p = F.percentile(v, [0.5, 0.95, 0.99]) if accuracy is None else F.percentile_approx(v, [0.5, 0.95, 0.99], accuracy)
    out = df.groupBy(column_of(bucket).alias("bucket")).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), p.alias("p"))
    return out.select("bucket", "n", "min", "max", "avg", F.col("p")[0].alias("median"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def request_summary(df: DataFrame, duration: Expression, failed: Expression) -> DataFrame:
    """One row: the number of requests, their mean time, and the share of failed ones in per cent; null without requests."""
    bad = F.avg(F.coalesce(column_of(failed), F.lit(False)).cast("int")) * 100
    return df.agg(F.count(F.lit(1)).alias("total_requests"), F.avg(column_of(duration)).alias("avg_response_time"), bad.alias("error_rate_percent"))


def slowest_endpoints(df: DataFrame, endpoint: Expression, duration: Expression, n: int = 5) -> DataFrame:
    """(endpoint, avg_time, call_count) of the n endpoints that take longest on average, ties by name."""
    by = df.groupBy(column_of(endpoint).alias("endpoint")).agg(F.avg(column_of(duration)).alias("avg_time"), F.count(F.lit(1)).alias("call_count"))
    return by.orderBy(F.desc("avg_time"), "endpoint").limit(n)
