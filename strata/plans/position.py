"""Dense positions 0 .. n-1 in an order, and what needs them.

``scalable`` sorts by range partitions, numbers each partition's rows on its own and adds what lies before the
partition: one row a partition is summed up and joined back. The sorted frame is persisted, so both uses see the same
partitions; if an executor is lost, its partitions are made again from the same shuffle. It is held until
``release`` is called, as frames derived from it may run at any time. ``simple`` is one global window, exact but in one
task; it suits small frames.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.errors import InvalidQueryError, InvalidStateError

ROW_BITS = 33  # of monotonically_increasing_id
HELD: list[DataFrame] = []


def release() -> int:
    """Lets go of all sorted frames that are held, and says how many; frames derived from them must not run afterwards."""
    n = len(HELD)
    while HELD:
        HELD.pop().unpersist()
    return n


def dense_index(df: DataFrame, order: list[Column], name: str, strategy: str = "scalable") -> DataFrame:
    """``df`` with the position of each row in ``order`` as a long."""
    if df.isStreaming:
        raise InvalidStateError("a stream has no positions")
    if strategy == "simple" or not order:
        return df.withColumn(name, F.row_number().over(W.orderBy(*(order or [F.lit(0)]))).cast("long") - 1)
    if strategy != "scalable":
        raise InvalidQueryError(f"unknown strategy {strategy}")
    raw, part, before = f"{name}__raw", f"{name}__part", f"{name}__before"
    held = df.orderBy(*order).withColumn(raw, F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    HELD.append(held)
    counts = held.groupBy(F.shiftright(raw, ROW_BITS).alias(part)).agg(F.count("*").alias("n"))
    # as many rows as partitions
    starts = counts.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    joined = held.withColumn(part, F.shiftright(raw, ROW_BITS)).join(starts, part)
    return joined.withColumn(name, F.col(before) + F.col(raw).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop(raw, part, before)


def chunked(df: DataFrame, position: str, size: int, items: Column) -> DataFrame:
    """(chunk, items): consecutive groups of ``size`` items in order, the last may be shorter."""
    if size < 1:
        raise InvalidQueryError("chunk size must be greater than 0")
    groups = df.groupBy(F.expr(f"`{position}` div {int(size)}").alias("chunk"))
    found = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), items.alias("x"))))
    return groups.agg(F.transform(found, lambda s: s["x"]).alias("items"))


def windowed(df: DataFrame, position: str, size: int, items: Column, bucket: int = 10_000) -> DataFrame:
    """(position, items): each run of ``size`` consecutive items, by its first.

    Buckets of positions are windowed each on their own, with the first ``size - 1`` rows of the next one copied in.
    """
    if size < 1:
        raise InvalidQueryError("window size must be greater than 0")
    width = max(bucket, size)
    own = F.expr(f"`{position}` div {width}")
    homes = F.when((F.col(position) % width < size - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = df.select(F.col(position).alias("position"), items.alias("x"), F.explode(homes).alias("home"))
    frame = W.partitionBy("home").orderBy("position").rowsBetween(0, size - 1)
    found = spread.select("position", "home", F.collect_list("x").over(frame).alias("items"))
    return found.filter((F.size("items") == size) & (F.expr(f"position div {width}") == F.col("home"))).select("position", "items")
