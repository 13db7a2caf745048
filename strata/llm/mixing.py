"""Mixing sources to target weights by Poisson replication.

A source with share s of the documents and target weight w gets the mean repetition rate ``size * w / s``, so the
mixture has ``size`` times as many documents as the input, in expectation dealt to the sources by weight. Each
document's count is found by inverting the Poisson distribution with that mean at a uniform number hashed from the
seed and the document's id: the number of k with CDF(k) <= u. The document is exploded by its count, and the copies
are shuffled globally by a hash of seed, id and copy number. Means over ``LARGEST_MEAN`` are split into several equal ones
with a uniform number each, whose counts add up to the same distribution, so the CDF never underflows.

A null source is a source of its own. Weights for sources that don't occur are left out before the rest are scaled
to one; a source without a weight has the weight ``otherwise``, by default
none of the mixture. Without ``weights`` the target is the share to the power
``temperature``, scaled to one. Rows with equal ids have equal counts, as repeated rows must; a null id hashes as an
empty one. An empty table gives an empty result; other columns pass through, null or long texts too. A column that
already has the name given as ``copy`` or ``shuffle_key`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import column, free_name, written

SEED, LARGEST_MEAN, MAX_BROADCAST_SOURCES = "mix-1", 16.0, 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(mean: Column, seed: str, doc_id: Column) -> Column:
    """The Poisson quantile of the document's hashed uniform number."""
    draws = F.ceil(mean / F.lit(LARGEST_MEAN)).cast("int")
    each = F.when(draws > 0, mean / draws).otherwise(F.lit(0.0))
    terms = F.ceil(each + 12 * F.sqrt(each) + 40).cast("int")  # what lies beyond is below 2 ** -52

    def count(draw: Column) -> Column:
        u = uniform(F.lit(seed), doc_id, draw.cast("string"))
        state = F.struct(F.exp(-each).alias("term"), F.exp(-each).alias("cdf"), F.lit(0).alias("k"))
        step = F.aggregate(
            F.sequence(F.lit(1), terms),
            state,
            lambda s, k: F.when(s["cdf"] > u, s).otherwise(F.struct((s["term"] * each / k).alias("term"), (s["cdf"] + s["term"] * each / k).alias("cdf"), (s["k"] + 1).alias("k"))),
        )
        return step["k"]

    counts = F.transform(F.sequence(F.lit(1), draws), count)
    return F.when(draws > 0, F.aggregate(counts, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, size: float = 1.0, source: str = "source", otherwise: float = 0.0) -> DataFrame:
    """(source, rate) for each source of ``docs``: its mean number of repetitions."""
    spark = docs.sparkSession
    counts = docs.groupBy(column(docs, source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighed = counts.join(given, counts.source.eqNullSafe(given.name), "left").select("source", "n", F.coalesce("weight", F.lit(float(otherwise))).alias("weight"))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    share = F.try_divide(F.col("weight"), F.col("all_weight"))
    return weighed.crossJoin(F.broadcast(total)).select("source", F.coalesce(F.lit(float(size)) * share * F.col("all_n") / F.col("n"), F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
    seed: str = SEED,
    doc_id: str = "doc_id",
    source: str = "source",
    copy: str = "copy",
    shuffle_key: str = "shuffle_key",
    partitions: int | None = None,
    otherwise: float = 0.0,
) -> DataFrame:
    """Copies of documents, shuffled globally, with the copy's number from 1 and the key of the shuffle.

    Rates are worked out once and written, and joined by broadcast while they are few; else by a shuffle of which Spark
    splits the hot keys.
    """
    spark = docs.sparkSession
    rate, key = free_name(docs, "rate"), free_name(docs, "rate_source")
    table = written(rates(docs, weights, temperature, size, source, otherwise).select(F.col("source").alias(key), F.col("rate").alias(rate)), "rates")
    if table.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, column(docs, source).cast("string").eqNullSafe(F.col(key)))
    ident = F.coalesce(column(docs, doc_id).cast("string"), F.lit(""))
    count = poisson(F.col(rate), seed, ident)
    copies = joined.withColumn(copy, F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")))).drop(rate, key)
    copies = copies.withColumn(shuffle_key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ident, F.col(copy).cast("string"))))
    # the key is uniform, so hash partitions are even, and sorted by it each is in random order
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(n, F.col(shuffle_key)).sortWithinPartitions(shuffle_key)
