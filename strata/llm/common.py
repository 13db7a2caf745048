"""What the operators share: the shared folder, written tables, column names, batches of texts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step holds at once; one longer text is a step of its own.
STEP_CHARS = 3_000_000
#: Parts that the rows of one key are dealt to where they are joined.
SALTS = 8
#: A key with more than one in so many rows is hot.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where it is unset, as in tests on a local master, a folder in the machine's temporary folder is used;
    on a cluster that would not be seen by the executors, so it is refused.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "strata-checkpoints")


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores after it until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def column(df: DataFrame, name: str) -> Column:
    """The column of that name, whatever characters the name has."""
    return df["`" + name.replace("`", "``") + "`"]


def salted(one: DataFrame, many: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has one row for each key: the rows of ``many`` of one key are dealt by a hash
    of ``by``, and the row of ``one`` stands in each of the parts."""
    parts = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(parts, [*([key] if isinstance(key, str) else key), "salt"], how).drop("salt")


def hot_salted(one: DataFrame, many: DataFrame, key: str, by: str, rows: str, how: str = "inner", keep: bool = False) -> DataFrame:
    """``salted`` for a large ``one``, which says in ``rows`` how many rows of ``many`` each key has.

    Only hot keys stand in several parts: those with more than a ``HOT_SHARE``-th of all rows, of which there are fewer
    than ``HOT_SHARE``, so their list is small enough to broadcast whatever the tables' sizes. ``keep`` keeps the counts.
    """
    total = one.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(one.filter(F.col(rows) * HOT_SHARE > F.lit(total)).select(F.col(key).alias("hot_key")))
    parts = one.withColumn("salt", F.explode(F.when(F.col(rows) * HOT_SHARE > F.lit(total), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    dealt = many.join(hot, many[key] == F.col("hot_key"), "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot_key")
    return dealt.join(parts if keep else parts.drop(rows), [key, "salt"], how).drop("salt")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def steps(texts: Sequence, limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most ``limit`` characters (or one text) each."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if i > at and held + len(text) > limit:
            yield at, i
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def comma_sha256(items: Iterable[str]) -> str:
    """Lowercase hex SHA-256 of the items, comma-joined."""
    import hashlib

    return hashlib.sha256(",".join(items).encode()).hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
