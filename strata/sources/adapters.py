"""Sources: what can become a query."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from strata.errors import IteratorExhaustedError, TypeMismatchError
from strata.operators.query import Query


def from_parquet(spark: SparkSession, path: str, order_key: list[str] | None = None, **options) -> Query:
    return Query.from_df(spark.read.parquet(path), order_key, **options)


def from_jdbc(spark: SparkSession, url: str, table: str, order_key: list[str] | None = None, **options) -> Query:
    """A database table; ``options`` are those of Spark's JDBC source, such as partitionColumn and its bounds."""
    return Query.from_df(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), order_key)


class Once:
    """What can be read once only, such as a generator; a second read is an error."""

    def __init__(self, items: Iterable):
        self._items = items

    def __iter__(self):
        if self._items is None:
            raise IteratorExhaustedError("this source was read already")
        items, self._items = self._items, None
        return iter(items)


def as_query(spark: SparkSession, source, schema: str | None = None, **options) -> Query:
    """A DataFrame, list, tuple, range, deque, set (ordered if ``sorted``), ``Once`` or pandas frame as a query in its order.

    Local collections are numbered and go to Spark once; the collection itself stays as it is.
    """
    if isinstance(source, DataFrame):
        return Query.from_df(source, **options)
    if isinstance(source, range):
        step = source.step
        df = spark.range(source.start, source.stop, step).toDF("value")
        return Query.from_df(df, ["value" if step > 0 else "-value"], **options)
    if isinstance(source, pd.DataFrame):
        columns = list(source.columns)
        rows: Iterable = source.itertuples(index=False, name=None)
        if schema is None:  # pandas' types stay, for columns of nulls too
            schema = spark.createDataFrame(source.head(1)).schema.simpleString()[len("struct<") : -1] if len(source) else None
    elif isinstance(source, (list, tuple, deque, set, frozenset, Once)):
        columns, rows = None, sorted(source) if isinstance(source, (set, frozenset)) and options.pop("sorted", True) else list(source)
        options.pop("sorted", None)
    else:
        raise TypeMismatchError(f"no query from {type(source).__name__}")
    many = list(rows)
    if many and isinstance(many[0], dict):
        columns = list(dict.fromkeys(k for x in many for k in x))
        many = [tuple(x.get(c) for c in columns) for x in many]
    many = [(i, *x) if isinstance(x, (tuple, list)) else (i, x) for i, x in enumerate(many)]
    if schema is None:
        if not many:
            raise TypeMismatchError("an empty collection needs a schema")
        width = len(many[0]) - 1
        # types are those of all rows, so a null at the front does no harm
        df = spark.createDataFrame(many, ["__position", *(map(str, columns) if columns else ["value"] if width == 1 else (f"_{i + 1}" for i in range(width)))])
    else:
        df = spark.createDataFrame(many, ("__position: bigint, " if ":" in schema else "__position bigint, ") + schema)
    query = Query.from_df(df, ["__position"], **options)
    return query._to(query._df.drop("__position"))
