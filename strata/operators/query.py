"""The fluent query: an immutable DataFrame, its order and its state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strata.errors import InvalidQueryError, InvalidStateError, TypeMismatchError
from strata.plans.order import HIDDEN, Key, Order
from strata.plans.position import chunked, dense_index, windowed

INITIAL, FILTERED, SORTED, PROJECTED = "Initial", "Filtered", "Sorted", "Projected"
Expression = Column | str


def column_of(x: Expression) -> Column:
    """A column, or the expression that a string of SQL says."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.expr(x)
    raise TypeMismatchError(f"expected a column or SQL, not {type(x).__name__}; wrap a Python function with strata.functions.scalar")


def legal(*states: str) -> Callable:
    """In strict mode, an operator raises outside these states."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def checked(self: Query, *args, **options):
            if self.strict and self.state not in states:
                raise InvalidStateError(f"{f.__name__} is not allowed in state {self.state}")
            return f(self, *args, **options)

        return checked

    return wrap


class Query:
    """Operators return new queries; terminals run, or with ``lazy=True`` return a DataFrame of one row."""

    def __init__(self, df: DataFrame, order: Order, state: str = INITIAL, strict: bool = False, strategy: str = "scalable"):
        self._df, self._order, self.state, self.strict, self.strategy = df, order, state, strict, strategy
        self._skipped: tuple[Query, int] | None = None  # what skip was called on, and with which number
        self._bag: DataFrame | None = None  # the same elements where their order doesn't matter

    # --- making and showing

    @classmethod
    def from_df(cls, df: DataFrame, order_key: list[Expression] | None = None, strict: bool = False, strategy: str = "scalable") -> Query:
        """A sequence of the rows of ``df`` by a unique key; without one, in the order in which Spark reads them."""
        keys = [column_of(k) for k in order_key] if order_key else ([] if df.isStreaming else [F.monotonically_increasing_id()])
        names = [f"{HIDDEN}{i}" for i in range(len(keys))]
        return cls(df.withColumns(dict(zip(names, keys, strict=True))), Order((), tuple(map(Key, names))), INITIAL, strict, strategy)

    def _to(self, df: DataFrame | None = None, order: Order | None = None, state: str | None = None) -> Query:
        return Query(self._df if df is None else df, order or self._order, state or self.state, self.strict, self.strategy)

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if not c.startswith(HIDDEN)]

    @property
    def item(self) -> Column:
        """The element as a struct."""
        return F.struct(*(F.col(f"`{c}`") for c in self.columns))

    def to_df(self) -> DataFrame:
        """The elements without an order."""
        return (self._df if self._bag is None else self._bag).select(*(f"`{c}`" for c in self.columns))

    def sorted_df(self) -> DataFrame:
        """The elements, sorted."""
        return self._sorted().select(*(f"`{c}`" for c in self.columns))

    def ranked_df(self, name: str = "rank") -> DataFrame:
        """The elements with their positions from 1."""
        out = dense_index(self._df, self._order.columns(), f"{HIDDEN}p", self.strategy)
        return out.select((F.col(f"{HIDDEN}p") + 1).alias(name), *(f"`{c}`" for c in self.columns))

    def _sorted(self) -> DataFrame:
        if self._df.isStreaming:
            raise InvalidStateError("a stream has no order")
        return self._df.orderBy(*self._order.columns()) if self._order.keys else self._df

    def _fresh(self) -> str:
        used = {c for c in self._df.columns if c.startswith(HIDDEN)}
        return next(f"{HIDDEN}{i}" for i in range(len(used) + 1) if f"{HIDDEN}{i}" not in used)

    # --- filters and projections

    @legal(INITIAL, FILTERED)
    def where_(self, predicate: Expression) -> Query:
        return self._to(self._df.filter(column_of(predicate)), self._order.settled(), FILTERED)

    @legal(FILTERED)
    def select(self, *expressions: Expression) -> Query:
        hidden = [c for c in self._df.columns if c.startswith(HIDDEN)]
        return self._to(self._df.select(*map(column_of, expressions), *hidden), self._order.settled(), PROJECTED)

    @legal(INITIAL, FILTERED, SORTED)
    def inspect(self, observation: Observation | Callable[[dict], None], *metrics: Column) -> Query:
        """Observes the elements that pass: metrics in an Observation, or a function of each element.

        A function runs row by row in Python on the executors: for debugging, not for main paths.
        """
        state = FILTERED if self.state == SORTED else self.state
        if isinstance(observation, Observation):
            return self._to(self._df.observe(observation, *(metrics or (F.count(F.lit(1)).alias("n"),))), state=state)
        names, call = self.columns, observation

        def tap(batches: Iterator) -> Iterator:
            for batch in batches:
                for row in batch[names].to_dict("records"):
                    call(row)
                yield batch

        return self._to(self._df.mapInPandas(tap, self._df.schema), state=state)

    # --- order

    def _by(self, key: Expression, ascending: bool, more: bool) -> Query:
        name = self._fresh()
        k = Key(name, ascending)
        return self._to(self._df.withColumn(name, column_of(key)), self._order.then(k) if more else self._order.sorted_by(k), SORTED)

    @legal(INITIAL, FILTERED)
    def order_by(self, key: Expression) -> Query:
        return self._reordered(key, True) or self._by(key, True, False)

    @legal(INITIAL, FILTERED)
    def order_by_descending(self, key: Expression) -> Query:
        """Ties keep the order from before."""
        return self._reordered(key, False) or self._by(key, False, False)

    def _reordered(self, key: Expression, ascending: bool) -> Query | None:
        """After distinct, a sort by the only column leaves no ties, so nothing is left of the order from before."""
        if self._bag is None or not isinstance(key, str) or self.columns != [key]:
            return None
        name = f"{HIDDEN}0"
        return self._to(self._bag.withColumn(name, F.col(f"`{key}`")), Order((Key(name, ascending),)), SORTED)

    def then_by(self, key: Expression) -> Query:
        return self._then(key, True)

    def then_by_descending(self, key: Expression) -> Query:
        return self._then(key, False)

    def _then(self, key: Expression, ascending: bool) -> Query:
        if not self._order.explicit:
            raise InvalidStateError("then_by needs an order_by before it")
        return self._by(key, ascending, True)

    @legal(INITIAL, FILTERED, SORTED)
    def reverse(self) -> Query:
        return self._to(order=self._order.reversed(), state=FILTERED)

    @legal(INITIAL, FILTERED, SORTED)
    def take(self, n: int) -> Query:
        """The first n elements: a top-k, also straight after skip."""
        before, skipped = self._skipped or (self, 0)
        rows = before._sorted().limit(skipped + whole(n))
        return self._to(rows.offset(skipped) if skipped else rows, self._order.settled(), FILTERED)

    @legal(INITIAL, FILTERED, SORTED)
    def skip(self, n: int) -> Query:
        """All but the first n elements, by position: an offset alone would bring all rows into one task."""
        if self._df.isStreaming:
            raise InvalidStateError("a stream has no order")
        if whole(n) == 0:
            return self._to(order=self._order.settled(), state=FILTERED)
        at = f"{HIDDEN}p"
        rows = dense_index(self._df, self._order.columns(), at, self.strategy)
        out = self._to(rows.filter(F.col(at) >= n).drop(at), self._order.settled(), FILTERED)
        out._skipped = (self, n)
        return out

    # --- duplicates

    @legal(INITIAL, FILTERED, SORTED)
    def distinct(self) -> Query:
        """The first of equal elements."""
        out = self._first_by([F.col(f"`{c}`") for c in self.columns])
        out._bag = self.to_df().distinct()
        return out

    @legal(INITIAL, FILTERED, SORTED)
    def distinct_by(self, *keys: Expression) -> Query:
        """The first element of each key."""
        return self._first_by([column_of(k) for k in keys])

    def _first_by(self, keys: list[Column]) -> Query:
        if self._df.isStreaming:
            raise InvalidStateError("a stream has no first element")
        # an aggregate with partial sums: at most one row a key leaves a task; columns that no later step uses are pruned
        names = {f"{HIDDEN}k{i}": k for i, k in enumerate(keys)}
        first = rank(self._order, self._df)
        found = self._df.withColumns(names).groupBy(*names).agg(*(F.min_by(f"`{c}`", first).alias(c) for c in self._df.columns))
        return self._to(found.drop(*names), self._order.settled(), FILTERED)

    # --- positions

    @legal(INITIAL, FILTERED, SORTED)
    def enumerate(self, name: str = "index") -> Query:
        """Elements with their positions from 0."""
        at = f"{HIDDEN}0"
        out = dense_index(self._df, self._order.columns(), f"{HIDDEN}p", self.strategy)
        out = out.select(F.col(f"{HIDDEN}p").alias(name), *(f"`{c}`" for c in self.columns if c != name), F.col(f"{HIDDEN}p").alias(at))
        return self._to(out, Order((), (Key(at),)), FILTERED)

    def _positions(self) -> DataFrame:
        return dense_index(self._df, self._order.columns(), f"{HIDDEN}p", self.strategy).select(F.col(f"{HIDDEN}p"), self.item.alias("item"))

    @legal(INITIAL, FILTERED, SORTED)
    def chunk(self, size: int) -> Query:
        """Arrays ``items`` of consecutive elements."""
        if size < 1:
            raise InvalidQueryError("chunk size must be greater than 0")
        out = chunked(self._positions(), f"{HIDDEN}p", size, F.col("item"))
        return self._to(out.select("items", F.col("chunk").alias(f"{HIDDEN}0")), Order((), (Key(f"{HIDDEN}0"),)), FILTERED)

    @legal(INITIAL, FILTERED, SORTED)
    def window(self, size: int) -> Query:
        """Arrays ``items`` of each run of consecutive elements."""
        if size < 1:
            raise InvalidQueryError("window size must be greater than 0")
        out = windowed(self._positions(), f"{HIDDEN}p", size, F.col("item"))
        return self._to(out.select("items", F.col("position").alias(f"{HIDDEN}0")), Order((), (Key(f"{HIDDEN}0"),)), FILTERED)

    @legal(INITIAL, FILTERED, SORTED)
    def zip(self, other: Query) -> Query:
        """Pairs of elements at equal positions, as long as both have one."""
        mine, theirs = self._positions().withColumnRenamed("item", "left"), other._positions().withColumnRenamed("item", "right")
        out = mine.join(theirs, f"{HIDDEN}p").select("left", "right", F.col(f"{HIDDEN}p").alias(f"{HIDDEN}0"))
        return self._to(out, Order((), (Key(f"{HIDDEN}0"),)), FILTERED)

    # --- terminals

    def _value(self, value: Column, name: str, lazy: bool):
        out = (self._df if self._bag is None else self._bag).agg(value.alias(name))
        return out if lazy else out.first()[0]

    def count(self, lazy: bool = False):
        return self._value(F.count(F.lit(1)), "count", lazy)

    def sum(self, x: Expression, lazy: bool = False):
        """0 without elements."""
        return self._value(F.coalesce(F.sum(column_of(x)), F.lit(0)), "sum", lazy)

    def average(self, x: Expression, lazy: bool = False):
        """None without elements."""
        return self._value(F.avg(column_of(x).cast("double")), "average", lazy)

    def min(self, x: Expression | None = None, lazy: bool = False):
        """The least value, or the least element by its columns from the left; whatever the query's order."""
        return self._value(F.min(self.item if x is None else column_of(x)), "min", lazy)

    def max(self, x: Expression | None = None, lazy: bool = False):
        return self._value(F.max(self.item if x is None else column_of(x)), "max", lazy)

    def min_by(self, key: Expression, lazy: bool = False):
        """The first of the elements with the least key."""
        return self._row(F.min_by, key, lazy)

    def max_by(self, key: Expression, lazy: bool = False):
        """The last of the elements with the greatest key."""
        return self._row(F.max_by, key, lazy)

    def _row(self, by: Callable[[str, Column], Column], key: Expression, lazy: bool):
        """The element that an aggregate chooses, column by column, so those that no later step uses are pruned."""
        at = F.struct(column_of(key), rank(self._order, self._df))
        some = f"{HIDDEN}some"
        out = self._df.agg(F.count(F.lit(1)).alias(some), *(by(f"`{c}`", at).alias(c) for c in self.columns)).filter(f"{some} > 0").drop(some)
        return out if lazy else out.first()

    def first(self, lazy: bool = False):
        out = self.sorted_df().limit(1)
        return out if lazy else out.first()

    def last(self, lazy: bool = False):
        return self.reverse().first(lazy) if not self.strict else self._to(order=self._order.reversed()).first(lazy)

    def any(self, predicate: Expression, lazy: bool = False):
        """False without elements; stops at the first match."""
        p = F.coalesce(column_of(predicate), F.lit(False))
        return self._value(F.coalesce(F.bool_or(p), F.lit(False)), "any", True) if lazy else bool(self._df.filter(p).limit(1).count())

    def all(self, predicate: Expression, lazy: bool = False):
        """True without elements; stops at the first failure."""
        p = F.coalesce(column_of(predicate), F.lit(False))
        return self._value(F.coalesce(F.bool_and(p), F.lit(True)), "all", True) if lazy else not self._df.filter(~p).limit(1).count()

    def group_by(self, *keys: Expression) -> DataFrame:
        """(keys, items): the elements of each key in order. A group is one row; aggregate large ones instead."""
        row = F.struct(rank(self._order, self._df).alias("p"), self.item.alias("x"))
        return self._df.groupBy(*map(column_of, keys)).agg(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["x"]).alias("items"))

    def group_by_aggregate(self, keys: Expression | list[Expression], *aggregates: Column) -> DataFrame:
        """Aggregates of each key, with partial sums in each task."""
        return self._df.groupBy(*map(column_of, keys if isinstance(keys, list) else [keys])).agg(*aggregates)

    def group_by_apply(self, keys: list[str], function: Callable, schema: str) -> DataFrame:
        """For what no aggregate says: a pandas function of each group, which must fit into a task's memory."""
        return self.to_df().groupBy(*keys).applyInPandas(function, schema)

    def partition(self, predicate: Expression) -> tuple[Query, Query]:
        """The elements that match and the others, both in order."""
        p = F.coalesce(column_of(predicate), F.lit(False))
        order = self._order.settled()
        return self._to(self._df.filter(p), order, FILTERED), self._to(self._df.filter(~p), order, FILTERED)

    def collect(self, to: type = list):
        """The elements on the driver: a list in order, a set, a sorted list, or a string of one column's values."""
        rows = self.sorted_df().collect()
        values = [r[0] for r in rows] if len(self.columns) == 1 else rows
        if to is str:
            return "".join(map(str, values))
        return sorted(values) if to is sorted else to(values)


def whole(n: int) -> int:
    if n < 0:
        raise InvalidQueryError("a number of elements must not be negative")
    return n


def rank(order: Order, df: DataFrame) -> Column:
    """A struct that compares as the order does. Keys in descending order compare by what is opposite to them."""
    kinds = dict(df.dtypes)
    return F.struct(*(F.col(k.name) if k.ascending else opposite(F.col(k.name), kinds[k.name]) for k in order.keys)) if order.keys else F.struct(F.lit(0))


def opposite(c: Column, kind: str) -> Column:
    """A value that compares the other way round; null, the least, becomes the greatest."""
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        wide = F.struct(c.isNull(), (-c.cast("decimal(38,0)" if not kind.startswith("decimal") else kind)))
        return wide
    if kind in ("float", "double"):
        return F.struct(c.isNull(), -c)
    if kind == "boolean":
        return F.struct(c.isNull(), ~c)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.struct(c.isNull(), -F.unix_micros(c.cast("timestamp")))
    if kind in ("string", "binary"):
        # each byte's complement and an end mark above all of them, in hex digits
        return F.struct(c.isNull(), F.concat(F.translate(F.hex(c.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
    raise TypeMismatchError(f"no descending order of {kind} here")
