"""Sequences against plain Python lists: edge cases, states, properties."""

from collections import deque
from itertools import groupby

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata import InvalidQueryError, InvalidStateError, IteratorExhaustedError, MeteredQuery, Metrics, TypeMismatchError, as_query, from_parquet
from strata.plans import position
from strata.sources.adapters import Once

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
PAIRS = st.lists(st.tuples(st.integers(0, 5), st.integers(-9, 9)), max_size=30)


def pairs(spark, rows, **options):
    return as_query(spark, rows, "k int, v int", **options)


def plain(rows):
    return [tuple(r) for r in rows]


@FEW
@given(rows=PAIRS)
def test_stable_sorts(spark, rows):
    q = pairs(spark, rows)
    assert plain(q.order_by("k").collect()) == sorted(rows, key=lambda r: r[0])
    assert plain(q.order_by_descending("k").collect()) == sorted(rows, key=lambda r: -r[0])
    assert plain(q.order_by("k").then_by_descending("v").collect()) == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert plain(q.order_by("k").reverse().collect()) == sorted(rows, key=lambda r: r[0])[::-1]


@FEW
@given(rows=PAIRS, n=st.integers(0, 12), m=st.integers(0, 5))
def test_pages_and_duplicates(spark, rows, n, m):
    q, by = pairs(spark, rows), sorted(rows, key=lambda r: r[1])
    assert plain(q.order_by("v").skip(n).collect()) == by[n:]
    assert plain(q.order_by("v").skip(n).take(m).collect()) == by[n : n + m]
    assert plain(q.skip(n).where_("v > 0").take(m).collect()) == [r for r in rows[n:] if r[1] > 0][:m]
    assert plain(q.distinct().collect()) == list(dict.fromkeys(rows))
    assert plain(q.distinct_by("k").collect()) == list({r[0]: r for r in reversed(rows)}[k] for k in dict.fromkeys(r[0] for r in rows))


@FEW
@given(rows=PAIRS.filter(bool), size=st.integers(1, 4))
def test_positions(spark, rows, size):
    q = pairs(spark, rows)
    assert [plain(x) for x in q.chunk(size).collect()] == [rows[i : i + size] for i in range(0, len(rows), size)]
    assert [plain(x) for x in q.window(size).collect()] == [rows[i : i + size] for i in range(len(rows) - size + 1)]
    assert [r[0] for r in q.enumerate().collect()] == list(range(len(rows)))
    found = {r["k"]: plain(r["items"]) for r in q.group_by("k").collect()}
    assert found == {k: list(x) for k, x in groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0])}


def test_skip_leaves_no_single_task(spark):
    q = as_query(spark, range(100_000))
    assert "Offset" not in q.skip(10)._df._jdf.queryExecution().optimizedPlan().toString()
    assert "TakeOrdered" in q.skip(10).take(5)._df._jdf.queryExecution().executedPlan().toString()
    assert q.skip(99_990).collect() == list(range(99_990, 100_000))


def test_nothing(spark):
    q = pairs(spark, [])
    assert (q.count(), q.sum("v"), q.average("v"), q.min("v"), q.max("v")) == (0, 0, None, None, None)
    assert (q.first(), q.last(), q.min_by("v"), q.any("v > 0"), q.all("v > 0")) == (None, None, None, False, True)
    assert q.skip(3).collect() == q.chunk(2).collect() == q.window(2).collect() == q.collect() == []


def test_ties(spark):
    q = as_query(spark, [(1, "first"), (5, "second"), (5, "third"), (1, "fourth")])
    assert q.max_by("_1")["_2"] == "third" and q.min_by("_1")["_2"] == "first"
    assert (q.first()["_2"], q.last()["_2"]) == ("first", "fourth")


def test_arguments(spark):
    q = as_query(spark, [1, 2, 3])
    for call in (lambda: q.chunk(0), lambda: q.window(0), lambda: q.take(-1), lambda: q.skip(-1)):
        with pytest.raises(InvalidQueryError):
            call()
    with pytest.raises(InvalidStateError):
        q.then_by("value")
    with pytest.raises(TypeMismatchError):
        q.where_(lambda x: x > 1)


def test_strict_states(spark):
    q = as_query(spark, [3, 1, 2], strict=True)
    for call in (lambda: q.select("value"), lambda: q.order_by("value").where_("true"), lambda: q.order_by("value").order_by("value"), lambda: q.where_("true").select("value").take(1)):
        with pytest.raises(InvalidStateError):
            call()
    assert q.where_("value > 1").order_by("value").take(5).select("value * 2 AS x").collect() == [4, 6]


@pytest.mark.parametrize("source", [[3, 1, 2], (3, 1, 2), deque([3, 1, 2])])
def test_collections(spark, source):
    assert as_query(spark, source).collect() == [3, 1, 2]


def test_other_sources(spark):
    assert as_query(spark, {3, 1, 2}).collect() == [1, 2, 3]
    assert as_query(spark, range(5, 0, -2)).collect() == [5, 3, 1]
    assert plain(as_query(spark, [{"a": None, "b": "x"}, {"a": 2, "b": "y"}]).order_by("b").collect()) == [(None, "x"), (2, "y")]
    assert as_query(spark, [None, 2]).collect() == [None, 2]
    assert as_query(spark, pd.DataFrame({"a": [2, 1], "b": ["x", "y"]})).columns == ["a", "b"]
    assert as_query(spark, list("hello")).collect(str) == "hello"
    for bad in ([], 7):
        with pytest.raises(TypeMismatchError):
            as_query(spark, bad)


def test_zip_and_partition(spark):
    a, b = as_query(spark, [1, 2, 3]), as_query(spark, ["x", "y"])
    assert [(r["left"][0], r["right"][0]) for r in a.zip(b).collect()] == [(1, "x"), (2, "y")]
    yes, no = a.partition("value > 1")
    assert (yes.collect(), no.collect()) == ([2, 3], [1])


def test_window_sums(spark):
    q = as_query(spark, [1, 5, 3, 8, 2, 9, 4]).window(3)
    assert q.select(F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["value"]).alias("s")).collect() == [9, 16, 13, 19, 15]


def test_metered(spark):
    metrics = Metrics()
    q = MeteredQuery(as_query(spark, [1, 2, 3]), metrics, "numbers")
    assert q.where_("value > 1").count() == 2 and q.where_("value > 2").collect() == [3] and q.count() == 3
    assert (metrics.get("query_numbers_count"), metrics.get("query_numbers"), metrics.get("query_none")) == (2, 1, None)
    assert metrics.durations("query_numbers_count")["total"] > 0


def test_once(spark):
    source = Once(x for x in (3, 1, 2))
    assert as_query(spark, source).collect() == [3, 1, 2]
    with pytest.raises(IteratorExhaustedError):
        as_query(spark, source)


def test_distinct_without_its_order(spark):
    """A sort by the only column of distinct elements doesn't need the order from before; other sorts do."""
    q = as_query(spark, [3, 1, 3, 2, 1])
    assert q.distinct().order_by("value").collect() == [1, 2, 3] and q.distinct().order_by_descending("value").take(2).collect() == [3, 2]
    assert q.distinct().collect() == [3, 1, 2] and q.distinct().order_by("value % 2").collect() == [2, 3, 1]
    assert (q.distinct().count(), q.distinct().sum("value")) == (3, 6)


@pytest.mark.parametrize(
    ("call", "columns"),
    [
        (lambda q: q.min_by("o_orderpriority", lazy=True).select("o_orderkey"), {"o_orderkey", "o_orderpriority"}),
        (lambda q: q.max_by("o_totalprice", lazy=True).select("o_orderkey"), {"o_orderkey", "o_totalprice"}),
        (lambda q: q.order_by("o_totalprice").distinct_by("o_custkey").select("o_custkey").to_df(), {"o_custkey", "o_totalprice", "o_orderkey"}),
        (lambda q: q.where_("true").select("o_orderstatus").distinct().to_df(), {"o_orderstatus"}),
        (lambda q: q.where_("true").select("o_custkey").distinct().order_by("o_custkey").take(3).sum("o_custkey", lazy=True), {"o_custkey"}),
        (lambda q: q.where_("true").select("o_custkey", "o_orderkey").group_by("o_custkey"), {"o_custkey", "o_orderkey"}),
    ],
)
def test_scans_read_only_what_is_used(spark, call, columns):
    import re

    df = call(from_parquet(spark, "/root/testdata/sf0.001/orders.parquet", ["o_orderkey"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all({x.split(":")[0] for x in s.split(",")} <= columns for s in schemas)


def test_sorted_frames_are_released(spark):
    q = as_query(spark, range(100))
    q.enumerate().collect()
    assert position.release() >= 1 and not position.HELD
    assert [r[0] for r in as_query(spark, [5, 6]).enumerate().collect()] == [0, 1]
