"""One query for each operator over the test tables, each beside the SQL that has the same result."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import extensions as ext
from strata.functions.core import scalar
from strata.functions.paths import scratch
from strata.operators.metered import MeteredQuery, Metrics
from strata.operators.query import Query
from strata.sources.adapters import Once, as_query, from_parquet
from strata.sources.repository import Repository, StoredRepository, page_info
from strata.sources.sinks import export, read_log, write_log
from strata.streaming.streams import each_batch, stream_join, stream_parquet, windowed_counts, write_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "orders": ["o_orderkey"], "events": ["event_id"], "customer": ["c_custkey"], "part": ["p_partkey"]}
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def source(spark: SparkSession, sf_dir: str, table: str) -> Query:
    return from_parquet(spark, f"{sf_dir}/{table}.parquet", KEYS.get(table, LINEITEM_KEY))


def query(table: str, sql: str):
    """Registers a function of a table's query under its name, with its SQL."""

    def register(f: Callable[[Query], DataFrame]) -> Callable[[Query], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(source(spark, sf_dir, table))
        SQL[f.__name__] = sql
        return f

    return register


def two(left: str, right: str, sql: str):
    def register(f: Callable[[Query, Query], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(source(spark, sf_dir, left), source(spark, sf_dir, right))
        SQL[f.__name__] = sql
        return f

    return register


# --- filters and projections


@query("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def where_filter(q):
    return q.where_("o_totalprice > 100000").select("o_orderkey", "o_totalprice").to_df()


@query("orders", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def where_chain(q):
    return q.where_(F.col("o_totalprice") > 50000).where_("o_orderstatus = 'F'").where_("o_orderpriority like '1%'").select("o_orderkey", "o_orderstatus", "o_orderpriority").to_df()


@query("orders", "SELECT o_orderkey AS id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS price_k, o_orderkey % 7 AS bin, upper(o_orderpriority) AS priority FROM orders WHERE o_orderstatus = 'O'")
def select_project(q):
    return q.where_("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).alias("price_k"), (F.col("o_orderkey") % 7).alias("bin"), F.upper("o_orderpriority").alias("priority")).to_df()


@query("orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def inspect_passthrough(q):
    from pyspark.sql import Observation

    return q.where_("o_orderstatus = 'P'").inspect(Observation(), F.count(F.lit(1)).alias("n")).select("o_orderkey").to_df()


# --- order and pages


def ranked(order: str, n: int, where: str = "true", columns: str = "o_orderkey, o_totalprice") -> str:
    return f"SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}) AS rank, {columns} FROM orders WHERE {where}) WHERE rank <= {n}"


def top(q: Query, n: int, *columns: str) -> DataFrame:
    """The first n with ranks: few rows, so one window over them."""
    q = q.take(n)
    q.strategy = "simple"
    return q.ranked_df().select("rank", *columns)


@query("orders", ranked("o_totalprice, o_orderkey", 25))
def order_by_take(q):
    return top(q.order_by("o_totalprice"), 25, "o_orderkey", "o_totalprice")


@query("orders", ranked("o_totalprice DESC, o_orderkey", 10, "o_orderstatus = 'F'"))
def order_by_desc_take(q):
    return top(q.where_("o_orderstatus = 'F'").order_by_descending("o_totalprice"), 10, "o_orderkey", "o_totalprice")


@query("orders", ranked("o_orderpriority, o_orderstatus DESC, o_orderdate, o_orderkey", 50, columns="o_orderkey, o_orderpriority, o_orderstatus"))
def then_by_multi(q):
    return top(q.order_by("o_orderpriority").then_by_descending("o_orderstatus").then_by("o_orderdate"), 50, "o_orderkey", "o_orderpriority", "o_orderstatus")


@query("orders", ranked("o_orderstatus, o_orderpriority DESC, o_orderkey", 40, columns="o_orderkey, o_orderstatus, o_orderpriority"))
def stable_resort(q):
    return top(q.order_by_descending("o_orderpriority").where_("true").order_by("o_orderstatus"), 40, "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def skip_take_page(q):
    return q.order_by_descending("o_totalprice").skip(40).take(20).select("o_orderkey", "o_totalprice").to_df()


@query("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def skip_rest(q):
    return q.skip(100).select("o_orderkey").to_df()


@query("orders", ranked("o_totalprice DESC, o_orderkey DESC", 15))
def reverse_top(q):
    return top(q.order_by("o_totalprice").reverse(), 15, "o_orderkey", "o_totalprice")


# --- aggregates


@query("lineitem", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25")
def count_filtered(q):
    return q.where_("l_quantity > 25").count(lazy=True)


@query("lineitem", "SELECT coalesce(bool_or(l_discount > 0.09), false) AS \"any\" FROM lineitem")
def any_match(q):
    return q.any("l_discount > 0.09", lazy=True)


@query("lineitem", "SELECT coalesce(bool_and(l_quantity >= 1), true) AS \"all\" FROM lineitem")
def all_match(q):
    return q.all("l_quantity >= 1", lazy=True)


@query("lineitem", "SELECT round(sum(l_quantity), 2) AS sum FROM lineitem WHERE l_returnflag = 'R'")
def sum_quantity(q):
    return q.where_("l_returnflag = 'R'").sum("l_quantity", lazy=True).select(F.round("sum", 2).alias("sum"))


@query("lineitem", "SELECT round(avg(l_extendedprice), 4) AS average FROM lineitem")
def average_price(q):
    return q.average("l_extendedprice", lazy=True).select(F.round("average", 4).alias("average"))


@query("lineitem", "SELECT min(l_extendedprice) AS least, max(l_extendedprice) AS greatest FROM lineitem")
def min_max(q):
    return q.group_by_aggregate([], F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("greatest"))


@query("orders", "SELECT CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS sum FROM orders WHERE false")
def sum_empty(q):
    return q.where_("o_orderkey < 0").sum("o_custkey", lazy=True)


@query("orders", "SELECT avg(o_totalprice) AS average FROM orders WHERE false")
def average_empty(q):
    return q.where_("o_orderkey < 0").average("o_totalprice", lazy=True)


@query("orders", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 1")
def min_by(q):
    return q.min_by("o_orderpriority", lazy=True).select("o_orderkey", "o_orderpriority")


@query("orders", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey DESC LIMIT 1")
def max_by(q):
    return q.max_by("o_orderpriority", lazy=True).select("o_orderkey", "o_orderpriority")


@query("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_row(q):
    return q.order_by("o_orderdate").first(lazy=True).select("o_orderkey", "o_totalprice")


@query("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def last_row(q):
    return q.order_by("o_orderdate").last(lazy=True).select("o_orderkey", "o_totalprice")


@query("orders", "SELECT CAST(count(*) AS INTEGER) AS n, o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey")
def group_by_items(q):
    items = q.where_("true").select("o_custkey", "o_orderkey").group_by("o_custkey")
    return items.select("o_custkey", F.size("items").alias("n"), F.col("items")[0]["o_orderkey"].alias("first_key"), F.element_at("items", -1)["o_orderkey"].alias("last_key"))


@query(
    "lineitem",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def group_by_aggregate(q):
    return q.group_by_aggregate(
        ["l_returnflag", "l_linestatus"],
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
    )


@query("orders", "SELECT o_totalprice > 100000 AS matches, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def partition(q):
    yes, no = q.partition("o_totalprice > 100000")
    side = lambda x, m: x.to_df().agg(F.lit(m).alias("matches"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return side(yes, True).union(side(no, False))


# --- duplicates


@query("orders", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY ALL")
def distinct(q):
    return q.where_("true").select("o_orderstatus", "o_orderpriority").distinct().to_df()


@query("orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_by(q):
    return q.order_by_descending("o_totalprice").distinct_by("o_custkey").select("o_custkey", "o_orderkey", "o_totalprice").to_df()


# --- positions


@query("orders", "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS index, o_orderkey FROM orders")
def enumerate_orders(q):
    return q.order_by("o_orderdate").enumerate().to_df().select("index", "o_orderkey")


def priced(q: Query) -> Query:
    """Only what the element needs: it is packed whole."""
    return q.where_("true").select("o_orderkey", "o_totalprice")


@query(
    "orders",
    "WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, * FROM orders) SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(count(*) AS INTEGER) AS n, round(sum(o_totalprice), 2) AS total FROM p GROUP BY pos // 100",
)
def chunk(q):
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return priced(q).chunk(100).to_df().select(F.col("items")[0]["o_orderkey"].alias("first_key"), F.element_at("items", -1)["o_orderkey"].alias("last_key"), F.size("items").alias("n"), F.round(total, 2).alias("total"))


@query(
    "orders",
    "SELECT * FROM (SELECT o_orderkey AS first_key, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS n FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3",
)
def window_slide(q):
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return priced(q).window(3).to_df().select(F.col("items")[0]["o_orderkey"].alias("first_key"), F.round(total, 2).alias("total"), F.size("items").cast("long").alias("n"))


@two(
    "orders",
    "events",
    "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, o_orderkey FROM orders), b AS (SELECT row_number() OVER (ORDER BY event_id) AS p, event_id FROM events) SELECT o_orderkey, event_id FROM a JOIN b USING (p)",
)
def zip_pairs(a, b):
    a, b = (q.where_("true") for q in (a, b))
    a, b = a.select("o_orderkey"), b.select("event_id")
    return a.zip(b).to_df().select("left.o_orderkey", "right.event_id")


@query(
    "lineitem",
    "SELECT round(sum(q), 2) AS sum FROM (SELECT l_quantity * 10 + l_linenumber AS q FROM lineitem WHERE l_quantity > 10 GROUP BY 1 ORDER BY 1 LIMIT 50)",
)
def complex_chain(q):
    q = q.where_("l_quantity > 10").select((F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("q"))
    return q.distinct().order_by("q").take(50).sum("q", lazy=True).select(F.round("sum", 2).alias("sum"))


# --- the repository

CUSTOMERS = {"id": "c_custkey", "name": "c_name", "email": "c_name", "created_at": "c_acctbal", "phone": "c_mktsegment"}
EVENTS = {"id": "user_id", "created_at": "ts", "last_login_at": "ts"}


def customers(spark: SparkSession, sf_dir: str) -> Repository:
    return Repository(spark.read.parquet(f"{sf_dir}/customer.parquet"), **CUSTOMERS)


def events(spark: SparkSession, sf_dir: str) -> Repository:
    return Repository(spark.read.parquet(f"{sf_dir}/events.parquet"), **EVENTS)


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql


add("repo_find_by_id", lambda s, d: customers(s, d).find_by_id(42), "SELECT * FROM customer WHERE c_custkey = 42")
add("repo_find_by_email", lambda s, d: customers(s, d).find_by_email("Customer#000000007"), "SELECT * FROM customer WHERE c_name = 'Customer#000000007' LIMIT 1")
add(
    "repo_find_all",
    lambda s, d: customers(s, d).rows(page=2, limit=20).select("c_custkey", "c_name", "c_acctbal"),
    "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20",
)
add(
    "repo_search",
    lambda s, d: customers(s, d).rows("name", False, 1, 30, name_contains="CUSTOMER#%1", created_after=0.0, created_before=9000.0, has_phone=True).select("c_custkey", "c_name", "c_acctbal"),
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name ILIKE '%CUSTOMER#%1%' AND c_acctbal >= 0 AND c_acctbal <= 9000 AND c_mktsegment IS NOT NULL ORDER BY c_name, c_custkey LIMIT 30",
)


def repo_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = page_info(customers(spark, sf_dir).count_with_filters(name_contains="1"), 2, 20)
    return spark.createDataFrame([tuple(info.values())], "current_page bigint, page_limit bigint, total_items bigint, total_pages bigint, has_next boolean, has_prev boolean")


add(
    "repo_page_meta",
    repo_page_meta,
    "SELECT CAST(2 AS BIGINT) AS current_page, CAST(20 AS BIGINT) AS page_limit, count(*) AS total_items, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 2 < ceil(count(*) / 20.0) AS has_next, true AS has_prev FROM customer WHERE c_name ILIKE '%1%'",
)
add("repo_count_total", lambda s, d: s.createDataFrame([(customers(s, d).count_total(),)], "n bigint"), "SELECT count(*) AS n FROM customer")
add(
    "repo_exists_by_email",
    lambda s, d: s.createDataFrame([(m, customers(s, d).exists_by_email(m)) for m in ("Customer#000000007", "nobody")], "email string, found boolean"),
    "SELECT 'Customer#000000007' AS email, count(*) > 0 AS found FROM customer WHERE c_name = 'Customer#000000007' UNION ALL SELECT 'nobody', count(*) > 0 FROM customer WHERE c_name = 'nobody'",
)
add(
    "repo_search_by_name",
    lambda s, d: customers(s, d).search_by_name("MER#00000001").select("c_custkey", "c_name"),
    "SELECT c_custkey, c_name FROM customer WHERE list_bool_or(list_transform(string_split(lower(c_name), ' '), lambda w: contains(w, 'mer#00000001')))",
)


def repo_age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("birth_date", F.date_add(F.lit("1950-01-01").cast("date"), F.col("c_custkey").cast("int") * 37 % 25_000))
    return Repository(born, **CUSTOMERS).filtered(age_range=(18, 40), today="2024-06-15").select("c_custkey")


add(
    "repo_age_filter",
    repo_age_filter,
    "SELECT c_custkey FROM customer WHERE date_sub('year', DATE '1950-01-01' + (c_custkey * 37 % 25000)::INTEGER, DATE '2024-06-15') BETWEEN 18 AND 40",
)


def repo_stored_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is made, added to, changed and cut, read from its last version."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    stored = StoredRepository.create(users.filter("c_custkey <= 50"), scratch(spark, "customers"), **CUSTOMERS)
    stored = stored.save_batch(users.filter("c_custkey between 51 and 60")).update(7, name="Seven").delete(9)
    return StoredRepository(spark, stored.path, **CUSTOMERS).df


add(
    "repo_stored_writes",
    repo_stored_writes,
    "SELECT c_custkey, CASE c_custkey WHEN 7 THEN 'Seven' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey <= 60 AND c_custkey <> 9",
)


def repo_period_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir)
    bounds = r.df.agg((F.min("ts") + F.expr("interval 1 day")).alias("a"), (F.max("ts") - F.expr("interval 1 day")).alias("b")).first()
    return r.registrations(bounds["a"], bounds["b"]).agg(F.count("*").alias("n"))


def repo_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir)
    bounds = r.df.agg((F.min("ts") + F.expr("interval 1 day")).alias("a"), (F.max("ts") - F.expr("interval 1 day")).alias("b")).first()
    return r.active_users(bounds["a"], bounds["b"])


BOUNDS = "ts BETWEEN (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND (SELECT max(ts) - INTERVAL 1 DAY FROM events)"
add("repo_period_count", repo_period_count, f"SELECT count(*) AS n FROM events WHERE {BOUNDS}")
add("repo_active_users", repo_active_users, f"SELECT count(DISTINCT user_id) AS active_users FROM events WHERE {BOUNDS}")
#: What DuckDB calls the bucket formats.
STRFTIME = {"minute": "%Y-%m-%d %H:%M:00", "hour": "%Y-%m-%d %H:00:00", "day": "%Y-%m-%d", "week": "%Y-%W", "month": "%Y-%m"}
for granularity, pattern in STRFTIME.items():
    add(
        f"repo_trend_{granularity}",
        lambda s, d, g=granularity: events(s, d).trend(g).drop("sample_count"),
        f"SELECT strftime(ts, '{pattern}') AS timestamp, count(*) AS value FROM events GROUP BY 1",
    )



def repo_trend_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir)
    now = r.df.agg(F.max("ts").alias("now")).first()["now"]
    return r.trend("hour", "week", now).drop("sample_count")


add("repo_trend_period", repo_trend_period, "SELECT strftime(ts, '%Y-%m-%d %H:00:00') AS timestamp, count(*) AS value FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 168 HOUR FROM events) GROUP BY 1")

# --- collections, terminals, files and streams


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last element and the sum of each kind of local collection."""
    kinds = {"list": [3, 1, 2], "tuple": (3, 1, 2), "range": range(3, 0, -1), "deque": deque([3, 1, 2]), "set": {3, 1, 2}, "frozenset": frozenset([3, 1, 2]), "pandas": pd.DataFrame({"value": [3, 1, 2]}), "once": Once(iter([3, 1, 2]))}
    found = {k: as_query(spark, x) for k, x in kinds.items()}
    return spark.createDataFrame([(k, int(q.first()[0]), int(q.last()[0]), int(q.sum("value"))) for k, q in found.items()], "kind string, first bigint, last bigint, total bigint")


add(
    "collections",
    collections,
    "SELECT * FROM (VALUES ('list', 3, 2, 6), ('tuple', 3, 2, 6), ('range', 3, 1, 6), ('deque', 3, 2, 6), ('set', 1, 3, 6), ('frozenset', 1, 3, 6), ('pandas', 3, 2, 6), ('once', 3, 2, 6)) t(kind, first, last, total)",
)


@query("orders", "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place, o_orderkey FROM orders QUALIFY place <= 12")
def collect_rows(q):
    rows = q.order_by_descending("o_totalprice").take(12).collect()
    return q.to_df().sparkSession.createDataFrame([(i + 1, r["o_orderkey"]) for i, r in enumerate(rows)], "place bigint, o_orderkey bigint")


@query("orders", "SELECT * FROM (VALUES ('query_orders', 1), ('query_orders_count', 2), ('query_orders_sum', 1), ('query_orders_first', 1)) t(name, calls)")
def metered_counts(q):
    metrics = Metrics()
    m = MeteredQuery(q, metrics, "orders")
    m.count(), m.where_("o_orderstatus = 'F'").count(), m.sum("o_totalprice"), m.first(), m.take(3).collect()
    names = ["query_orders", "query_orders_count", "query_orders_sum", "query_orders_first"]
    return q.to_df().sparkSession.createDataFrame([(n, metrics.get(n)) for n in names], "name string, calls bigint")


@query("nation", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey)[1] AS first_name, count(*) AS n FROM nation GROUP BY 1")
def group_by_apply(q):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("n_nationkey")
        return pd.DataFrame({"n_regionkey": [rows.n_regionkey.iloc[0]], "first_name": [rows.n_name.iloc[0]], "n": [len(rows)]})

    return q.group_by_apply(["n_regionkey"], of, "n_regionkey int, first_name string, n bigint")


@query("nation", "SELECT n_nationkey, length(n_name) * 2 AS size FROM nation")
def scalar_function(q):
    return q.where_("true").select("n_nationkey", scalar(lambda x: 2 * len(x), "bigint")(F.col("n_name")).alias("size")).to_df()


def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, written as each kind of file and read again."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = None
    for kind in ("json", "csv", "parquet"):
        path = scratch(spark, f"export-{kind}")
        export(nations, path, kind)
        back = spark.read.schema(nations.schema).option("header", True).format(kind).load(path).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out


add("export_round_trip", export_round_trip, "SELECT nation.*, kind FROM nation, (VALUES ('json'), ('csv'), ('parquet')) k(kind)")


def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of the request log, written, read again and counted by its folders."""
    path = scratch(spark, "log")
    level = F.when(F.col("value") > 100, "Error").otherwise("Info")
    entries = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"), level.alias("level"), F.col("event_type").alias("message"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("context"))
    write_log(entries, path)
    return read_log(spark, path).groupBy("hour", "kind").agg(F.count("*").alias("n"), F.sum(F.col("context")["id"].cast("bigint")).alias("ids"))


add("log_round_trip", log_round_trip, "SELECT CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN value > 100 THEN 'Error' ELSE 'logs' END AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2")


def streamed(spark: SparkSession, sf_dir: str, table: str) -> Query:
    """A table's rows as a stream of files."""
    path = scratch(spark, f"stream-{table}")
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows.write.parquet(path)
    return stream_parquet(spark, path, rows.schema)


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "streamed")
    q = streamed(spark, sf_dir, "events").where_("event_id % 3 = 0").select("event_id", "event_type")
    write_stream(q.to_df(), out, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.schema("event_id bigint, event_type string").parquet(out)


add("stream_filter", stream_filter, "SELECT event_id, event_type FROM events WHERE event_id % 3 = 0")


def stream_windows(spark: SparkSession, sf_dir: str, slide: str | None = None) -> DataFrame:
    out = scratch(spark, "windows")
    counts = windowed_counts(streamed(spark, sf_dir, "events"), "ts", "2 hours", "event_type", slide=slide)
    flat = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    each_batch(flat, lambda df, _: df.write.mode("overwrite").parquet(out), scratch(spark, "stream-state"), "complete").awaitTermination()
    return spark.read.schema("start timestamp_ntz, event_type string, n bigint").parquet(out)


add("stream_windows", stream_windows, "SELECT time_bucket(INTERVAL 2 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add(
    "stream_sliding_windows",
    lambda s, d: stream_windows(s, d, "1 hour"),
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) s(k) GROUP BY 1, 2",
)


def stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "joined")
    q = streamed(spark, sf_dir, "events")
    a, b = (streamed(spark, sf_dir, "events").where_(f"event_id % 2 = {i}").select("event_id", "user_id", "ts") for i in (0, 1))
    both = stream_join(a, b, "user_id", "ts", "ts", "6 hours", late="100 days")
    write_stream(both.select(F.col("left.event_id").alias("first_id"), F.col("right.event_id").alias("second_id")), out, scratch(spark, "stream-state")).awaitTermination()
    return q.to_df().sparkSession.read.schema("first_id bigint, second_id bigint").parquet(out)


add(
    "stream_join",
    stream_joined,
    "SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR",
)

# --- beyond the sequence API


@two("region", "nation", "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def ext_cross_join(a, b):
    return ext.cross_join(a, b).select("left.r_regionkey", "right.n_nationkey")


@two("orders", "customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def ext_join_merge(a, b):
    return ext.join(a, b, "o_custkey", "c_custkey", strategy="merge").select("left.o_orderkey", "right.c_name")


@two("customer", "nation", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def ext_join_broadcast(a, b):
    return ext.join(a, b, "c_nationkey", "n_nationkey", strategy="broadcast").select("left.c_custkey", "right.n_name")


@query("events", "SELECT event_type AS bucket, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def ext_percentiles(q):
    out = ext.performance_summary(q.to_df(), "value", "event_type", accuracy=None)
    return out.select("bucket", *(F.round(c, 6).alias(c) for c in ("median", "p95", "p99")))


@query("events", "SELECT count(*) AS total_requests, round(avg(value), 6) AS avg_response_time, round(avg((value > 50)::INT) * 100, 6) AS error_rate_percent FROM events")
def ext_request_summary(q):
    return ext.request_summary(q.to_df(), "value", "value > 50").select("total_requests", F.round("avg_response_time", 6).alias("avg_response_time"), F.round("error_rate_percent", 6).alias("error_rate_percent"))


@query("events", "SELECT event_type AS endpoint, round(avg(value), 6) AS avg_time, count(*) AS call_count FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 3")
def ext_slowest_endpoints(q):
    return ext.slowest_endpoints(q.to_df(), "event_type", "value", 3).select("endpoint", F.round("avg_time", 6).alias("avg_time"), "call_count")


@two("orders", "customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def ext_join_inner(a, b):
    return ext.join(a, b, "o_custkey", "c_custkey").select("left.o_orderkey", "right.c_name")


@two("customer", "orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def ext_join_left(a, b):
    return ext.join(a, b, "c_custkey", "o_custkey", "left").select("left.c_custkey", "right.o_orderkey")


@two("orders", "customer", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def ext_join_right(a, b):
    return ext.join(a, b, "o_custkey", "c_custkey", "right").select("left.o_orderkey", "right.c_custkey")


@two("orders", "customer", "SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey")
def ext_join_full(a, b):
    return ext.join(a, b, "o_custkey", "c_custkey", "full", "hash").select("left.o_orderkey", "right.c_custkey")


@two("customer", "orders", "SELECT c_custkey, n, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def ext_group_join(a, b):
    out = ext.group_join(a, b, "c_custkey", "o_custkey", F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return out.select("c_custkey", "n", F.round("total", 2).alias("total"))


def keys(q: Query, where: str, column: str) -> Query:
    return q.where_(where).select(F.col(column).alias("k"))


@two("orders", "customer", "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def ext_union(a, b):
    return ext.union(keys(a, "o_orderkey % 2 = 0", "o_custkey"), keys(b, "c_acctbal < 0", "c_custkey"))


@two("orders", "customer", "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def ext_concat(a, b):
    return ext.concat(keys(a, "o_orderkey % 2 = 0", "o_custkey"), keys(b, "c_acctbal < 0", "c_custkey"))


@two("orders", "customer", "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def ext_intersect(a, b):
    return ext.intersect(keys(a, "o_orderkey % 2 = 0", "o_custkey"), keys(b, "c_acctbal < 0", "c_custkey"))


@two("orders", "customer", "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def ext_except(a, b):
    return ext.except_(keys(a, "o_orderkey % 2 = 0", "o_custkey"), keys(b, "c_acctbal < 0", "c_custkey"))


@query("events", "SELECT event_type AS bucket, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg FROM events GROUP BY 1")
def ext_performance(q):
    return ext.performance_summary(q.to_df(), "value", "event_type").select("bucket", "n", "min", "max", F.round("avg", 6).alias("avg"))
