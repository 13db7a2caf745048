"""The repository's writes and rules, files, the log and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from strata import ExecutionError, InvalidQueryError, InvalidStateError
from strata.sources.adapters import from_jdbc
from strata.sources.repository import Repository, StoredRepository, invalid_rows, page_info
from strata.sources.sinks import export, read_log, write_log
from strata.streaming.streams import each_batch, stream_parquet, windowed_counts, write_stream

SCHEMA = "id string, email string, name string, phone string, created_at timestamp, last_login_at timestamp"


def when(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


@pytest.fixture
def users(spark):
    rows = [("a", "a@x.org", "Ann", None, when(1), when(2)), ("b", "b@y.org", "Bob", "1", when(2), None), ("c", "c@X.org", "Cid", "2", when(3), when(4))]
    return Repository(spark.createDataFrame(rows, SCHEMA))


def test_reads(users):
    assert users.find_by_id("b").first()["name"] == "Bob"
    assert users.exists_by_email("a@x.org") and not users.exists_by_email("z")
    assert users.count_with_filters(email_domain="x.org") == 2 and users.count_with_filters(has_phone=True, name_contains="c") == 1
    page = users.find_all(2, 2)
    assert [r["id"] for r in page.rows.collect()] == ["a"] and page.info["total_pages"] == 2 and not page.info["has_next"]
    assert users.count_registrations_in_period(when(1), when(2)) == 2 and users.count_active_users_in_period(when(1), when(9)) == 2
    assert [tuple(r)[:2] for r in users.trend("day").orderBy("timestamp").collect()] == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 1)]
    for bad in (lambda: page_info(1, 0, 1), lambda: users.rows("no_such"), lambda: users.trend("day", "century")):
        with pytest.raises(InvalidQueryError):
            bad()


def test_writes(spark, users):
    new = spark.createDataFrame([("d", "d@x.org", "Dee", None, when(5), None)], SCHEMA)
    assert users.save(new).count_total() == 4 and users.count_total() == 3
    for bad in (new.withColumn("id", F.lit("a")), new.withColumn("email", F.lit("a@x.org")), new.union(new)):
        with pytest.raises(ExecutionError):
            users.save_batch(bad)
    assert users.update("b", name="Rob").find_by_id("b").first()["name"] == "Rob"
    assert users.update_last_login("b", when(9)).find_by_id("b").first()["last_login_at"] is not None
    assert users.delete("a").count_total() == 2 and users.delete("z").count_total() == 3


def test_rules(spark):
    rows = [("a@x.org", "Ann", "long enough"), ("nobody", "Ann", "long enough"), ("a@x.org", " ", "long enough"), ("a@x.org", "Ann", "short"), (None, "Ann", "long enough")]
    found = invalid_rows(spark.createDataFrame(rows, "email string, name string, password string"))
    assert sorted(r["problem"] for r in found.collect()) == ["email", "email", "name", "password"]


def test_log(spark, tmp_path):
    rows = [(when(1, 9), "Info", "GET / - 200", {}), (when(1, 9), "Error", "GET /x - 500", {"a": "b"})]
    entries = spark.createDataFrame(rows, "timestamp timestamp, level string, message string, context map<string, string>")
    for _ in range(2):
        write_log(entries, str(tmp_path / "log"))
    back = read_log(spark, str(tmp_path / "log"))
    assert back.count() == 4 and back.filter("kind = 'Error' and hour = 9").first()["context"] == {"a": "b"}


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_export(spark, tmp_path, kind):
    export(spark.range(3), str(tmp_path / "out"), kind)
    reader = spark.read.option("header", True)
    assert getattr(reader, kind)(str(tmp_path / "out")).count() == 3


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(when(1, h), "ab"[h % 2]) for h in range(12)], "ts timestamp, kind string")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream_parquet(spark, str(tmp_path / "in"), rows.schema)
    for bad in (lambda: q.take(1), lambda: q.skip(1), lambda: q.chunk(2), lambda: q.distinct()):
        with pytest.raises(InvalidStateError):
            bad()
    write_stream(q.where_("kind = 'a'").to_df(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    seen = []
    each_batch(windowed_counts(q, "ts", "6 hours", "kind"), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c2")).awaitTermination()
    assert seen and all(r["n"] == 3 for r in seen)


def test_stored_writes(spark, users, tmp_path):
    """Each write is a new version that others see; a write that fails changes nothing."""
    path = str(tmp_path / "users")
    stored = StoredRepository.create(users.df, path)
    new = spark.createDataFrame([("d", "d@x.org", "Dee", None, when(5), None)], SCHEMA)
    held = stored.df
    assert stored.save(new).count_total() == 4 == StoredRepository(spark, path).count_total() and held.count() == 3
    with pytest.raises(ExecutionError):
        StoredRepository(spark, path).save(new)
    StoredRepository(spark, path).update("d", name="Eve").update_last_login("d", when(9)).delete("a")
    rows = {r["id"]: r for r in StoredRepository(spark, path).df.collect()}
    assert sorted(rows) == ["b", "c", "d"] and rows["d"]["name"] == "Eve" and rows["d"]["last_login_at"] == when(9)
    assert len(list((tmp_path / "users").glob("v*"))) == 2  # the last version and the one before it
    with pytest.raises(ExecutionError):
        StoredRepository(spark, str(tmp_path / "nowhere"))


def test_name_index(spark, users):
    users.name_index().write.mode("overwrite").saveAsTable("name_index")
    index = spark.table("name_index")
    assert {r["word"] for r in index.collect()} == {"ann", "bob", "cid"}
    assert [r["id"] for r in users.search_by_name("N", index).collect()] == ["a"] and users.search_by_name("zz").count() == 0
    spark.sql("DROP TABLE name_index")


def test_age_filter(spark):
    rows = [("a", datetime.date(2000, 6, 15)), ("b", datetime.date(2000, 6, 16)), ("c", None), ("d", datetime.date(1950, 1, 1))]
    r = Repository(spark.createDataFrame(rows, "id string, birth_date date"))
    assert [x["id"] for x in r.filtered(age_range=(24, 30), today="2024-06-15").collect()] == ["a"]
    assert [x["id"] for x in r.filtered(age_range=(23, 24), today="2024-06-15").orderBy("id").collect()] == ["a", "b"]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "id int, name string")
    rows.write.format("jdbc").options(url=url, dbtable="people", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    q = from_jdbc(spark, url, "people", ["id"], driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert [tuple(r) for r in q.where_("id > 1").collect()] == [(2, "b"), (3, "c")]
