"""A repository over any table: lookups, search, pages, period counts, trends, and writes of whole tables."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import ExecutionError, InvalidQueryError
from strata.functions.core import PERIOD_HOURS, bucket, contains_ignoring_case, ends_ignoring_case


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    info: dict = field(default_factory=dict)


def page_info(total: int, page: int, limit: int) -> dict:
    """Pages are numbered from 1."""
    if page < 1 or limit < 1:
        raise InvalidQueryError("page and limit must be at least 1")
    pages = math.ceil(total / limit)
    return {"current_page": page, "limit": limit, "total_items": total, "total_pages": pages, "has_next": page < pages, "has_prev": page > 1}


class Repository:
    """Reads of a table of users or of anything else; ``names`` says which column plays which part."""

    PARTS = ("id", "email", "name", "phone", "birth_date", "created_at", "last_login_at")

    def __init__(self, df: DataFrame, **names: str):
        self.df, self.names = df, {p: p for p in self.PARTS} | names

    def of(self, part: str) -> Column:
        return F.col(f"`{self.names[part]}`")

    def find_by_id(self, value) -> DataFrame:
        return self.df.filter(self.of("id") == value).limit(1)

    def find_by_email(self, value: str) -> DataFrame:
        return self.df.filter(self.of("email") == value).limit(1)

    def exists_by_email(self, value: str) -> bool:
        return bool(self.find_by_email(value).count())

    def count_total(self) -> int:
        return self.df.count()

    def name_index(self) -> DataFrame:
        """(word, id): each lower-case word of each name, once; a table to write and to pass to ``search_by_name``."""
        words = F.array_distinct(F.filter(F.split(F.lower(self.of("name")), r"\s+"), lambda w: w != ""))
        return self.df.select(F.explode(words).alias("word"), self.of("id").alias("id"))

    def search_by_name(self, term: str, index: DataFrame | None = None) -> DataFrame:
        """The rows with a word in their name that contains the term, whatever its case."""
        words = self.name_index() if index is None else index
        hits = words.filter(F.contains("word", F.lit(term.lower()))).select(F.col("id").alias("hit")).distinct()
        return self.df.join(hits, self.of("id") == F.col("hit"), "left_semi")

    def find_all(self, page: int = 1, limit: int = 20) -> Page:
        return self.search(page=page, limit=limit)

    def filters(self, email_domain=None, name_contains=None, created_after=None, created_before=None, has_phone=None, age_range=None, today=None) -> list[Column]:
        """One condition for each filter that is given."""
        out = []
        if email_domain is not None:
            out.append(ends_ignoring_case(self.of("email"), email_domain))
        if name_contains is not None:
            out.append(contains_ignoring_case(self.of("name"), name_contains))
        if created_after is not None:
            out.append(self.of("created_at") >= F.lit(created_after))
        if created_before is not None:
            out.append(self.of("created_at") <= F.lit(created_before))
        if has_phone is not None:
            out.append(self.of("phone").isNotNull() if has_phone else self.of("phone").isNull())
        if age_range is not None:
            on = F.current_date() if today is None else F.lit(today).cast("date")
            age = F.floor(F.months_between(on, self.of("birth_date")) / 12)
            out.append(age.between(*age_range))
        return out

    def filtered(self, **filters) -> DataFrame:
        return reduce(DataFrame.filter, self.filters(**filters), self.df)

    def rows(self, sort: str = "created_at", descending: bool = True, page: int = 1, limit: int = 20, **filters) -> DataFrame:
        """The rows of one page: a top-k with offset, ties by id."""
        key = self.names.get(sort, sort)
        if key not in self.df.columns:
            raise InvalidQueryError(f"no column {sort} to sort by")
        page_info(0, page, limit)
        c = F.col(f"`{key}`")
        return self.filtered(**filters).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), self.of("id")).offset((page - 1) * limit).limit(limit)

    def search(self, sort: str = "created_at", descending: bool = True, page: int = 1, limit: int = 20, **filters) -> Page:
        return Page(self.rows(sort, descending, page, limit, **filters), page_info(self.filtered(**filters).count(), page, limit))

    def count_with_filters(self, **filters) -> int:
        return self.filtered(**filters).count()

    def registrations(self, start, end) -> DataFrame:
        """Both ends included, compared as times."""
        return self.df.filter(self.of("created_at").between(F.lit(start), F.lit(end)))

    def count_registrations_in_period(self, start, end) -> int:
        return self.registrations(start, end).count()

    def active_users(self, start, end) -> DataFrame:
        return self.df.filter(self.of("last_login_at").between(F.lit(start), F.lit(end))).agg(F.countDistinct(self.of("id")).alias("active_users"))

    def count_active_users_in_period(self, start, end) -> int:
        return self.active_users(start, end).first()[0]

    def trend(self, granularity: str, period: str | None = None, now=None) -> DataFrame:
        """(timestamp, value, sample_count): counts by bucket; empty buckets are absent."""
        df = self.df
        if period is not None:
            if period not in PERIOD_HOURS:
                raise InvalidQueryError(f"unknown period {period}")
            end = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
            df = df.filter(self.of("created_at") >= end - F.make_interval(hours=F.lit(PERIOD_HOURS[period])))
        out = df.groupBy(bucket(self.of("created_at"), granularity).alias("timestamp")).agg(F.count("*").alias("value"))
        return out.withColumn("sample_count", F.lit(None).cast("bigint"))

    # --- writes: a new table in place of the old one, which stays as it is

    def save(self, rows: DataFrame) -> Repository:
        """Adds rows, all or none; an id or address that is there already is an error."""
        for part in ("id", "email"):
            name = self.names[part]
            if name not in rows.columns:
                continue
            twice = rows.groupBy(F.col(f"`{name}`")).count().filter("count > 1").limit(1).count()
            there = rows.join(self.df.select(self.of(part)), name, "left_semi").limit(1).count()
            if twice or there:
                raise ExecutionError(f"{part} must be unique")
        return Repository(self.df.unionByName(rows), **self.names)

    save_batch = save

    def update(self, value, **changes) -> Repository:
        """Changes columns of the row with this id; no such row is no error."""
        hit = self.of("id") == value
        new = {self.names.get(k, k): F.when(hit, F.lit(v)).otherwise(F.col(f"`{self.names.get(k, k)}`")) for k, v in changes.items()}
        return Repository(self.df.withColumns(new), **self.names)

    def update_last_login(self, value, at) -> Repository:
        return self.update(value, last_login_at=at)

    def delete(self, value) -> Repository:
        return Repository(self.df.filter(~F.coalesce(self.of("id") == value, F.lit(False))), **self.names)


class StoredRepository(Repository):
    """A repository whose writes reach a table: each write is a new version in a folder of its own.

    A version counts once Spark has committed it (``_SUCCESS``), so a failed write changes nothing and readers see the
    version from before until then. The version before the last one stays for readers that hold it; older ones go. One
    writer at a time: writers that race would each build on the version that they saw.
    """

    def __init__(self, spark: SparkSession, path: str, **names: str):
        self.spark, self.path = spark, path.rstrip("/")
        versions = self._versions()
        if not versions:
            raise ExecutionError(f"no table at {path}; make one with StoredRepository.create")
        super().__init__(spark.read.parquet(f"{self.path}/{versions[-1]}"), **names)

    @classmethod
    def create(cls, df: DataFrame, path: str, **names: str) -> StoredRepository:
        df.write.parquet(f"{path.rstrip('/')}/v00000000")
        return cls(df.sparkSession, path, **names)

    def _files(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return where, where(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        """The names of all committed versions, the last one last."""
        where, files = self._files()
        return sorted(f.getPath().getParent().getName() for f in files.globStatus(where(f"{self.path}/v*/_SUCCESS")) or [])

    def _stored(self, changed: Repository) -> StoredRepository:
        versions = self._versions()
        changed.df.write.parquet(f"{self.path}/v{int(versions[-1][1:]) + 1:08}")
        where, files = self._files()
        for old in versions[:-1]:
            files.delete(where(f"{self.path}/{old}"), True)
        return StoredRepository(self.spark, self.path, **self.names)

    def save(self, rows: DataFrame) -> StoredRepository:
        return self._stored(super().save(rows))

    save_batch = save

    def update(self, value, **changes) -> StoredRepository:
        return self._stored(super().update(value, **changes))

    def update_last_login(self, value, at) -> StoredRepository:
        return self.update(value, last_login_at=at)

    def delete(self, value) -> StoredRepository:
        return self._stored(super().delete(value))


#: Rules of the parts of a user.
MIN_PASSWORD_BYTES = 8


def invalid_rows(df: DataFrame, **names: str) -> DataFrame:
    """Rows that break a rule of their parts, with ``problem``: address, name, password, phone or birth date."""
    part = lambda p: F.col(f"`{names.get(p, p)}`")
    has = lambda p: names.get(p, p) in df.columns
    rules = {
        "email": lambda c: c.isNull() | (c == "") | ~c.contains("@") | ~c.contains("."),
        "name": lambda c: c.isNull() | (F.trim(c) == ""),
        "password": lambda c: c.isNull() | (F.octet_length(c) < MIN_PASSWORD_BYTES),
        "phone": lambda c: c == "",
        "birth_date": lambda c: c.isNotNull() & F.try_to_date(c.cast("string"), F.lit("yyyy-MM-dd")).isNull() if hasattr(F, "try_to_date") else c.isNotNull() & ~c.cast("string").rlike(DATE.pattern),
    }
    broken = [F.when(rule(part(p)), F.lit(p)) for p, rule in rules.items() if has(p)]
    return df.withColumn("problem", F.coalesce(*broken, F.lit(None).cast("string"))).filter("problem is not null")


DATE = re.compile(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")
