"""Columns for what closures say elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.errors import InvalidQueryError

#: Bucket formats by granularity.
FORMATS = {"minute": "yyyy-MM-dd HH:mm:'00'", "hour": "yyyy-MM-dd HH:'00':'00'", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
#: Hours of a period.
PERIOD_HOURS = {"hour": 1, "day": 24, "week": 168, "month": 720, "year": 8760}


def scalar(function: Callable, returns: str) -> Callable[..., Column]:
    """A Python function as a column function, by Arrow batches. Spark can't see through it: prefer columns."""
    return F.udf(function, returns, useArrow=True)


def bucket(ts: Column, granularity: str) -> Column:
    """The time bucket as text; weeks begin on Monday and are numbered from 00, the days before the first one."""
    if granularity == "week":
        day = F.dayofyear(ts) + 6 - F.weekday(ts)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(F.floor(day / 7).cast("string"), 2, "0"))
    if granularity not in FORMATS:
        raise InvalidQueryError(f"unknown granularity {granularity}")
    return F.date_format(ts, FORMATS[granularity])


def contains_ignoring_case(c: Column, part: str) -> Column:
    """LIKE '%part%' without regard to case; % and _ in the part are wildcards."""
    return c.ilike(f"%{part}%")


def ends_ignoring_case(c: Column, part: str) -> Column:
    return c.ilike(f"%{part}")
