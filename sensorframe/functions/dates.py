"""Date and time expressions. The session time zone is expected to be UTC."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.nulls import col


def shift_hours(c: Column | str, hours: int) -> Column:
    return col(c) + F.expr(f"INTERVAL '{int(hours)}' HOUR")


def local_time(c: Column | str, hours: int = K.UTC_OFFSET_HOURS) -> Column:
    """Wall-clock time at a fixed offset from UTC (no daylight saving)."""
    return shift_hours(c, hours)


def utc_bound(local_date: str, hours: int = K.UTC_OFFSET_HOURS) -> datetime:
    """The UTC instant at which a local date begins, as a literal that scans can be pruned with."""
    return datetime.fromisoformat(local_date) - timedelta(hours=hours)


def study_year(month: Column | str, first_year: int = K.STUDY_YEAR, first_months=None) -> Column:
    """Year a month belongs to when a study runs from November to October."""
    months = first_months or K.FIRST_YEAR_MONTHS
    m = col(month)
    return F.when(m.isin(*months), F.lit(first_year)).when(~m.isin(*months), F.lit(first_year + 1))


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(col(year).cast("int"), col(month).cast("int"), F.lit(1))


def month_label(month: Column | str) -> Column:
    """Three-letter English month name for a month number."""
    return F.try_element_at(F.array(*[F.lit(m) for m in K.MONTH_LABELS]), col(month).cast("int"))


def month_year_label(date: Column | str) -> Column:
    """Label such as ``Nov/2019``."""
    d = col(date)
    return F.concat(month_label(F.month(d)), F.lit("/"), F.year(d).cast("string"))


def hydro_rank(month: Column | str) -> Column:
    """Position of a month in the hydrological year: November is 1, October is 12."""
    return (F.pmod(col(month) + F.lit(1), F.lit(12)) + F.lit(1)).cast("int")


def month_sequence(first: Column | str, last: Column | str) -> Column:
    """Month numbers met when stepping by month from ``first`` while not past ``last``."""
    dates = F.sequence(col(first), col(last), F.expr("INTERVAL '1' MONTH"))
    return F.transform(dates, lambda d: F.month(d))
