"""Row filters and row-local masking of raw readings. Everything here is one projection stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.dates import local_time, utc_bound
from sensorframe.functions.nulls import if_else, in_set, is_finite
from sensorframe.operators.reshape import compact_join


def exclude_sites(
    df: DataFrame,
    area: str = K.MANAGED_AREA,
    site_from: int = K.MANAGED_SITE_FROM,
    areas: Sequence[str] = tuple(K.EXCLUDED_AREAS),
) -> DataFrame:
    """Drop the managed sites of one area and whole areas by name."""
    managed = (F.col("area") == area) & (F.col("site") >= site_from)
    return df.filter(~managed).filter(~in_set("area", areas))


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(in_set(column, values))


def drop_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with null in the column are kept."""
    return df.filter(~in_set(column, values))


def drop_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Drop rows whose text matches; null text does not match and stays."""
    return df.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def keep_finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(is_finite(c))
    return df


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the given (default: all) columns."""
    kinds = dict(df.dtypes)
    columns = list(columns or df.columns)
    # Stated column by column, so that scans can use the null checks (``dropna`` hides them).
    tests = [f"`{c}` IS NOT NULL" for c in columns]
    tests += [f"NOT isnan(`{c}`)" for c in columns if kinds[c] in ("double", "float")]
    return df.filter(" AND ".join(tests))


def period_filter(
    df: DataFrame,
    start: str = K.PERIOD_START,
    end: str = K.PERIOD_END,
    time: str = "datetime",
    hours: int = K.UTC_OFFSET_HOURS,
) -> DataFrame:
    """Half-open window of local dates, stated on the raw UTC column so that scans can use it."""
    kind = "timestamp_ntz" if dict(df.dtypes)[time] == "timestamp_ntz" else "timestamp"
    low, high = (F.lit(str(utc_bound(d, hours))).cast(kind) for d in (start, end))
    return df.filter((F.col(time) >= low) & (F.col(time) < high))


def to_local(df: DataFrame, time: str = "datetime", hours: int = K.UTC_OFFSET_HOURS) -> DataFrame:
    return df.withColumn(time, local_time(time, hours))


def mask_errors(df: DataFrame) -> DataFrame:
    """Void sensor values by logger error code.

    The rules differ in how they treat a missing code: set membership keeps the value, a threshold
    voids it. Moisture is also void in frozen soil, judged by T1 after its own masking.
    """
    code = F.col("error_tomst")
    void = F.lit(None).cast("double")
    out = df.withColumns(
        {
            "T1": F.when(~in_set(code, K.T1_VOID_CODES), F.col("T1")),
            "T2": F.when(~in_set(code, K.T2_VOID_CODES), F.col("T2")),
            "T3": if_else(code > 0, void, F.col("T3")),
            "T4": if_else(F.col("error_T4") > 0, void, F.col("T4")),
            "moist": F.when(~in_set(code, K.MOIST_VOID_CODES), F.col("moist")),
        }
    )
    out = out.withColumn("moist", if_else(F.col("T1") < K.FROZEN_BELOW, void, F.col("moist")))
    return out.drop("moist_count", "arh")


def odd_hour(time: Column | str) -> Column:
    """On the hour, at odd hours: the common two-hour grid of the loggers."""
    t = F.col(time) if isinstance(time, str) else time
    return (F.hour(t) % 2 == 1) & (F.minute(t) == 0)


def thin_hours(df: DataFrame, sensor: str = "T4", time: str = "datetime") -> DataFrame:
    """Void a sensor off the two-hour grid, keeping all rows."""
    return df.withColumn(sensor, F.when(odd_hour(time), F.col(sensor)))


def keep_odd_hours(df: DataFrame, time: str = "datetime") -> DataFrame:
    return df.filter(odd_hour(time))


def apply_overrides(
    df: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str], when: Column | None = None
) -> DataFrame:
    """Replace values by hand-checked ones for the listed keys.

    ``overrides`` has one row per key.
    """
    renamed = overrides.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = compact_join(df, renamed, [key], "left")
    when = F.lit(True) if when is None else when
    return joined.withColumns(
        {c: F.when(when, F.coalesce(F.col(f"_new_{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}
    ).select(*df.columns)


def clean_readings(
    df: DataFrame,
    start: str = K.PERIOD_START,
    end: str = K.PERIOD_END,
    hours: int = K.UTC_OFFSET_HOURS,
) -> DataFrame:
    """Raw readings to cleaned local-time readings: filters, period, masks, thinning of T4."""
    df = period_filter(exclude_sites(df), start, end, hours=hours)
    return thin_hours(mask_errors(to_local(df, hours=hours)))
