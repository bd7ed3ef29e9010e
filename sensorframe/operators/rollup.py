"""Readings to days, days to months. One grouped pass each, with partial aggregation before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.labels import SEVERAL, collapse_label
from sensorframe.functions.nulls import (
    finite_or_null,
    finite_or_zero,
    if_else,
    in_set,
    is_finite,
    nan_to_null,
    round_to,
)
from sensorframe.operators.order_stats import exact_quantiles, wide_quantiles
from sensorframe.operators.reshape import compact_join
from sensorframe.session import stored

SERIES = ["id_code", "area", "site"]


def daily_rollup(soil: DataFrame, air: DataFrame) -> DataFrame:
    """Days of the soil sensors and days of T4, side by side.

    ``soil`` holds gap-filled T1, T2, T3 and moist, ``air`` gap-filled T4 on the thinned grid. A day
    found in only one of them is kept. Stacking both before the grouped pass gives what a null-safe full
    join of two rollups would. Labels are numbered, in any order, before the pass and looked up after it, so that all
    running values are numbers and stay in one hash aggregate.
    """
    base = [*SERIES, "date"]
    shared = [*base, *K.SOIL_SENSORS, "error_tomst"]
    labels = air.select("logger_T4").dropna().distinct()
    labels = stored(labels.withColumn("_label", F.monotonically_increasing_id()))
    air = compact_join(air, labels, ["logger_T4"], "left")
    stacked = soil.select(*shared, F.lit(True).alias("_soil")).unionByName(
        air.select(*base, "T4", "error_T4", "_label", F.lit(False).alias("_soil")), allowMissingColumns=True
    )
    sensors = [*K.SOIL_SENSORS, "T4"]
    aggs: list[Column] = []
    for s in sensors:
        # Rows of the other kind have no value of this sensor, so only the share needs to know the kind.
        rows = F.count_if(~F.col("_soil") if s == "T4" else F.col("_soil"))
        x = F.expr(f"CASE WHEN NOT isnan({s}) THEN {s} END")
        aggs += [
            round_to(F.try_divide(100 * F.count_if(is_finite(s)), rows), 1).alias(f"{s}_prop"),
            finite_or_null(F.try_divide(F.sum(x), F.count(x))).alias(f"{s}_mean"),
            finite_or_null(F.min(x)).alias(f"{s}_min"),
            finite_or_null(F.max(x)).alias(f"{s}_max"),
        ]
    aggs += [F.max(c).alias(c) for c in ("error_tomst", "error_T4")]
    days = stacked.groupBy(*base).agg(*aggs, F.min("_label").alias("_label"), F.max("_label").alias("_other"))
    days = compact_join(days, labels, ["_label"], "left")
    label = F.when(F.col("_label") == F.col("_other"), F.col("logger_T4")).when(F.col("_label") != F.col("_other"), F.lit(SEVERAL))
    return days.withColumn("logger_T4", label).drop("_label", "_other")


def mask_days(daily: DataFrame, limit: float = K.DAILY_COVERAGE_PERCENT) -> DataFrame:
    """Void daily temperatures with too few readings or a bad worst code. Moisture is never voided.

    ``limit`` is compared with the percentage share; 95 is the likely intent behind the default.
    """
    code = F.col("error_tomst")
    bad = {
        "T1": (F.col("T1_prop") < limit) | in_set(code, K.T1_VOID_CODES),
        "T2": (F.col("T2_prop") < limit) | in_set(code, K.T2_VOID_CODES),
        "T3": (F.col("T3_prop") < limit) | (code > 0),
        "T4": (F.col("T4_prop") < limit) | (F.col("error_T4") > 0),
    }
    void = F.lit(None).cast("double")
    return daily.withColumns(
        {f"{s}_{k}": if_else(rule, void, F.col(f"{s}_{k}")) for s, rule in bad.items() for k in ("mean", "min", "max")}
    )


def published_days(daily: DataFrame) -> DataFrame:
    """Masked days in their published column order."""
    stats = [f"{s}_{k}" for s in K.TEMPERATURES + ["moist"] for k in ("mean", "min", "max")]
    return daily.select(*SERIES, "date", "logger_T4", *stats)


def days_in_month(calendar: DataFrame) -> DataFrame:
    """Days per calendar month, from one row per day."""
    return calendar.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("ndaysmax")
    )


def month_length(year: Column | str, month: Column | str) -> Column:
    y, m = (F.col(c) if isinstance(c, str) else c for c in (year, month))
    return F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))


def temperature_months(sensor: str) -> list[Column]:
    """Monthly statistics of one temperature sensor over its days with a finite mean."""
    here = is_finite(f"{sensor}_mean")

    def over(k: str) -> Column:
        return F.when(here, nan_to_null(F.col(f"{sensor}_{k}")))

    stats = {
        "mean": F.avg(over("mean")),
        "absmax": F.max(over("max")),
        "absmin": F.min(over("min")),
        "meanmax": F.avg(over("max")),
        "meanmin": F.avg(over("min")),
    }
    return [round_to(v, 2).alias(f"{sensor}_{k}") for k, v in stats.items()]


def moisture_months() -> list[Column]:
    """Monthly moisture statistics. The median is of the days of a month, at most 31 values."""
    here = is_finite("moist_mean")
    mean = F.when(here, F.col("moist_mean"))
    sd, avg = F.stddev_samp(mean), F.avg(mean)
    return [
        round_to(sd, 2).alias("moist_sd"),
        round_to(F.try_divide(sd, avg), 2).alias("moist_cv"),
        round_to(F.median(mean), 1).alias("moist_med"),
        round_to(avg, 1).alias("moist_mean"),
        round_to(F.max(F.when(here, nan_to_null(F.col("moist_max")))), 1).alias("moist_absmax"),
        round_to(F.min(F.when(here, nan_to_null(F.col("moist_min")))), 1).alias("moist_absmin"),
    ]


MONTH_KEYS = [*SERIES, "year", "month"]


def monthly_stats(daily: DataFrame, sensors: Sequence[str] = tuple(K.TEMPERATURES), moisture: bool = True) -> DataFrame:
    """Monthly statistics and coverage of all sensors in one grouped pass.

    A sensor uses only its days with a finite mean; a month without any such day of any sensor is
    left out, as it would be missing from every one of the per-sensor tables.
    """
    names = [*sensors, *(["moist"] if moisture else [])]
    days = daily.withColumns({"year": F.year("date"), "month": F.month("date")})
    used = F.lit(False)
    for s in names:
        used = used | is_finite(f"{s}_mean")
    days = days.filter(used)
    length = month_length("year", "month")
    aggs = [
        finite_or_zero(F.count_if(is_finite(f"{s}_mean")) / F.max(length)).alias(f"day_frac_{s}") for s in names
    ]
    for s in sensors:
        aggs += temperature_months(s)
    if moisture:
        aggs += moisture_months()
    if "T4" in sensors and "logger_T4" in daily.columns:
        aggs.append(collapse_label(F.when(is_finite("T4_mean"), F.col("logger_T4"))).alias("logger_T4"))
    return days.groupBy(*MONTH_KEYS).agg(*aggs)


def mask_months(monthly: DataFrame, limit: float = K.MONTHLY_COVERAGE, sensors=tuple(K.TEMPERATURES)) -> DataFrame:
    """Void all monthly values of a temperature sensor, quantiles included, below a day coverage."""
    void = F.lit(None).cast("double")
    return monthly.withColumns(
        {
            c: if_else(F.col(f"day_frac_{s}") < limit, void, F.col(c))
            for s in sensors
            for c in monthly.columns
            if c.startswith(f"{s}_")
        }
    )


def upper_quantiles(readings: DataFrame, by_year: bool = False) -> DataFrame:
    """Upper quantiles of sub-daily readings per series and month, wide.

    The key has no year by default, which is safe for one study year only.
    """
    keys = ["id_code", "year", "month"] if by_year else ["id_code", "month"]
    df = readings.withColumns({"year": F.year("date"), "month": F.month("date")})
    return wide_quantiles(df, keys, K.TEMPERATURES, K.UPPER_PROBABILITIES, K.UPPER_LABELS)


def quartiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Three rows per group, labelled by ``p``."""
    probabilities = [0.25, 0.5, 0.75]
    q = exact_quantiles(df, keys, columns, probabilities)
    long = q.select(*keys, "name", F.posexplode("q").alias("_i", "value"))
    p = F.element_at(F.array(*[F.lit(x) for x in probabilities]), F.col("_i") + 1)
    return long.groupBy(*keys, p.alias("p")).agg(
        *[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns]
    )


def months_with_quantiles(monthly: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Full join on series and month, and on the year if the quantiles have it.

    A month with readings but no valid day has quantiles only.
    """
    keys = ["id_code", *(["year"] if "year" in quantiles.columns else []), "month"]
    key = F.struct("id_code", *[F.col(k).cast("int").alias(k) for k in keys[1:]])
    left, right = monthly.withColumn("_k", key), quantiles.withColumn("_k", key)
    joined = left.drop("id_code", "month", *(["year"] if "year" in keys else [])).join(right.drop(*keys), "_k", "full")
    if "year" in keys:
        joined = joined.withColumn("year", F.col("_k.year"))
    fractions = [c for c in monthly.columns if c.startswith("day_frac_")]
    numbers = [
        c for c, t in joined.dtypes if t == "double" and c not in fractions and c.split("_")[0] in K.TEMPERATURES + ["moist"]
    ]
    joined = joined.withColumns(
        {c: finite_or_zero(c) for c in fractions} | {c: F.when(is_finite(c), F.col(c)) for c in numbers}
    )
    return joined.select("_k.id_code", "area", "site", "year", "_k.month", *[c for c in joined.columns if c not in (
        "_k", "area", "site", "year")])


def published_months(monthly: DataFrame) -> DataFrame:
    """Masked months in their published column names and order."""
    names = K.TEMPERATURES + ["moist"]
    stats = [f"{s}_{k}" for s in K.TEMPERATURES for k in K.STATISTICS]
    moist = [f"moist_{k}" for k in ("sd", "cv", "med", "mean", "absmax", "absmin")]
    upper = [f"{s}_{q}" for s in K.TEMPERATURES for q in K.UPPER_LABELS]
    return monthly.select(
        *MONTH_KEYS, *[F.col(f"day_frac_{s}").alias(f"{s}_prop") for s in names], "logger_T4", *stats, *moist, *upper
    )


def p95_as_absmax(monthly: DataFrame) -> DataFrame:
    """Let the 95 % quantile stand in for the absolute maximum and drop the other quantiles.

    From here on ``absmax`` of a temperature means its 95 % quantile.
    """
    out = monthly.drop(*[c for c in monthly.columns if c.endswith("absmax")])
    out = out.withColumnsRenamed({f"{s}_95": f"{s}_absmax" for s in K.TEMPERATURES})
    return out.drop(*[f"{s}_{q}" for s in K.TEMPERATURES for q in K.UPPER_LABELS if q != "95"])


def cross_site_sd(readings: DataFrame, keys: Sequence[str] = ("area", "datetime")) -> DataFrame:
    """Spread of each temperature across sites at one time; times without a T4 spread are left out."""
    return (
        readings.groupBy(*keys)
        .agg(*[F.stddev_samp(s).alias(s) for s in K.TEMPERATURES])
        .filter(F.col("T4").isNotNull())
    )
