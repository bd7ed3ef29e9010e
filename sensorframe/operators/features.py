"""Covariates of the monthly models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.dates import month_sequence
from sensorframe.functions.labels import month_from_name
from sensorframe.functions.nulls import if_else


def monthly_radiation(sites: DataFrame) -> DataFrame:
    """One row per site and month from the twelve radiation columns."""
    columns = [c for c in sites.columns if c.startswith("pisr_m") and c.endswith("_50m")]
    long = sites.select("id_code", *columns).unpivot(["id_code"], columns, "name", "pisr")
    return long.select("id_code", month_from_name("name").alias("month"), "pisr")


def site_covariates(sites: DataFrame, predictors: Sequence[str] = tuple(K.PREDICTORS)) -> DataFrame:
    """Altitude in hundreds of metres, gap shares turned into cover, and only the model predictors kept."""
    out = sites.withColumn("altitude", F.col("altitude") / 100)
    gaps = [c for c in sites.columns if c.startswith("pgaps")]
    if gaps:
        out = out.withColumns({c: F.abs(F.col(c) - 100) for c in gaps})
    return out.select("id_code", *[c for c in out.columns if c in predictors])


def snow_windows(snow: DataFrame, hydro_year: int = K.SNOW_YEAR) -> DataFrame:
    """First and last snow date per area in one hydrological year."""
    return (
        snow.filter(F.col("hydro_year") == hydro_year)
        .groupBy("area")
        .agg(F.min("first_snow_date").alias("first_snow_date"), F.max("last_snow_date").alias("last_snow_date"))
    )


def snowy_months(windows: DataFrame) -> DataFrame:
    """Months with snow per area. A last month that is not reached by whole steps is left out."""
    return windows.select("area", month_sequence("first_snow_date", "last_snow_date").alias("snowy"))


def clean_moisture(moisture: DataFrame, limit: float = K.MOISTURE_COVERAGE) -> DataFrame:
    """Void the monthly median where too few days back it."""
    void = F.lit(None).cast("double")
    return moisture.withColumn("moist_med", if_else(F.col("moist_prop") < limit, void, F.col("moist_med")))


def eligible(
    area: Column | str,
    month: Column | str,
    snowy: Column | str,
    predictors: Sequence[str] = tuple(K.PREDICTORS),
) -> Column:
    """Array of booleans, one per predictor: may the models of this area and month use it?"""
    a, m, s = (F.col(c) if isinstance(c, str) else c for c in (area, month, snowy))
    snow_lies = F.coalesce(F.array_contains(s, m.cast("int")), F.lit(False))
    rules = {
        "pisr": ~m.isin(*K.NO_RADIATION_MONTHS),
        "snow": snow_lies & ~a.isin(*K.NO_SNOW_AREAS),
        "altitude": ~a.isin(*K.NO_ALTITUDE_AREAS),
        "water": ~a.isin(*K.NO_WATER_AREAS),
    }

    def rule(p: str) -> Column:
        return next((r for name, r in rules.items() if name in p), F.lit(True))

    return F.array(*[F.coalesce(rule(p), F.lit(True)) for p in predictors])


def model_table(
    monthly: DataFrame,
    radiation: DataFrame,
    moisture: DataFrame,
    snow: DataFrame,
    covariates: DataFrame,
    responses: Sequence[str],
) -> DataFrame:
    """Monthly responses with all covariates: one row per site and month, missing ones kept.

    Each covariate table has one row per its own key.
    """
    return (
        monthly.select("id_code", "area", "year", "month", *responses)
        .join(radiation, ["id_code", "month"], "left")
        .join(moisture, ["id_code", "area", "year", "month"], "left")
        .join(snow, ["id_code", "area"], "left")
        .join(covariates, "id_code", "left")
    )
