"""Raw readings to cleaned readings, days and months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.operators.clean import clean_readings, keep_odd_hours
from sensorframe.operators.gaps import interpolate_gaps
from sensorframe.operators.rollup import (
    daily_rollup,
    mask_days,
    mask_months,
    monthly_stats,
    months_with_quantiles,
    published_days,
    published_months,
    upper_quantiles,
)
from sensorframe.session import stored


# Columns that only the daily table of T4 needs.
AIR = ["error_T4", "logger_T4"]


def fill_readings(clean: DataFrame, sensors=tuple(K.SOIL_SENSORS)) -> DataFrame:
    """Cleaned readings with their local date and short gaps of the soil sensors filled."""
    return interpolate_gaps(clean, ["id_code"], "datetime", sensors, K.MAX_GAP).withColumn("date", F.to_date("datetime"))


def fill_air(clean: DataFrame) -> DataFrame:
    """The two-hour grid of T4 with single gaps filled."""
    grid = keep_odd_hours(clean).select("id_code", "area", "site", "datetime", "T4", "error_T4", "logger_T4")
    return interpolate_gaps(grid, ["id_code"], "datetime", ["T4"], K.MAX_GAP_T4).withColumn("date", F.to_date("datetime"))


def days(clean: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """Cleaned readings to masked daily statistics. ``filled`` has them with the soil gaps filled, if that is at hand."""
    if filled is None:
        clean = stored(clean)
        filled = fill_readings(clean.drop("T4", *AIR))
    return mask_days(daily_rollup(filled, fill_air(clean)))


def months(filled: DataFrame, daily: DataFrame, limit: float = K.MONTHLY_COVERAGE, by_year: bool = False) -> DataFrame:
    """Masked daily statistics, with upper quantiles of the filled readings, to the monthly table."""
    joined = months_with_quantiles(monthly_stats(daily), upper_quantiles(filled, by_year))
    return published_months(mask_months(joined, limit))


def preprocess(
    readings: DataFrame,
    start: str = K.PERIOD_START,
    end: str = K.PERIOD_END,
    limit: float = K.MONTHLY_COVERAGE,
    by_year: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cleaned readings, days and months as three tables.

    ``by_year`` keys the quantiles by the year as well, which a period of more than one year needs.
    The cleaned readings and the days are stored, and so is what the gaps are filled from: both tables build on it.
    """
    clean = stored(clean_readings(readings, start, end))
    filled = fill_readings(clean.drop(*AIR))
    daily = stored(days(clean, filled))
    return clean.drop("error_tomst", "error_T4"), published_days(daily), months(filled, daily, limit, by_year)
