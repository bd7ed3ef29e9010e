"""Weather stations: choice per area, day-of-year normals, comparison with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.labels import rank_of
from sensorframe.functions.nulls import is_finite, strict_mean
from sensorframe.operators.reshape import compact_join


def nearest_stations(
    distances: DataFrame,
    start: str = K.PERIOD_START,
    last: str = K.PERIOD_LAST_DAY,
    areas: Sequence[str] = tuple(K.AREAS),
    position: Column | str = "FMISID",
    one_area: bool = True,
) -> DataFrame:
    """Closest station with data over the whole period, per area.

    ``distances`` has one row per station and area; ``position`` decides between equal distances. A
    station that is closest to several areas keeps the last of them, unless ``one_area`` is false.
    """
    position = F.col(position) if isinstance(position, str) else position
    usable = distances.filter(
        (F.col("first_date") <= F.lit(start).cast("date"))
        & (F.col("last_date") >= F.lit(last).cast("date"))
        & F.col("target_area").isin(*areas)
        & F.col("distance").isNotNull()
    )
    chosen = usable.groupBy(F.col("target_area").alias("area")).agg(
        F.min_by("FMISID", F.struct("distance", position)).alias("FMISID")
    )
    if not one_area:
        return chosen.select("FMISID", "area")
    return chosen.groupBy("FMISID").agg(F.max_by("area", rank_of("area", areas)).alias("area"))


def mapped_only(weather: DataFrame, station_areas: DataFrame) -> DataFrame:
    """Weather rows of chosen stations, with their area."""
    return compact_join(weather.drop("area"), station_areas, ["FMISID"])


def day_normals(
    weather: DataFrame, start: str = K.NORMALS_START, end: str = K.NORMALS_END, keys: Sequence[str] = ("FMISID", "area")
) -> DataFrame:
    """Mean temperature per station and day of year over the normals window, both ends included."""
    return (
        weather.filter(F.col("time").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .filter(is_finite("tday"))
        .groupBy(*keys, F.dayofyear("time").alias("yday"))
        .agg(F.count(F.lit(1)).alias("n_days"), F.avg("tday").alias("Tavg30"))
    )


def sparse_groups(counts: DataFrame, column: str, fewer_than: int) -> DataFrame:
    """Groups below a size, smallest first."""
    return counts.filter(F.col(column) < fewer_than).orderBy(column)


def study_means(weather: DataFrame, keys: Sequence[str] = ("FMISID", "area")) -> DataFrame:
    """Days and mean temperature per station; the mean is missing when a day is."""
    return weather.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), strict_mean("tday").alias("Tavg"))


def merge_areas(
    df: DataFrame, area: str = K.MERGED_AREA, label: str = K.MERGED_LABEL, dropped: str = K.DROPPED_AREA
) -> DataFrame:
    """Show two areas that share a station as one."""
    renamed = F.when(F.col("area") == area, F.lit(label)).otherwise(F.col("area"))
    return df.withColumn("area", renamed).filter(F.col("area") != dropped)


def against_normals(weather: DataFrame, normals: DataFrame) -> DataFrame:
    """Daily weather with the normal of its station, area and day of year."""
    keys = ["FMISID", "area", "yday"]
    return compact_join(weather.withColumn("yday", F.dayofyear("time")), normals.select(*keys, "Tavg30"), keys, "left")
