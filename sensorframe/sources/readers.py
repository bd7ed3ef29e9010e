"""Readers. Every path is a parameter; formats are csv (header, ``NA`` and empty are null) or parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe import constants as K
from sensorframe.functions.nulls import nan_to_null
from sensorframe.sources import schemas


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "csv") -> DataFrame:
    """Read a table with a fixed schema; NaN in double columns becomes null.

    A table published on the web is staged to shared storage first and read from there, so that
    executors never depend on a remote site.
    """
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv needs an explicit schema")
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("nullValue", "NA")
            .option("encoding", "UTF-8")
            .csv(path)
        )
    else:
        df = spark.read.format(fmt).load(path)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in doubles}) if doubles else df


DAMAGED = "_damaged_line"


def read_checked(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The good rows of a csv table, and its damaged lines (``line, file``).

    A line is damaged if it has too few or too many cells, or one that is not of its column's type. Files are split by lines
    and parsed in parallel whatever their size. A line that repeats the column names, as a header does, is
    neither, and empty lines are not looked at.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter(F.trim("value") != "")
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    if header:
        lines = lines.filter(F.replace("value", F.lit('"')) != F.lit(",".join(names)))
    options = {"nullValue": "NA", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED}
    rows = lines.withColumn("row", F.from_csv("value", f"{schema}, {DAMAGED} string", options))
    damaged = F.col("row").isNull() | F.col(f"row.{DAMAGED}").isNotNull()
    good = rows.filter(~damaged).select(*[F.col(f"row.{n}").alias(n) for n in names])
    doubles = [f.name for f in good.schema.fields if isinstance(f.dataType, T.DoubleType)]
    good = good.withColumns({c: nan_to_null(F.col(c)) for c in doubles}) if doubles else good
    return good, rows.filter(damaged).select(F.col("value").alias("line"), "file")


def read_partition(spark: SparkSession, path: str, schema: str, **values) -> DataFrame:
    """The rows of a table written by ``partition_by`` whose partition columns have the given values; no other folder is read."""
    rows = spark.read.schema(schema).parquet(path)
    for column, value in values.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def read_readings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.READINGS, fmt)


def read_site_variables(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.SITE_VARIABLES, fmt)


def read_snow(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.SNOW, fmt)


def read_moisture(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.MOISTURE, fmt)


def read_monthly(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.MONTHLY, fmt)


def read_weather(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.WEATHER_DAILY, fmt)


def read_normals(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.NORMALS, fmt)


def read_stations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.STATIONS, fmt)


def station_distances(stations: DataFrame, areas: list[str] | None = None) -> DataFrame:
    """One row per station and area, from the wide distance columns."""
    areas = areas or schemas.STATION_DISTANCES
    return stations.select("FMISID", "first_date", "last_date", *areas).unpivot(
        ["FMISID", "first_date", "last_date"], areas, "target_area", "distance"
    )


def calendar(spark: SparkSession, start: str = K.CALENDAR_START, end: str = K.CALENDAR_END) -> DataFrame:
    """One row per day, both ends included; the study's calendar by default."""
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("INTERVAL '1' DAY"))
    return spark.range(1).select(F.explode(days).alias("date"))


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed values."""
    return spark.createDataFrame(rows, schema)
