"""Query registry, table access, and the views of the test tables that stand in for sensor data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.nulls import round_to

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The test events fall into one month; the study period around them.
START, END = "2023-11-01", "2024-11-01"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: str, digits: int) -> str:
    """SQL text that rounds as ``round_to`` does."""
    return f"(floor(({x}) * 1e{digits} + 0.5 + abs(({x}) * 1e{digits}) * 1e-11) / 1e{digits})"


def rounded(columns, digits: int = 6) -> list[Column]:
    return [round_to(c, digits).alias(c) for c in columns]


def r_list(columns, digits: int = 6) -> str:
    return ", ".join(f'{r(c, digits)} AS "{c}"' for c in columns)


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


def day(c: Column | str, name: str = "date") -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(name)


def day_sql(c: str, name: str = "date") -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name}"


def area_of(c: Column | str) -> Column:
    """One of the seven area names for any whole number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(F.array(*[F.lit(a) for a in K.AREAS]), (c % 7 + 1).cast("int"))


def area_sql(c: str) -> str:
    return "CASE " + c + " % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(K.AREAS)) + " END"


def readings(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    """Events as logger readings of one series per user; ``hourly`` moves them to the full hour."""
    e = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    number = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    code = F.when(kind == "error", 1).when(kind == "signup", 2).when(kind == "purchase", 4).when(kind == "click", 0)
    return e.select(
        F.col("user_id").cast("string").alias("id_code"),
        area_of("user_id").alias("area"),
        F.col("user_id").cast("int").alias("site"),
        (F.date_trunc("hour", "ts").cast("timestamp_ntz") if hourly else F.col("ts")).alias("datetime"),
        value.alias("T1"),
        (value * 0.9).alias("T2"),
        number.alias("T3"),
        (value + number).alias("T4"),
        (value / 10).alias("moist"),
        code.alias("error_tomst"),
        F.when(kind == "error", 1).otherwise(0).alias("error_T4"),
        kind.alias("logger_T4"),
    )


def readings_sql(hourly: bool = False) -> str:
    return f"""readings AS (
  SELECT CAST(user_id AS VARCHAR) AS id_code, {area_sql('user_id')} AS area, CAST(user_id AS INTEGER) AS site,
    {"date_trunc('hour', ts)" if hourly else 'ts'} AS datetime, value AS T1, value * CAST(0.9 AS DOUBLE) AS T2,
    CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS T3,
    value + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS T4, value / 10 AS moist,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 4 WHEN 'click' THEN 0 END AS error_tomst,
    CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS error_T4, event_type AS logger_T4
  FROM events)"""


CLEAN_SQL = f"""kept AS (
  SELECT * REPLACE (datetime + INTERVAL 2 HOUR AS datetime,
      CASE WHEN error_tomst IN (1, 2, 4) THEN NULL ELSE T1 END AS T1,
      CASE WHEN error_tomst IN (1, 2) THEN NULL ELSE T2 END AS T2,
      CASE WHEN error_tomst > 0 THEN NULL WHEN error_tomst <= 0 THEN T3 END AS T3,
      CASE WHEN error_T4 > 0 THEN NULL WHEN error_T4 <= 0 THEN T4 END AS T4,
      CASE WHEN error_tomst IN (1, 2) THEN NULL ELSE moist END AS moist)
  FROM readings
  WHERE NOT (area = 'PIS' AND site >= 100) AND area NOT IN ('RAR', 'SAA', 'RAS')
    AND CAST(datetime + INTERVAL 2 HOUR AS DATE) >= DATE '{START}' AND CAST(datetime + INTERVAL 2 HOUR AS DATE) < DATE '{END}'),
clean AS (
  SELECT * REPLACE (CASE WHEN T1 < 1 THEN NULL WHEN T1 >= 1 THEN moist END AS moist,
      CASE WHEN hour(datetime) % 2 = 0 OR minute(datetime) <> 0 THEN NULL ELSE T4 END AS T4)
  FROM kept)"""


def fill_sql(source: str, target: str, columns, max_gap: int) -> str:
    """CTEs that fill gaps of each column of ``source``: points, neighbours, line, join back."""
    parts = []
    for c in columns:
        w = "PARTITION BY id_code ORDER BY rn"
        parts.append(f"""{target}_{c} AS (
  SELECT id_code, datetime, CASE WHEN v IS NOT NULL THEN v WHEN nr - pr - 1 <= {max_gap}
      THEN pv + (nv - pv) * (CAST(epoch_us(datetime) - pt AS DOUBLE) / CAST(nt - pt AS DOUBLE)) END AS v
  FROM (SELECT id_code, datetime, v,
      last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr,
      last_value(CASE WHEN v IS NOT NULL THEN epoch_us(datetime) END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
      last_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
      first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr,
      first_value(CASE WHEN v IS NOT NULL THEN epoch_us(datetime) END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
      first_value(v IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
    FROM (SELECT id_code, datetime, avg({c}) AS v, row_number() OVER (PARTITION BY id_code ORDER BY datetime) AS rn
          FROM {source} GROUP BY id_code, datetime)))""")
    joins = " ".join(f"JOIN {target}_{c} USING (id_code, datetime)" for c in columns)
    new = ", ".join(f"coalesce({c}, {target}_{c}.v) AS {c}" for c in columns)
    parts.append(
        f"""{target} AS (SELECT s.* EXCLUDE ({', '.join(columns)}), {new}, CAST(datetime AS DATE) AS date
  FROM {source} s {joins})"""
    )
    return ",\n".join(parts)


STATS = ("mean", "min", "max")
DAY_COLUMNS = [f"{s}_{k}" for s in K.TEMPERATURES + ["moist"] for k in STATS]


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily sensor values of one series per nation; T2 to T4 miss days by order status."""
    o = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    price = F.col("o_totalprice") / 1000
    sensors = {
        "T1": price,
        "T2": F.when(F.col("o_orderstatus") != "P", price),
        "T3": F.when(F.col("o_orderstatus") == "F", price),
        "T4": F.when(F.col("o_orderstatus") != "F", price),
        "moist": F.when(F.col("o_orderpriority") != "5-LOW", price / 10),
    }
    aggs = []
    for s, v in sensors.items():
        aggs += [F.avg(v).alias(f"{s}_mean"), F.min(v).alias(f"{s}_min"), F.max(v).alias(f"{s}_max")]
    return o.groupBy(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("id_code"),
        area_of("c_nationkey").alias("area"),
        F.col("c_nationkey").alias("site"),
        F.col("o_orderdate").cast("date").alias("date"),
    ).agg(*aggs, F.min("o_orderstatus").alias("logger_T4"))


def order_days_sql() -> str:
    price = "o_totalprice / 1000"
    sensors = {
        "T1": price,
        "T2": f"CASE WHEN o_orderstatus <> 'P' THEN {price} END",
        "T3": f"CASE WHEN o_orderstatus = 'F' THEN {price} END",
        "T4": f"CASE WHEN o_orderstatus <> 'F' THEN {price} END",
        "moist": f"CASE WHEN o_orderpriority <> '5-LOW' THEN {price} / 10 END",
    }
    aggs = ", ".join(f"avg({v}) AS {s}_mean, min({v}) AS {s}_min, max({v}) AS {s}_max" for s, v in sensors.items())
    return f"""days AS (
  SELECT 'N' || c_nationkey AS id_code, {area_sql('c_nationkey')} AS area, c_nationkey AS site,
    CAST(o_orderdate AS DATE) AS date, {aggs}, min(o_orderstatus) AS logger_T4
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_nationkey, CAST(o_orderdate AS DATE))"""


MONTH_STATS = [f"{s}_{k}" for s in K.TEMPERATURES for k in K.STATISTICS] + [
    f"moist_{k}" for k in ("sd", "cv", "med", "mean", "absmax", "absmin")
]
FRACTIONS = [f"day_frac_{s}" for s in K.TEMPERATURES + ["moist"]]


def months_sql(days: str = "days") -> str:
    """CTE ``months``: monthly statistics and coverage of daily values."""
    parts = []
    for s in K.TEMPERATURES:
        f = f"FILTER ({s}_mean IS NOT NULL)"
        parts.append(
            f"count({s}_mean) / max(ml) AS day_frac_{s}, {r(f'avg({s}_mean) {f}', 2)} AS {s}_mean, "
            f"{r(f'max({s}_max) {f}', 2)} AS {s}_absmax, {r(f'min({s}_min) {f}', 2)} AS {s}_absmin, "
            f"{r(f'avg({s}_max) {f}', 2)} AS {s}_meanmax, {r(f'avg({s}_min) {f}', 2)} AS {s}_meanmin"
        )
    f = "FILTER (moist_mean IS NOT NULL)"
    parts.append(
        f"count(moist_mean) / max(ml) AS day_frac_moist, {r('stddev_samp(moist_mean)', 2)} AS moist_sd, "
        f"{r('stddev_samp(moist_mean) / avg(moist_mean)', 2)} AS moist_cv, {r('median(moist_mean)', 1)} AS moist_med, "
        f"{r('avg(moist_mean)', 1)} AS moist_mean, {r(f'max(moist_max) {f}', 1)} AS moist_absmax, "
        f"{r(f'min(moist_min) {f}', 1)} AS moist_absmin"
    )
    logger = "logger_T4) FILTER (T4_mean IS NOT NULL)"
    any_day = " OR ".join(f"{s}_mean IS NOT NULL" for s in K.TEMPERATURES + ["moist"])
    return f"""months AS (
  SELECT id_code, area, site, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
    {', '.join(parts)},
    CASE WHEN count(DISTINCT {logger} > 1 THEN 'b' ELSE min({logger} END AS logger_T4
  FROM (SELECT *, CAST(day(last_day(date)) AS DOUBLE) AS ml FROM {days}) WHERE {any_day}
  GROUP BY id_code, area, site, year(date), month(date))"""
