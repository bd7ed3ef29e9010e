"""Queries on raw readings: cleaning, gap filling, days, the whole chain to months."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.base import (
    CLEAN_SQL,
    DAY_COLUMNS,
    END,
    FRACTIONS,
    MONTH_STATS,
    START,
    day,
    day_sql,
    fill_sql,
    months_sql,
    query,
    r,
    r_list,
    readings,
    readings_sql,
    rounded,
    stamp,
    stamp_sql,
    table,
)
from sensorframe import constants as K
from sensorframe.functions.labels import collapse_label
from sensorframe.functions.nulls import if_else, round_to
from sensorframe.operators import clean as C
from sensorframe.operators import gaps, reshape, rollup
from sensorframe.plans import preprocess, reports

SENSORS = ["T1", "T2", "T3", "T4", "moist"]


def clean(spark, sf_dir, hourly=False):
    return C.clean_readings(readings(spark, sf_dir, hourly), START, END)


@query(
    "clean_readings",
    f"""WITH {readings_sql(True)}, {CLEAN_SQL}
SELECT id_code, area, site, {stamp_sql('datetime')}, {r_list(SENSORS)}, logger_T4 FROM clean""",
)
def clean_readings(spark, sf_dir):
    return clean(spark, sf_dir, True).select(
        "id_code", "area", "site", stamp("datetime"), *rounded(SENSORS), "logger_T4"
    )


@query(
    "thin_hours",
    f"""WITH {readings_sql(True)} SELECT id_code, {stamp_sql('datetime')},
  {r("CASE WHEN hour(datetime) % 2 = 1 AND minute(datetime) = 0 THEN T4 END", 6)} AS "T4",
  CASE WHEN hour(datetime) % 2 = 1 AND minute(datetime) = 0 THEN 1 ELSE 0 END AS kept FROM readings""",
)
def thin_hours(spark, sf_dir):
    thinned = C.thin_hours(readings(spark, sf_dir, True))
    return thinned.select(
        "id_code", stamp("datetime"), *rounded(["T4"]), C.odd_hour("datetime").cast("int").alias("kept")
    )


def _gap_sql(columns, max_gap, hourly):
    return f"""WITH {readings_sql(hourly)}, {CLEAN_SQL}, {fill_sql('clean', 'filled', columns, max_gap)}
SELECT id_code, {stamp_sql('datetime')}, {r_list(columns)}, logger_T4 FROM filled"""


@query("interpolate_gaps", _gap_sql(K.SOIL_SENSORS, 3, False))
def interpolate_gaps(spark, sf_dir):
    filled = gaps.interpolate_gaps(clean(spark, sf_dir), ["id_code"], "datetime", K.SOIL_SENSORS, 3)
    return filled.select("id_code", stamp("datetime"), *rounded(K.SOIL_SENSORS), "logger_T4")


@query(
    "interpolate_gaps_1",
    f"""WITH {readings_sql(True)}, {CLEAN_SQL},
grid AS (SELECT id_code, area, site, datetime, T4, error_T4, logger_T4 FROM clean
  WHERE hour(datetime) % 2 = 1 AND minute(datetime) = 0),
{fill_sql('grid', 'filled', ['T4'], 1)}
SELECT id_code, {stamp_sql('datetime')}, {r_list(['T4'])}, logger_T4 FROM filled""",
)
def interpolate_gaps_1(spark, sf_dir):
    return preprocess.fill_air(clean(spark, sf_dir, True)).select(
        "id_code", stamp("datetime"), *rounded(["T4"]), "logger_T4"
    )


@query(
    "locf",
    f"""WITH {readings_sql()}, {CLEAN_SQL}
SELECT id_code, {stamp_sql('datetime')}, {', '.join(r(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY id_code ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", 6
    ) + f' AS "{c}"' for c in ['T1', 'T3'])} FROM clean""",
)
def locf(spark, sf_dir):
    carried = gaps.carry_forward(
        clean(spark, sf_dir), ["id_code"], ["datetime"], ["T1", "T3"], F.to_date("datetime")
    )
    return carried.select("id_code", stamp("datetime"), *rounded(["T1", "T3"]))


SOIL_DAYS = ["id_code", "area", "site", "date"]


def _daily_sql(masked: bool) -> str:
    soil = ", ".join(
        f"{r(f'100 * avg(CASE WHEN {s} IS NOT NULL THEN 1.0 ELSE 0.0 END)', 1)} AS {s}_prop, "
        f"avg({s}) AS {s}_mean, min({s}) AS {s}_min, max({s}) AS {s}_max"
        for s in K.SOIL_SENSORS
    )
    air = (
        f"{r('100 * avg(CASE WHEN T4 IS NOT NULL THEN 1.0 ELSE 0.0 END)', 1)} AS T4_prop, "
        "avg(T4) AS T4_mean, min(T4) AS T4_min, max(T4) AS T4_max"
    )
    join = " AND ".join(f"s.{k} IS NOT DISTINCT FROM a.{k}" for k in SOIL_DAYS)
    keys = ", ".join(f"coalesce(s.{k}, a.{k}) AS {k}" for k in SOIL_DAYS)
    bad = {
        "T1": "T1_prop < 0.95 OR coalesce(error_tomst IN (1, 2, 4), false)",
        "T2": "T2_prop < 0.95 OR coalesce(error_tomst IN (1, 2), false)",
        "T3": "T3_prop < 0.95 OR error_tomst > 0",
        "T4": "T4_prop < 0.95 OR error_T4 > 0",
    }
    sql = f"""WITH {readings_sql(True)}, {CLEAN_SQL}, {fill_sql('clean', 'soil', K.SOIL_SENSORS, 3)},
grid AS (SELECT id_code, area, site, datetime, T4, error_T4, logger_T4 FROM clean
  WHERE hour(datetime) % 2 = 1 AND minute(datetime) = 0),
{fill_sql('grid', 'air', ['T4'], 1)},
s AS (SELECT id_code, area, site, date, {soil}, max(error_tomst) AS error_tomst FROM soil GROUP BY ALL),
a AS (SELECT id_code, area, site, date, {air}, max(error_T4) AS error_T4,
  CASE WHEN count(DISTINCT logger_T4) > 1 THEN 'b' ELSE min(logger_T4) END AS logger_T4 FROM air GROUP BY ALL),
daily AS (SELECT {keys}, s.* EXCLUDE (id_code, area, site, date), a.* EXCLUDE (id_code, area, site, date)
  FROM s FULL JOIN a ON {join})"""
    if not masked:
        return sql
    replace = ", ".join(
        f"CASE WHEN {rule} THEN NULL WHEN NOT ({rule}) THEN {s}_{k} END AS {s}_{k}"
        for s, rule in bad.items()
        for k in ("mean", "min", "max")
    )
    return f"{sql}, days AS (SELECT * REPLACE ({replace}) FROM daily)"


PROPS = [f"{s}_prop" for s in SENSORS]
CODES = ["error_tomst", "error_T4"]


@query(
    "daily_rollup",
    f"""{_daily_sql(False)} SELECT id_code, area, site, {day_sql('date')}, {', '.join(PROPS)}, {r_list(DAY_COLUMNS)},
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CODES)}, logger_T4 FROM daily""",
)
def daily_rollup(spark, sf_dir):
    c = clean(spark, sf_dir, True)
    daily = rollup.daily_rollup(preprocess.fill_readings(c), preprocess.fill_air(c))
    return daily.select(
        "id_code", "area", "site", day("date"), *PROPS, *rounded(DAY_COLUMNS),
        *[F.col(x).cast("double").alias(x) for x in CODES], "logger_T4",
    )


@query(
    "daily_masked",
    f"""{_daily_sql(True)} SELECT id_code, area, site, {day_sql('date')}, {r_list(DAY_COLUMNS)}, logger_T4 FROM days""",
)
def daily_masked(spark, sf_dir):
    daily = rollup.published_days(preprocess.days(clean(spark, sf_dir, True)))
    return daily.select("id_code", "area", "site", day("date"), *rounded(DAY_COLUMNS), "logger_T4")


# Users have events on some days of the month only, so months are kept from this coverage on.
MONTH_LIMIT = 0.1


def _upper_sql(source: str, keys: str) -> str:
    picks = ", ".join(
        f"quantile_cont({s}, {p}) AS {s}_{q}"
        for s in K.TEMPERATURES
        for p, q in zip(K.UPPER_PROBABILITIES, K.UPPER_LABELS)
    )
    return f"SELECT {keys}, {picks} FROM {source} GROUP BY {keys}"


def _months_table_sql() -> str:
    upper = _upper_sql("(SELECT *, CAST(month(date) AS INTEGER) AS month FROM soil)", "id_code, month")
    masked = {f"{s}_{k}": s for s in K.TEMPERATURES for k in [*K.STATISTICS, *K.UPPER_LABELS]}
    values = ", ".join(
        f'{r(f"CASE WHEN coalesce(day_frac_{s}, 0) < {MONTH_LIMIT} THEN NULL ELSE {c} END", 6)} AS "{c}"' for c, s in masked.items()
    )
    moist = ", ".join(f'{r(c, 6)} AS "{c}"' for c in MONTH_STATS if c.startswith("moist"))
    fractions = ", ".join(f"{r(f'coalesce({c}, 0)', 6)} AS \"{c[9:]}_prop\"" for c in FRACTIONS)
    return f"""{_daily_sql(True)}, {months_sql()}, q AS ({upper})
SELECT coalesce(m.id_code, q.id_code) AS id_code, m.area, CAST(m.site AS DOUBLE) AS site, CAST(m.year AS DOUBLE) AS year,
  coalesce(m.month, q.month) AS month, {fractions}, logger_T4, {values}, {moist}
FROM months m FULL JOIN q ON m.id_code = q.id_code AND m.month = q.month"""


@query("monthly_table", _months_table_sql())
def monthly_table(spark, sf_dir):
    _, _, m = preprocess.preprocess(readings(spark, sf_dir, True), START, END, MONTH_LIMIT)
    numbers = [x for x, t in m.dtypes if t == "double"]
    return m.select(
        "id_code", "area", *[F.col(x).cast("double").alias(x) for x in ("site", "year")], "month", "logger_T4",
        *rounded(numbers),
    )


@query(
    "daily_full_join",
    f"""WITH {readings_sql(True)},
a AS (SELECT nullif(logger_T4, 'view') AS label, CAST(datetime AS DATE) AS date, avg(CASE WHEN T1 > 40 THEN T1 END) AS T1_mean FROM readings GROUP BY ALL),
b AS (SELECT nullif(logger_T4, 'click') AS label, CAST(datetime AS DATE) AS date, max(CASE WHEN T3 > 60 THEN T4 END) AS T4_max FROM readings GROUP BY ALL)
SELECT coalesce(a.label, b.label) AS label, {day_sql('coalesce(a.date, b.date)')}, {r_list(['T1_mean', 'T4_max'])}
FROM a FULL JOIN b ON a.label IS NOT DISTINCT FROM b.label AND a.date IS NOT DISTINCT FROM b.date""",
)
def daily_full_join(spark, sf_dir):
    # Soil rows without the label view, air rows without click: each side has keys the other lacks.
    rows = readings(spark, sf_dir, True).withColumn("date", F.to_date("datetime"))
    soil, air = (F.nullif(F.col("logger_T4"), F.lit(x)).alias("label") for x in ("view", "click"))
    a = rows.groupBy(soil, "date").agg(F.avg(F.when(F.col("T1") > 40, F.col("T1"))).alias("T1_mean"))
    b = rows.groupBy(air, "date").agg(F.max(F.when(F.col("T3") > 60, F.col("T4"))).alias("T4_max"))
    out = reshape.null_safe_join(a, b, ["label", "date"], "full")
    return out.select("label", day("date"), *rounded(["T1_mean", "T4_max"]))


@query(
    "label_collapse",
    f"""WITH {readings_sql()} SELECT id_code, {day_sql('CAST(datetime AS DATE)')},
  CASE WHEN count(DISTINCT nullif(logger_T4, 'view')) > 1 THEN 'b' ELSE min(nullif(logger_T4, 'view')) END AS logger
FROM readings GROUP BY id_code, CAST(datetime AS DATE)""",
)
def label_collapse(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("logger", F.nullif(F.col("logger_T4"), F.lit("view")))
    out = rows.groupBy("id_code", F.to_date("datetime").alias("date")).agg(collapse_label("logger").alias("logger"))
    return out.select("id_code", day("date"), "logger")


@query(
    "cross_site_sd",
    f"""WITH {readings_sql(True)}, s AS (SELECT area, datetime, {', '.join(f'stddev_samp({c}) AS {c}' for c in K.TEMPERATURES)}
FROM readings GROUP BY area, datetime HAVING stddev_samp(T4) IS NOT NULL),
long AS (FROM s UNPIVOT INCLUDE NULLS (Temperature FOR tsen IN ({', '.join(K.TEMPERATURES)})))
SELECT area, {stamp_sql('datetime')}, tsen, {r('Temperature', 5)} AS "Temperature" FROM long""",
)
def cross_site_sd(spark, sf_dir):
    out = reports.sd_series(readings(spark, sf_dir, True))
    return out.select("area", stamp("datetime"), "tsen", round_to("Temperature", 5).alias("Temperature"))


@query(
    "cell_filter",
    f"""WITH {readings_sql()} SELECT area, CAST(month(datetime) AS INTEGER) AS month, count(*) AS n, {r('avg(T1)', 5)} AS "T1"
FROM readings GROUP BY area, month(datetime)""",
)
def cell_filter(spark, sf_dir):
    # Filters on one area and month, cell after cell, become group keys.
    return readings(spark, sf_dir).groupBy("area", F.month("datetime").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), round_to(F.avg("T1"), 5).alias("T1")
    )


def _with_gaps(spark, sf_dir):
    rows = C.mask_errors(readings(spark, sf_dir))
    nan = F.when(F.col("logger_T4") == "view", F.lit(float("nan"))).otherwise(F.col("T2"))
    return rows.withColumn("T2", nan)


_GAPS_SQL = f"""WITH {readings_sql()}, {CLEAN_SQL.split('clean AS')[0].rstrip().rstrip(',')},
gaps AS (SELECT * REPLACE (CASE WHEN event = 'view' THEN CAST('NaN' AS DOUBLE) ELSE T2 END AS T2,
    CASE WHEN error_tomst IN (1, 2, 4) THEN NULL ELSE T1 END AS T1,
    CASE WHEN error_tomst > 0 THEN NULL WHEN error_tomst <= 0 THEN T3 END AS T3)
  FROM (SELECT *, logger_T4 AS event FROM readings)),
g AS (SELECT * REPLACE (CASE WHEN event <> 'view' AND error_tomst IN (1, 2) THEN NULL ELSE T2 END AS T2) FROM gaps)"""


@query(
    "finite_filter",
    f"""{_GAPS_SQL} SELECT id_code, {stamp_sql('datetime')}, {r_list(['T1', 'T2'])} FROM g WHERE isfinite(T1) AND isfinite(T2)""",
)
def finite_filter(spark, sf_dir):
    return C.keep_finite(_with_gaps(spark, sf_dir), "T1", "T2").select(
        "id_code", stamp("datetime"), *rounded(["T1", "T2"])
    )


@query(
    "regex_exclude",
    f"""WITH {readings_sql()} SELECT id_code, {stamp_sql('datetime')}, label FROM
  (SELECT *, nullif(logger_T4, 'view') AS label FROM readings) WHERE NOT coalesce(regexp_matches(label, '^e|ck$'), false)""",
)
def regex_exclude(spark, sf_dir):
    rows = readings(spark, sf_dir).withColumn("label", F.nullif(F.col("logger_T4"), F.lit("view")))
    return C.drop_matching(rows, "label", "^e|ck$").select("id_code", stamp("datetime"), "label")


@query(
    "complete_cases",
    f"""{_GAPS_SQL} SELECT id_code, {stamp_sql('datetime')}, {r_list(['T1', 'T2', 'T3'])} FROM g
WHERE T1 IS NOT NULL AND T2 IS NOT NULL AND NOT isnan(T2) AND T3 IS NOT NULL AND error_tomst IS NOT NULL""",
)
def complete_cases(spark, sf_dir):
    rows = C.complete_cases(_with_gaps(spark, sf_dir), ["T1", "T2", "T3", "error_tomst"])
    return rows.select("id_code", stamp("datetime"), *rounded(["T1", "T2", "T3"]))


@query(
    "sequential_columns",
    f"""WITH {readings_sql()} SELECT id_code, {stamp_sql('datetime')}, {r('a', 6)} AS a, {r('b', 6)} AS b, {r('c', 6)} AS c FROM
  (SELECT *, CASE WHEN b < 50 THEN b WHEN b >= 50 THEN a - b END AS c FROM
    (SELECT *, abs(a - 100) AS b FROM (SELECT *, CASE WHEN error_tomst > 0 THEN NULL WHEN error_tomst <= 0 THEN T1 * 2 END AS a FROM readings)))""",
)
def sequential_columns(spark, sf_dir):
    rows = readings(spark, sf_dir)
    void = F.lit(None).cast("double")
    rows = rows.withColumn("a", if_else(F.col("error_tomst") > 0, void, F.col("T1") * 2))
    rows = rows.withColumn("b", F.abs(F.col("a") - 100))
    rows = rows.withColumn("c", if_else(F.col("b") < 50, F.col("b"), F.col("a") - F.col("b")))
    return rows.select("id_code", stamp("datetime"), *rounded(["a", "b", "c"]))


@query(
    "across_columns",
    f"""WITH {readings_sql()} SELECT id_code, {stamp_sql('datetime')}, {', '.join(f"{r(f'{c} / 3600', 4)} AS {c}_h" for c in K.TEMPERATURES)},
  {', '.join(f"{r(f'abs({c} - 100)', 2)} AS {c}_d" for c in K.TEMPERATURES)} FROM readings""",
)
def across_columns(spark, sf_dir):
    rows = readings(spark, sf_dir)
    rows = rows.withColumns({f"{c}_h": round_to(F.col(c) / K.KJ_PER_KWH, 4) for c in K.TEMPERATURES})
    rows = rows.withColumns({f"{c}_d": round_to(F.abs(F.col(c) - 100), 2) for c in K.TEMPERATURES})
    return rows.select("id_code", stamp("datetime"), *[f"{c}_{x}" for x in "hd" for c in K.TEMPERATURES])


@query(
    "column_picks",
    f"""{_daily_sql(True)} SELECT id_code, {day_sql('date')}, logger_T4, {r_list([f'T3_{k}' for k in ('mean', 'min', 'max')])},
  {r_list([f'T1_{k}' for k in ('mean', 'min', 'max')])} FROM days""",
)
def column_picks(spark, sf_dir):
    daily = rollup.published_days(preprocess.days(clean(spark, sf_dir, True)))
    kept = reshape.select_cols(daily, regex="^(id_code|date|logger_T4|T[13]_)")
    moved = reshape.relocate(kept, ["T3_mean", "T3_min", "T3_max"], after="logger_T4")
    numbers = [x for x, t in moved.dtypes if t == "double"]
    return moved.select("id_code", day("date"), "logger_T4", *rounded(numbers))


@query(
    "last_n",
    f"""WITH {readings_sql()} SELECT id_code, {stamp_sql('datetime')}, {r_list(['T1'])} FROM
  (SELECT * FROM readings ORDER BY datetime DESC, id_code DESC LIMIT 20)""",
)
def last_n(spark, sf_dir):
    return reshape.last_rows(readings(spark, sf_dir), ["datetime", "id_code"], 20).select("id_code", stamp("datetime"), *rounded(["T1"]))


@query(
    "first_per_group",
    f"""WITH {readings_sql()} SELECT id_code, {stamp_sql('datetime')}, logger_T4, {r_list(['T1'])} FROM
  (SELECT *, row_number() OVER (PARTITION BY id_code ORDER BY datetime) AS rn FROM readings) WHERE rn = 1""",
)
def first_per_group(spark, sf_dir):
    first = reshape.first_per_group(readings(spark, sf_dir), ["id_code"], ["datetime", "T1"])
    return first.select("id_code", stamp("datetime"), "logger_T4", *rounded(["T1"]))


@query(
    "distinct_counts",
    f"""WITH {readings_sql()} SELECT area, count(*) AS n, count(DISTINCT id_code) AS sites,
  count(DISTINCT CAST(datetime AS DATE)) AS days FROM readings GROUP BY area""",
)
def distinct_counts(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("area").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id_code").alias("sites"),
        F.count_distinct(F.to_date("datetime")).alias("days"),
    )


@query(
    "set_filters",
    """SELECT event_type AS label, count(*) AS n FROM events
WHERE NOT coalesce(nullif(event_type, 'view') IN ('error', 'click'), false) GROUP BY 1""",
)
def set_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("label", F.nullif(F.col("event_type"), F.lit("view")))
    kept = C.drop_values(rows, "label", ["error", "click"])
    return kept.groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
