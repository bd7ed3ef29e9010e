"""Queries on orders as daily values: months, coverage, quantiles, grids, dates, stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.base import (
    FRACTIONS,
    MONTH_STATS,
    area_of,
    area_sql,
    day,
    day_sql,
    months_sql,
    order_days,
    order_days_sql,
    query,
    r,
    r_list,
    rounded,
    table,
)
from sensorframe import constants as K
from sensorframe.functions import dates, labels
from sensorframe.operators import clean as C
from sensorframe.operators import features, order_stats, reshape, rollup, stations
from sensorframe.plans import reports
from sensorframe.sources.readers import constant_table

KEYS = ["id_code", "area", "site", "year", "month"]
TEMPERATURE_STATS = [c for c in MONTH_STATS if not c.startswith("moist")]
MOISTURE_STATS = [c for c in MONTH_STATS if c.startswith("moist")]
MONTHS = f"WITH {order_days_sql()}, {months_sql()}"
# Orders cover a part of the days of a month only.
LIMIT = 0.25


def _months(spark, sf_dir, **kwargs):
    return rollup.monthly_stats(order_days(spark, sf_dir), **kwargs)


@query(
    "monthly_rollup",
    f"{MONTHS} SELECT {', '.join(KEYS)}, logger_T4, {r_list(TEMPERATURE_STATS)} FROM months "
    f"WHERE {' OR '.join(f'{s}_mean IS NOT NULL' for s in K.TEMPERATURES)}",
)
def monthly_rollup(spark, sf_dir):
    return _months(spark, sf_dir, moisture=False).select(*KEYS, "logger_T4", *rounded(TEMPERATURE_STATS))


@query("coverage", f"{MONTHS} SELECT {', '.join(KEYS)}, {r_list(FRACTIONS)} FROM months")
def coverage(spark, sf_dir):
    return _months(spark, sf_dir).select(*KEYS, *rounded(FRACTIONS))


@query("moist_stats", f"{MONTHS} SELECT {', '.join(KEYS)}, {r_list(MOISTURE_STATS)} FROM months WHERE moist_mean IS NOT NULL")
def moist_stats(spark, sf_dir):
    m = _months(spark, sf_dir, sensors=())
    return m.select(*KEYS, *rounded(MOISTURE_STATS))


@query(
    "monthly_masked",
    f"{MONTHS} SELECT {', '.join(KEYS)}, "
    + ", ".join(
        f'{r(f"CASE WHEN day_frac_{c[:2]} < {LIMIT} THEN NULL ELSE {c} END", 6)} AS "{c}"' for c in TEMPERATURE_STATS
    )
    + f", {r_list(MOISTURE_STATS)} FROM months",
)
def monthly_masked(spark, sf_dir):
    return rollup.mask_months(_months(spark, sf_dir), LIMIT).select(*KEYS, *rounded(MONTH_STATS))


UPPER = [f"{s}_{q}" for s in K.TEMPERATURES for q in K.UPPER_LABELS]


def _with_prices(spark, sf_dir):
    d = order_days(spark, sf_dir)
    return d.select("id_code", "date", *[F.col(f"{s}_mean").alias(s) for s in K.TEMPERATURES])


_UPPER_SQL = ", ".join(
    f"quantile_cont({s}_mean, {p}) AS {s}_{q}" for s in K.TEMPERATURES for p, q in zip(K.UPPER_PROBABILITIES, K.UPPER_LABELS)
)


_WARM_SQL = ", ".join(
    f"quantile_cont(CASE WHEN T1_mean > 150 THEN {s}_mean END, {p}) AS {s}_{q}"
    for s in K.TEMPERATURES for p, q in zip(K.UPPER_PROBABILITIES, K.UPPER_LABELS)
)


@query(
    "monthly_wide",
    f"""{MONTHS}, q AS (SELECT id_code, CAST(month(date) AS INTEGER) AS month, {_WARM_SQL} FROM days GROUP BY ALL)
SELECT coalesce(m.id_code, q.id_code) AS id_code, coalesce(m.month, q.month) AS month, m.area, CAST(m.year AS DOUBLE) AS year,
  {', '.join(f"{r(f'coalesce({c}, 0)', 6)} AS {c}" for c in FRACTIONS)}, {r_list(['T1_mean', 'T2_absmax', 'T4_meanmin', 'moist_med'])}, {r_list(UPPER, 4)}
FROM months m FULL JOIN q ON m.id_code = q.id_code AND m.month = q.month""",
)
def monthly_wide(spark, sf_dir):
    prices = _with_prices(spark, sf_dir)
    warm = prices.select("id_code", "date", *[F.when(F.col("T1") > 150, F.col(s)).alias(s) for s in K.TEMPERATURES])
    out = rollup.months_with_quantiles(_months(spark, sf_dir), rollup.upper_quantiles(warm))
    return out.select(
        "id_code", "month", "area", F.col("year").cast("double").alias("year"),
        *rounded([*FRACTIONS, "T1_mean", "T2_absmax", "T4_meanmin", "moist_med"]),
        *rounded(UPPER, 4),
    )


@query(
    "months_by_year",
    f"""{MONTHS}, q AS (SELECT id_code, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, {_WARM_SQL} FROM days GROUP BY ALL)
SELECT coalesce(m.id_code, q.id_code) AS id_code, coalesce(m.year, q.year) AS year, coalesce(m.month, q.month) AS month, m.area,
  {r_list(['T1_mean', 'T2_absmax', 'T4_meanmin', 'moist_med'])}, {r_list(UPPER, 4)}
FROM months m FULL JOIN q ON m.id_code = q.id_code AND m.year = q.year AND m.month = q.month""",
)
def months_by_year(spark, sf_dir):
    """Several years of days: the quantiles of a month are those of its own year."""
    prices = _with_prices(spark, sf_dir)
    warm = prices.select("id_code", "date", *[F.when(F.col("T1") > 150, F.col(s)).alias(s) for s in K.TEMPERATURES])
    out = rollup.months_with_quantiles(_months(spark, sf_dir), rollup.upper_quantiles(warm, by_year=True))
    return out.select("id_code", "year", "month", "area", *rounded(["T1_mean", "T2_absmax", "T4_meanmin", "moist_med"]), *rounded(UPPER, 4))


@query(
    "p95_as_absmax",
    f"""{MONTHS}, q AS (SELECT id_code, CAST(month(date) AS INTEGER) AS month, {_UPPER_SQL} FROM days GROUP BY ALL)
SELECT m.id_code, m.month, m.year, {', '.join(f'{r(f"{s}_95", 4)} AS "{s}_absmax"' for s in K.TEMPERATURES)}, {r_list(['T1_mean', 'T3_meanmin'])}
FROM months m JOIN q ON m.id_code = q.id_code AND m.month = q.month""",
)
def p95_as_absmax(spark, sf_dir):
    joined = rollup.months_with_quantiles(
        _months(spark, sf_dir), rollup.upper_quantiles(_with_prices(spark, sf_dir))
    )
    out = rollup.p95_as_absmax(joined)
    return out.select("id_code", "month", "year", *rounded([f"{s}_absmax" for s in K.TEMPERATURES], 4), *rounded(["T1_mean", "T3_meanmin"]))


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("month", F.month("l_shipdate"))


@query(
    "upper_quantiles",
    f"""SELECT l_returnflag, CAST(month(l_shipdate) AS INTEGER) AS month, {', '.join(
        f'{r(f"quantile_cont({c}, {p})", 4)} AS "{c}_{q}"' for c in LINE_COLUMNS for p, q in zip(K.UPPER_PROBABILITIES, K.UPPER_LABELS)
    )} FROM lineitem GROUP BY 1, 2""",
)
def upper_quantiles(spark, sf_dir):
    q = order_stats.wide_quantiles(
        _lines(spark, sf_dir), ["l_returnflag", "month"], LINE_COLUMNS, K.UPPER_PROBABILITIES, K.UPPER_LABELS
    )
    return q.select("l_returnflag", "month", *rounded([f"{c}_{x}" for c in LINE_COLUMNS for x in K.UPPER_LABELS], 4))


@query(
    "quartiles",
    f"""SELECT l_returnflag, CAST(month(l_shipdate) AS INTEGER) AS month, p, {', '.join(
        f'{r(f"CASE p WHEN 0.25 THEN quantile_cont({c}, 0.25) WHEN 0.5 THEN quantile_cont({c}, 0.5) ELSE quantile_cont({c}, 0.75) END", 4)} AS "{c}"'
        for c in LINE_COLUMNS
    )} FROM lineitem, (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75]) AS p) GROUP BY 1, 2, 3""",
)
def quartiles(spark, sf_dir):
    q = rollup.quartiles(_lines(spark, sf_dir), ["l_returnflag", "month"], LINE_COLUMNS)
    return q.select("l_returnflag", "month", "p", *rounded(LINE_COLUMNS, 4))


@query(
    "calendar_days",
    """WITH span AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
d AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS date FROM span)
SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(*) AS ndaysmax,
  CAST(max(n) AS BIGINT) AS busiest FROM d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS od, count(*) AS n FROM orders GROUP BY 1) ON od = date GROUP BY 1, 2""",
)
def calendar_days(spark, sf_dir):
    # Calendar over the span of the orders, with the busiest day of each month.
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    span = orders.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL '1' DAY"))).alias("date"))
    counts = orders.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    joined = days.join(counts, "date", "left")
    busiest = joined.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.max("n").alias("busiest"))
    return rollup.days_in_month(joined).join(busiest, ["year", "month"])


@query(
    "sensor_availability",
    f"""{MONTHS}, long AS (SELECT area, year, month, replace(var, 'day_frac_', '') AS var, prop FROM
  (FROM (SELECT area, year, month, {', '.join(FRACTIONS)} FROM months) UNPIVOT INCLUDE NULLS (prop FOR var IN ({', '.join(FRACTIONS)})))),
c AS (SELECT area, year, month, var, count(*) AS n FROM long WHERE prop > {LIMIT} GROUP BY ALL)
SELECT area, year, month, var, n, max(n) OVER (PARTITION BY area, var) AS max_n,
  {r('100 * (n / max(n) OVER (PARTITION BY area, var))', 0)} AS prop, {day_sql('make_date(year, month, 1)', 'ym')} FROM c""",
)
def sensor_availability(spark, sf_dir):
    m = _months(spark, sf_dir).withColumnsRenamed({c: f"{c[9:]}_prop" for c in FRACTIONS})
    return reports.sensor_availability(m, LIMIT).select("area", "year", "month", "var", "n", "max_n", "prop", day("ym", "ym"))


@query(
    "group_max_share",
    f"""WITH c AS (SELECT c_nationkey AS nation, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT nation, month, n, max(n) OVER (PARTITION BY nation) AS max_n, {r('100 * (n / max(n) OVER (PARTITION BY nation))', 0)} AS prop FROM c""",
)
def group_max_share(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = o.groupBy(F.col("c_nationkey").alias("nation"), F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return reshape.share_of_group_max(counts, "n", ["nation"])


@query(
    "double_means",
    f"""SELECT l_returnflag, {', '.join(f'{r(f"avg({c})", 5)} AS "{c}"' for c in LINE_COLUMNS)} FROM lineitem GROUP BY 1""",
)
def double_means(spark, sf_dir):
    means = reshape.double_means(table(spark, sf_dir, "lineitem"), ["l_returnflag"])
    return means.select("l_returnflag", *rounded(LINE_COLUMNS, 5))


OVERRIDES = [("HOUSEHOLD", 100.0), ("MACHINERY", -5.0), ("NOT THERE", 1.0)]


@query(
    "overrides",
    f"""SELECT c_custkey, {r('''CASE WHEN c_nationkey < 10 AND c_mktsegment = 'HOUSEHOLD' THEN 100.0
  WHEN c_nationkey < 10 AND c_mktsegment = 'MACHINERY' THEN -5.0 ELSE c_acctbal END''', 2)} AS c_acctbal FROM customer""",
)
def overrides(spark, sf_dir):
    fixed = constant_table(spark, OVERRIDES, "c_mktsegment string, c_acctbal double")
    out = C.apply_overrides(
        table(spark, sf_dir, "customer"), fixed, "c_mktsegment", ["c_acctbal"], F.col("c_nationkey") < 10
    )
    return out.select("c_custkey", *rounded(["c_acctbal"], 2))


def _snow(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    date = F.to_date("o_orderdate")
    return o.select(
        area_of("c_nationkey").alias("area"),
        (F.year(date) + F.when(F.month(date) >= 9, 1).otherwise(0)).alias("hydro_year"),
        date.alias("first_snow_date"),
        F.date_add(date, (F.col("o_orderkey") % 90).cast("int")).alias("last_snow_date"),
    ).filter(F.month("first_snow_date").isin(9, 10, 11, 12, 1, 2, 3))


_SNOW_SQL = f"""WITH snow AS (SELECT * FROM (SELECT {area_sql('c_nationkey')} AS area, CAST(o_orderdate AS DATE) AS first_snow_date,
  year(o_orderdate) + CASE WHEN month(o_orderdate) >= 9 THEN 1 ELSE 0 END AS hydro_year,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS last_snow_date
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE month(first_snow_date) IN (9, 10, 11, 12, 1, 2, 3)),
w AS (SELECT area, min(first_snow_date) AS first_snow_date, max(last_snow_date) AS last_snow_date FROM snow WHERE hydro_year = 2000 GROUP BY area)"""


@query(
    "snow_window",
    f"""{_SNOW_SQL} SELECT area, {day_sql('first_snow_date', 'first_snow_date')}, {day_sql('last_snow_date', 'last_snow_date')},
  array_to_string([month(d) FOR d IN generate_series(CAST(first_snow_date AS TIMESTAMP), CAST(last_snow_date AS TIMESTAMP), INTERVAL 1 MONTH)], ',') AS months FROM w""",
)
def snow_window(spark, sf_dir):
    w = features.snow_windows(_snow(spark, sf_dir), 2000)
    months = features.snowy_months(w).select("area", F.array_join(F.col("snowy").cast("array<string>"), ",").alias("months"))
    return w.join(months, "area").select(
        "area", day("first_snow_date", "first_snow_date"), day("last_snow_date", "last_snow_date"), "months"
    )


_ELIGIBLE = {
    "altitude": "area NOT IN ('KAR', 'HYY', 'TII')",
    "pisr": "month NOT IN (1, 2, 11, 12)",
    "snow_days": "area <> 'KAR' AND list_contains(snowy, month)",
    "water_prop_500m": "area <> 'VAR'",
}


@query(
    "eligibility",
    f"""{_SNOW_SQL}, s AS (SELECT area, [month(d) FOR d IN generate_series(CAST(first_snow_date AS TIMESTAMP), CAST(last_snow_date AS TIMESTAMP), INTERVAL 1 MONTH)] AS snowy FROM w),
cells AS (SELECT DISTINCT {area_sql('c_nationkey')} AS area, month(o_orderdate) AS month FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT area, CAST(month AS INTEGER) AS month, {', '.join(f"CASE WHEN {_ELIGIBLE.get(p, 'true')} THEN 1 ELSE 0 END AS {p}" for p in K.PREDICTORS)}
FROM cells JOIN s USING (area)""",
)
def eligibility(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = o.select(area_of("c_nationkey").alias("area"), F.month("o_orderdate").alias("month")).distinct()
    snowy = features.snowy_months(features.snow_windows(_snow(spark, sf_dir), 2000))
    mask = cells.join(snowy, "area").withColumn("ok", features.eligible("area", "month", "snowy"))
    return mask.select("area", "month", *[F.col("ok")[i].cast("int").alias(p) for i, p in enumerate(K.PREDICTORS)])


def _cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(
        F.col("c_nationkey").alias("nation"), F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_orderstatus").alias("status"),
    ).agg(F.sum("o_totalprice").alias("total"))


_CELLS_SQL = """WITH c AS (SELECT c_nationkey AS nation, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS status, sum(o_totalprice) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT nation FROM c), (SELECT DISTINCT month FROM c), (SELECT DISTINCT status FROM c))"""


@query("complete_grid", f"{_CELLS_SQL} SELECT nation, month, status FROM grid ANTI JOIN c USING (nation, month, status)")
def complete_grid(spark, sf_dir):
    return reshape.missing_cells(_cells(spark, sf_dir), ["nation", "month", "status"])


@query(
    "grid_zero_fill",
    f"{_CELLS_SQL} SELECT nation, month, status, {r('coalesce(total, 0)', 2)} AS total FROM grid LEFT JOIN c USING (nation, month, status)",
)
def grid_zero_fill(spark, sf_dir):
    full = reshape.complete_grid(_cells(spark, sf_dir), ["nation", "month", "status"], {"total": 0.0})
    return full.select("nation", "month", "status", *rounded(["total"], 2))


@query(
    "stack_rows",
    f"""SELECT 'c' AS source, c_custkey AS key, {r('c_acctbal', 2)} AS c_acctbal, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer
UNION ALL BY NAME SELECT 's' AS source, s_suppkey AS key, {r('s_acctbal', 2)} AS s_acctbal FROM supplier""",
)
def stack_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("key"), *rounded(["c_acctbal"], 2))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("key"), *rounded(["s_acctbal"], 2))
    return reshape.stack_rows(c, s)


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS yd, strftime(make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 1), '%Y-%m-%d') AS ym FROM orders""",
)
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofyear(d).alias("yd"),
        day(dates.month_start(F.year(d), F.month(d)), "ym"),
    )


@query(
    "study_year",
    """SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (11, 12) THEN 2019 ELSE 2020 END AS year,
  CAST((month(o_orderdate) + 1) % 12 + 1 AS INTEGER) AS position FROM orders""",
)
def study_year(spark, sf_dir):
    m = F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.study_year(m).alias("year"), dates.hydro_rank(m).alias("position")
    )


@query(
    "month_labels",
    """SELECT o_orderkey, strftime(o_orderdate, '%b') AS label, strftime(o_orderdate, '%b/%Y') AS label_year FROM orders""",
)
def month_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.month_label(F.month("o_orderdate")).alias("label"),
        dates.month_year_label("o_orderdate").alias("label_year"),
    )


@query(
    "text_parts",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(split_part(p_name, ' ', 2), '') AS second,
  replace(p_brand, 'Brand#', '') AS brand, CAST(TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS DOUBLE) AS number,
  CAST(TRY_CAST(split_part(p_name, ' ', 1) AS INTEGER) AS DOUBLE) AS no_number, p_type || '_' || p_size AS joined FROM part""",
)
def text_parts(spark, sf_dir):
    brand = F.regexp_replace("p_brand", "Brand#", "")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        labels.split_part("p_name", 1, " ").alias("first"),
        labels.split_part("p_name", 2, " ").alias("second"),
        brand.alias("brand"),
        brand.try_cast("int").cast("double").alias("number"),
        labels.split_part("p_name", 1, " ").try_cast("int").cast("double").alias("no_number"),
        F.concat_ws("_", "p_type", "p_size").alias("joined"),
    )


SEGMENTS = {"BUILDING": "Building", "AUTOMOBILE": "Car", "MACHINERY": "Machine"}
_POSITION = "CASE label WHEN 'Building' THEN 1 WHEN 'Car' THEN 2 WHEN 'Machine' THEN 3 END"


@query(
    "recode_order",
    f"""WITH l AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'AUTOMOBILE' THEN 'Car' WHEN 'MACHINERY' THEN 'Machine' ELSE c_mktsegment END AS label FROM customer)
SELECT label, CAST({_POSITION} AS DOUBLE) AS position, count(*) AS n FROM l GROUP BY 1""",
)
def recode_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(labels.recode("c_mktsegment", SEGMENTS).alias("label"))
    counts = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    position = labels.rank_of("label", list(SEGMENTS.values())).cast("double").alias("position")
    return counts.select("label", position, "n").orderBy(F.asc_nulls_last("position"))


@query(
    "merge_categories",
    f"""SELECT CASE WHEN area = 'MAL' THEN 'MAL & AIL' ELSE area END AS area, count(*) AS n
FROM (SELECT {area_sql('c_nationkey')} AS area FROM customer) WHERE area <> 'AIL' GROUP BY 1""",
)
def merge_categories(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(area_of("c_nationkey").alias("area"))
    return stations.merge_areas(c).groupBy("area").agg(F.count(F.lit(1)).alias("n"))


def _distances(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("FMISID"),
        F.date_add(F.lit("2019-10-01").cast("date"), (F.col("s_suppkey") % 50).cast("int")).alias("first_date"),
        F.date_add(F.lit("2020-10-20").cast("date"), (F.col("s_suppkey") % 40).cast("int")).alias("last_date"),
        *[F.abs(F.round(F.col("s_acctbal") / 500) - 2 * i).alias(a) for i, a in enumerate(K.AREAS)],
    )
    return s.unpivot(["FMISID", "first_date", "last_date"], K.AREAS, "target_area", "distance")


_NEAREST_SQL = f"""WITH s AS (SELECT s_suppkey AS FMISID, DATE '2019-10-01' + CAST(s_suppkey % 50 AS INTEGER) AS first_date,
  DATE '2020-10-20' + CAST(s_suppkey % 40 AS INTEGER) AS last_date, {', '.join(f'abs(round(s_acctbal / 500) - {2 * i}) AS {a}' for i, a in enumerate(K.AREAS))} FROM supplier),
d AS (FROM s UNPIVOT (distance FOR area IN ({', '.join(K.AREAS)}))),
chosen AS (SELECT area, FMISID FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY distance, FMISID) AS rn FROM d
  WHERE first_date <= DATE '2019-11-01' AND last_date >= DATE '2020-10-31') WHERE rn = 1),
st AS (SELECT FMISID, area FROM (SELECT *, row_number() OVER (PARTITION BY FMISID ORDER BY list_position(['{"','".join(K.AREAS)}'], area) DESC) AS rn FROM chosen) WHERE rn = 1)"""


@query("nearest_station", f'{_NEAREST_SQL} SELECT FMISID AS "FMISID", area FROM st')
def nearest_station(spark, sf_dir):
    return stations.nearest_stations(_distances(spark, sf_dir))


def _weather(spark, sf_dir):
    """Daily mean order value per customer nation as station temperatures."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(
        F.col("c_nationkey").cast("long").alias("FMISID"), F.to_date("o_orderdate").alias("time")
    ).agg(F.avg(F.when((F.col("o_orderpriority") != "5-LOW") | (F.col("c_nationkey") < 7), F.col("o_totalprice"))).alias("tday"))


_WEATHER_SQL = """weather AS (SELECT CAST(c_nationkey AS BIGINT) AS FMISID, CAST(o_orderdate AS DATE) AS time,
  avg(CASE WHEN o_orderpriority <> '5-LOW' OR c_nationkey < 7 THEN o_totalprice END) AS tday FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
_AREAS_SQL = f"areas AS (SELECT CAST(n_nationkey AS BIGINT) AS FMISID, {area_sql('n_nationkey')} AS area FROM nation WHERE n_nationkey < 14)"
_NORMALS_SQL = f"""WITH {_WEATHER_SQL}, {_AREAS_SQL}, normals AS (SELECT FMISID, area, CAST(dayofyear(time) AS INTEGER) AS yday, count(*) AS n_days, avg(tday) AS Tavg30
  FROM weather JOIN areas USING (FMISID) WHERE time BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND tday IS NOT NULL GROUP BY ALL)"""


def _areas(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") < 14)
    return n.select(F.col("n_nationkey").cast("long").alias("FMISID"), area_of("n_nationkey").alias("area"))


def _normals(spark, sf_dir):
    mapped = stations.mapped_only(_weather(spark, sf_dir), _areas(spark, sf_dir))
    return stations.day_normals(mapped, "1996-01-01", "2000-12-31")


@query("station_normals", f'{_NORMALS_SQL} SELECT FMISID AS "FMISID", area, yday, n_days, {r("Tavg30", 2)} AS "Tavg30" FROM normals')
def station_normals(spark, sf_dir):
    return _normals(spark, sf_dir).select("FMISID", "area", "yday", "n_days", *rounded(["Tavg30"], 2))


@query(
    "vs_normals",
    f"""{_NORMALS_SQL} SELECT FMISID AS "FMISID", CASE WHEN area = 'MAL' THEN 'MAL & AIL' ELSE area END AS area, {day_sql('time', 'time')},
  CAST(dayofyear(time) AS INTEGER) AS yday, {r('tday', 2)} AS tday, {r('Tavg30', 2)} AS "Tavg30"
FROM (SELECT *, CAST(dayofyear(time) AS INTEGER) AS yday FROM weather JOIN areas USING (FMISID) WHERE time >= DATE '2000-11-01') LEFT JOIN normals USING (FMISID, area, yday) WHERE area <> 'AIL'""",
)
def vs_normals(spark, sf_dir):
    mapped = stations.mapped_only(_weather(spark, sf_dir), _areas(spark, sf_dir))
    study = mapped.filter(F.col("time") >= F.lit("2000-11-01").cast("date"))
    out = reports.weather_against_normals(study, _normals(spark, sf_dir))
    return out.select("FMISID", "area", day("time", "time"), "yday", *rounded(["tday", "Tavg30"], 2))


@query(
    "sparse_groups",
    f'{_NORMALS_SQL} SELECT FMISID AS "FMISID", area, yday, n_days FROM normals WHERE n_days < 3',
)
def sparse_groups(spark, sf_dir):
    return stations.sparse_groups(_normals(spark, sf_dir), "n_days", 3).select("FMISID", "area", "yday", "n_days")


@query(
    "study_means",
    f"""WITH {_WEATHER_SQL}, {_AREAS_SQL} SELECT FMISID AS "FMISID", area, count(*) AS n_days,
  CASE WHEN count(tday) = count(*) THEN {r('avg(tday)', 2)} END AS "Tavg" FROM weather JOIN areas USING (FMISID) GROUP BY ALL""",
)
def study_means(spark, sf_dir):
    mapped = stations.mapped_only(_weather(spark, sf_dir), _areas(spark, sf_dir))
    return stations.study_means(mapped).select("FMISID", "area", "n_days", *rounded(["Tavg"], 2))
