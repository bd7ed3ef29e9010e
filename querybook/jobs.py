"""Queries on whole jobs: writing and reading back, model input, smoothed report series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from querybook.base import area_of, area_sql, query, r, readings, readings_sql, rounded, table
from querybook.modelling import loess_sql
from querybook.reporting import _RESULTS, _results
from sensorframe import constants as K
from sensorframe.functions.nulls import round_to
from sensorframe.plans import modelling, reports
from sensorframe.session import shared_folder
from sensorframe.sources import readers, schemas, writers

AREA = "HYY"


def _new_folder(spark):
    return f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"


@query(
    "one_area_of_many",
    f"""WITH {readings_sql()} SELECT id_code, count(*) AS n, {r('avg(T1)', 6)} AS T1, {r('max(T4)', 6)} AS T4
FROM readings WHERE area = '{AREA}' GROUP BY 1""",
)
def one_area_of_many(spark, sf_dir):
    """All readings written by area; one area read back from its folder alone."""
    folder = _new_folder(spark)
    writers.write_table(readings(spark, sf_dir).select(*[c.split(" ")[0] for c in schemas.READINGS.split(", ") if "count" not in c and "arh" not in c]), folder, partition_by=["area"])
    mine = readers.read_partition(spark, folder, schemas.READINGS, area=AREA)
    return mine.groupBy("id_code").agg(F.count(F.lit(1)).alias("n"), F.avg("T1").alias("T1"), F.max("T4").alias("T4")).select(
        "id_code", "n", *rounded(["T1", "T4"])
    )


_LINE = "FMISID int, area string, time date, tday double"


@query(
    "damaged_lines",
    f"""WITH o AS (SELECT o_custkey % 50 AS id, {area_sql('o_custkey')} AS area, o_totalprice AS v, o_orderkey % 97 AS k FROM orders)
SELECT 'good' AS kind, area, count(*) AS n, {r('sum(v)', 2)} AS total FROM o WHERE k > 2 GROUP BY area
UNION ALL SELECT 'damaged', NULL, count(*), NULL FROM o WHERE k <= 2""",
)
def damaged_lines(spark, sf_dir):
    """Orders as lines of a csv file, three of 97 damaged in one of three ways: good rows by area, and the damaged ones counted."""
    k = F.col("o_orderkey") % 97
    cells = [(F.col("o_custkey") % 50).cast("string"), area_of("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("string")]
    line = F.when(k == 0, F.concat_ws(",", *cells[:2])).when(k == 1, F.concat_ws(",", *cells, F.lit("x"))).when(k == 2, F.concat_ws(",", *cells[:3], F.lit("12;5")))
    lines = table(spark, sf_dir, "orders").select(line.otherwise(F.concat_ws(",", *cells)).alias("value"))
    folder = _new_folder(spark)
    lines.write.text(folder)  # no header line: the schema names the columns
    good, damaged = readers.read_checked(spark, folder, _LINE, header=False)
    by_area = good.groupBy(F.lit("good").alias("kind"), "area").agg(F.count(F.lit(1)).alias("n"), F.sum("tday").alias("total"))
    bad = damaged.agg(F.lit("damaged").alias("kind"), F.lit(None).cast("string").alias("area"), F.count("line").alias("n"), F.lit(None).cast("double").alias("total"))
    return by_area.unionByName(bad).select("kind", "area", "n", round_to("total", 2).alias("total"))


# --- model input -------------------------------------------------------------------------------------

_RADIATION = [f"pisr_m{m}_50m" for m in range(1, 13)]
_SITE = f"concat('S', c_custkey) AS id_code, {area_sql('c_nationkey')} AS area"
_KEPT = "c_custkey % 4 <> 0 AND NOT (c_nationkey % 7 = 4 AND c_custkey >= 100)"


@query(
    "model_input",
    f"""WITH s AS (SELECT {_SITE}, c_acctbal FROM customer WHERE {_KEPT}),
o AS (SELECT concat('S', o_custkey) AS id_code, {area_sql('c_nationkey')} AS area, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT id_code, area, year, month, avg(o_totalprice) AS T1_mean, min(o_totalprice) / 7 AS moist_med FROM o GROUP BY 1, 2, 3, 4),
w AS (SELECT id_code, area, count(*) FILTER (o_orderpriority = '5-LOW') AS snow_days FROM o GROUP BY 1, 2)
SELECT m.id_code, m.area, m.year, m.month, {r('T1_mean', 3)} AS "T1_mean", {r('c_acctbal * m.month', 3)} AS pisr, {r('moist_med', 3)} AS moist_med, snow_days,
  {r('c_acctbal / 100', 4)} AS altitude FROM m LEFT JOIN w USING (id_code, area) LEFT JOIN s ON s.id_code = m.id_code""",
)
def model_input(spark, sf_dir):
    """The table that the monthly models are fitted on, for the sites of the study."""
    sites = table(spark, sf_dir, "customer").select(
        F.expr("concat('S', c_custkey)").alias("id_code"), area_of("c_nationkey").alias("area"), F.col("c_custkey").cast("int").alias("site"),
        F.when(F.col("c_custkey") % 4 == 0, "Other").otherwise("Tomst").alias("logger"), F.col("c_acctbal").alias("altitude"),
        *[(F.col("c_acctbal") * m).alias(c) for m, c in enumerate(_RADIATION, 1)],
    )
    sites = modelling.study_sites(sites)
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.expr("concat('S', o_custkey)").alias("id_code"), area_of("c_nationkey").alias("area"), F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"), "o_totalprice", "o_orderpriority",
    )
    keys = ["id_code", "area", "year", "month"]
    monthly = o.groupBy(*keys).agg(F.avg("o_totalprice").alias("T1_mean"))
    moisture = o.groupBy(*keys).agg((F.min("o_totalprice") / 7).alias("moist_med"))
    snow = o.groupBy("id_code", "area").agg(F.count_if(F.col("o_orderpriority") == "5-LOW").alias("snow_days"))
    out = modelling.model_input(monthly, sites, moisture, snow, ["T1_mean"])
    return out.select(*keys, *rounded(["T1_mean", "pisr", "moist_med"], 3), "snow_days", *rounded(["altitude"], 4))


# --- smoothed series of the reports --------------------------------------------------------------------


def _curve_sql(source: str, span: float, keys: str) -> str:
    return f"""{loess_sql(source, span)} SELECT {keys}, {r('g', 4)} AS x, {r('fit', 4)} AS fit FROM fits"""


@query(
    "spread_curves",
    _curve_sql(
        f"""p AS (SELECT k, x, y FROM (SELECT concat({area_sql('o_custkey')}, '|', t) AS k, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x,
  stddev_samp(o_totalprice / d) AS y FROM orders, (VALUES ('T1', 1000.0::DOUBLE), ('T4', 2000.0::DOUBLE)) v(t, d) GROUP BY 1, 2) WHERE y IS NOT NULL)""",
        0.3, "split_part(k, '|', 1) AS area, split_part(k, '|', 2) AS tsen",
    ),
)
def spread_curves(spark, sf_dir):
    """Smoothed spread across sites per area and sensor."""
    o = table(spark, sf_dir, "orders").select(area_of("o_custkey").alias("area"), F.col("o_orderdate").cast("date").alias("datetime"), (F.col("o_totalprice") / 1000).alias("T1"))
    o = o.withColumns({"T2": F.lit(None).cast("double"), "T3": F.lit(None).cast("double"), "T4": F.col("T1") / 2})
    return reports.spread_curves(o).select("area", "tsen", round_to("x", 4).alias("x"), *rounded(["fit"], 4))


@query(
    "weather_curves",
    _curve_sql(
        f"""p AS (SELECT k, x, y FROM (SELECT concat({area_sql('c_nationkey')}, '|', n) AS k, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x,
  CASE n WHEN 'tday' THEN avg(o_totalprice / 1000) ELSE min(o_totalprice / 1000) END AS y FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES ('tday'), ('Tavg30')) v(n) GROUP BY 1, 2, n))""",
        0.2, "split_part(k, '|', 1) AS area, split_part(k, '|', 2) AS series",
    ),
)
def weather_curves(spark, sf_dir):
    """Smoothed days of the study year and their normals, per area."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = o.groupBy(area_of("c_nationkey").alias("area"), F.col("o_orderdate").cast("date").alias("time")).agg(
        F.avg(F.col("o_totalprice") / 1000).alias("tday"), F.min(F.col("o_totalprice") / 1000).alias("Tavg30")
    )
    return reports.weather_curves(days).select("area", "series", round_to("x", 4).alias("x"), *rounded(["fit"], 4))


@query("spread_bands")
def spread_bands(spark, sf_dir):
    """The curves of the spread with their standard errors."""
    o = table(spark, sf_dir, "orders").select(area_of("o_custkey").alias("area"), F.col("o_orderdate").cast("date").alias("datetime"), *[(F.col("o_totalprice") / 1000).alias(t) for t in K.TEMPERATURES])
    return reports.spread_curves(o, se=True)


_PLACE = "CASE month " + " ".join(f"WHEN {m} THEN {i}" for i, m in enumerate(K.HYDRO_MONTHS, 1)) + " END"


@query(
    "r2_curves",
    _curve_sql(
        f"""{_RESULTS}, p AS (SELECT concat(tsen, '|', tvar) AS k, CAST({_PLACE} AS DOUBLE) AS x, adj_r_squared AS y FROM res WHERE tvar IN ({', '.join(f"'{v}'" for v in K.RESPONSE_LABELS)}))""",
        0.8, "split_part(k, '|', 1) AS tsen, split_part(k, '|', 2) AS tvar",
    ).replace(f"{r('fit', 4)} AS fit", f"{r('fit', 6)} AS fit"),
)
def r2_curves(spark, sf_dir):
    """Smoothed R squared over the months of the study year, per sensor and statistic."""
    return reports.r2_curves(_results(spark, sf_dir)).select("tsen", "tvar", round_to("x", 4).alias("x"), *rounded(["fit"]))
