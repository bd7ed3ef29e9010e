"""Queries on reshaping and summary reports; line items stand in for model results."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.base import area_of, area_sql, query, r, r_list, rounded, table
from sensorframe import constants as K
from sensorframe.functions import labels
from sensorframe.functions.nulls import round_to, strict_mean, weighted_mean
from sensorframe.operators import reshape
from sensorframe.plans import reports

_BY_MONTH = "WITH m AS (SELECT o_orderstatus AS status, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n, avg(o_totalprice) AS price, max(CASE WHEN o_orderpriority = '1-URGENT' AND month(o_orderdate) <> 3 THEN o_totalprice END) AS urgent FROM orders GROUP BY 1, 2)"


def _by_month(spark, sf_dir):
    urgent = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.month("o_orderdate") != 3), F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("status"), F.month("o_orderdate").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price"), F.max(urgent).alias("urgent"))


@query(
    "to_long",
    f"""{_BY_MONTH} SELECT status, month, name, {r('value', 4)} AS value FROM
  (FROM (SELECT status, month, price, urgent FROM m) UNPIVOT INCLUDE NULLS (value FOR name IN (price, urgent)))""",
)
def to_long(spark, sf_dir):
    long = reshape.to_long(_by_month(spark, sf_dir), ["status", "month"], ["price", "urgent"], "name", "value")
    return long.select("status", "month", "name", *rounded(["value"], 4))


@query(
    "to_wide",
    f"""{_BY_MONTH} SELECT status, {', '.join(f'{r(f"max(CASE WHEN month = {m} THEN price END)", 4)} AS "{K.MONTH_LABELS[m - 1]}"' for m in K.HYDRO_MONTHS)} FROM m GROUP BY 1""",
)
def to_wide(spark, sf_dir):
    wide = reshape.to_wide(_by_month(spark, sf_dir), ["status"], "month", ["price"], K.HYDRO_MONTHS)
    return wide.select("status", *[round_to(str(m), 4).alias(K.MONTH_LABELS[m - 1]) for m in K.HYDRO_MONTHS])


@query(
    "to_wide_multi",
    f"""{_BY_MONTH} SELECT month, {', '.join(f'{r(f"max(CASE WHEN status = {chr(39)}{s}{chr(39)} THEN {v} END)", 4)} AS "{v}_{s}"' for v in ('price', 'urgent') for s in 'FOP')} FROM m GROUP BY 1""",
)
def to_wide_multi(spark, sf_dir):
    wide = reshape.to_wide(_by_month(spark, sf_dir), ["month"], "status", ["price", "urgent"], list("FOP"))
    return wide.select("month", *rounded([f"{v}_{s}" for v in ("price", "urgent") for s in "FOP"], 4))


@query(
    "strict_mean",
    f"""SELECT l_suppkey, CASE WHEN count(x) = count(*) THEN {r('avg(x)', 4)} END AS strict, {r('avg(x)', 4)} AS lenient
FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 2 = 1 AND l_discount = 0 THEN NULL ELSE l_extendedprice END AS x FROM lineitem) GROUP BY 1""",
)
def strict_means(spark, sf_dir):
    x = F.when((F.col("l_suppkey") % 2 == 1) & (F.col("l_discount") == 0), None).otherwise(F.col("l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", x.alias("x"))
    return rows.groupBy("l_suppkey").agg(
        round_to(strict_mean("x"), 4).alias("strict"), round_to(F.avg("x"), 4).alias("lenient")
    )


@query(
    "weighted_mean",
    f"""SELECT l_linenumber, l_discount, {r('CASE WHEN sum(abs(l_tax)) <> 0 AND l_discount > 0.03 THEN sum(l_quantity * abs(l_tax)) / sum(abs(l_tax)) END', 5)} AS mean
FROM lineitem GROUP BY 1, 2""",
)
def weighted_means(spark, sf_dir):
    weight = F.abs(F.when(F.col("l_discount") > 0.03, F.col("l_tax")).otherwise(0.0))
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_linenumber", "l_discount").agg(round_to(weighted_mean("l_quantity", weight), 5).alias("mean"))


@query(
    "group_stats",
    f"""SELECT p_type, p_brand, {r('avg(p_retailprice)', 4)} AS mean, {r('median(p_retailprice)', 4)} AS median, {r('min(p_retailprice)', 4)} AS min,
  {r('max(p_retailprice)', 4)} AS max, {r('max(p_retailprice) - min(p_retailprice)', 4)} AS "range length" FROM part GROUP BY 1, 2""",
)
def group_stats(spark, sf_dir):
    stats = reports.five_stats(table(spark, sf_dir, "part"), ["p_type", "p_brand"], "p_retailprice")
    return stats.select("p_type", "p_brand", *rounded(K.GRADIENT_STATISTICS, 4))


# --- Line items as model results ---------------------------------------------------------------------

SENSOR_OF = ["T1", "T2", "T3", "T4"]
STATISTIC_OF = ["mean", "absmax", "absmin", "meanmax", "meanmin"]


def _label(names, number):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def _label_sql(names, number):
    return f"CASE ({number}) % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


def _results(spark, sf_dir):
    """Line items averaged into one value per (area, month, response)."""
    l = table(spark, sf_dir, "lineitem")
    resp = F.concat_ws("_", _label(SENSOR_OF, F.col("l_suppkey")), _label(STATISTIC_OF, F.col("l_partkey")))
    return l.groupBy(
        area_of("l_orderkey").alias("area"), F.month("l_shipdate").alias("month"), resp.alias("resp")
    ).agg(F.avg("l_discount").alias("r_squared"), F.avg("l_tax").alias("adj_r_squared"))


_RESULTS = f"""l AS (SELECT *, {area_sql('l_orderkey')} AS area, CAST(month(l_shipdate) AS INTEGER) AS month,
  {_label_sql(SENSOR_OF, 'l_suppkey')} AS tsen, {_label_sql(STATISTIC_OF, 'l_partkey')} AS tvar FROM lineitem),
res AS (SELECT area, month, tsen, tvar, avg(l_discount) AS r_squared, avg(l_tax) AS adj_r_squared FROM l GROUP BY 1, 2, 3, 4)"""
_NAMED = "CASE tvar WHEN 'absmin' THEN 'Tmin' WHEN 'mean' THEN 'Tavg' WHEN 'absmax' THEN 'Tmax' END"


@query(
    "enrich_results",
    f"""WITH {_RESULTS} SELECT area, month, tsen || '_' || tvar AS resp, tsen, tvar, CASE WHEN month IN (11, 12) THEN 2019 ELSE 2020 END AS year,
  strftime(make_date(CASE WHEN month IN (11, 12) THEN 2019 ELSE 2020 END, month, 1), '%Y-%m-%d') AS ym,
  CAST(list_position(['{"','".join(K.AREAS)}'], area) AS INTEGER) AS area_rank, {r_list(['r_squared'])} FROM res""",
)
def enrich_results(spark, sf_dir):
    e = reports.enrich_results(_results(spark, sf_dir))
    return e.select(
        "area", "month", "resp", "tsen", "tvar", "year", F.date_format("ym", "yyyy-MM-dd").alias("ym"), "area_rank",
        *rounded(["r_squared"]),
    )


@query(
    "r2_table",
    f"""WITH {_RESULTS}, w AS (SELECT tsen, {_NAMED} AS tvar, area, {', '.join(f"max(CASE WHEN month = {m} THEN r_squared END) AS m{m}" for m in K.HYDRO_MONTHS)}
  FROM res WHERE tsen <> 'T2' AND tvar IN ('absmin', 'mean', 'absmax') GROUP BY 1, 2, 3)
SELECT tvar AS "T variable", tsen AS "T height", {', '.join(f'CASE WHEN count(m{m}) = count(*) THEN {r(f"avg(m{m})", 2)} END AS "{K.MONTH_LABELS[m - 1]}"' for m in K.HYDRO_MONTHS)} FROM w GROUP BY 1, 2""",
)
def r2_table(spark, sf_dir):
    return reports.r2_table(_results(spark, sf_dir))


@query(
    "r2_by_dimension",
    f"""WITH {_RESULTS}, k AS (SELECT * FROM res WHERE tvar IN ('absmin', 'mean', 'absmax')), g AS (
SELECT 'tsen' AS level, tsen, NULL AS tvar, NULL AS area, NULL AS month, avg(r_squared) AS mean, min(r_squared) AS min, max(r_squared) AS max FROM k GROUP BY tsen
UNION ALL SELECT 'tvar', NULL, tvar, NULL, NULL, avg(r_squared), min(r_squared), max(r_squared) FROM k GROUP BY tvar
UNION ALL SELECT 'area', NULL, NULL, area, NULL, avg(r_squared), min(r_squared), max(r_squared) FROM k GROUP BY area
UNION ALL SELECT 'month', NULL, NULL, NULL, month, avg(adj_r_squared), NULL, NULL FROM k GROUP BY month)
SELECT level, tsen, tvar, area, CAST(month AS DOUBLE) AS month, {r_list(['mean', 'min', 'max'])} FROM g""",
)
def r2_by_dimension(spark, sf_dir):
    s = reports.r2_summary(_results(spark, sf_dir))
    return s.select("level", "tsen", "tvar", "area", F.col("month").cast("double").alias("month"), *rounded(["mean", "min", "max"]))


def _importances(spark, sf_dir):
    """Line items as importances of predictors, by method; some negative, some missing."""
    l = table(spark, sf_dir, "lineitem")
    known = F.col("l_partkey") % 7 != F.month("l_shipdate") % 7
    resp = F.concat_ws("_", _label(SENSOR_OF, F.col("l_suppkey")), _label(STATISTIC_OF, F.col("l_partkey")))
    variable = _label([*K.PREDICTORS, "extra"], F.col("l_orderkey") + F.col("l_linenumber"))
    rows = l.groupBy(
        area_of("l_partkey").alias("area"), F.month("l_shipdate").alias("month"), resp.alias("resp"), variable.alias("Variable")
    ).agg((F.avg(F.when(known, F.col("l_discount"))) - 0.04).alias("a"), F.avg(F.when(known, F.col("l_quantity"))).alias("b"))
    methods = F.explode(F.array(
        F.struct(F.lit("perm_r2").alias("method"), F.col("a").alias("Importance"), F.lit(None).cast("string").alias("Sign")),
        F.struct(F.lit("tstat").alias("method"), F.col("b").alias("Importance"), F.when(F.col("b") > 25.5, "POS").when(F.col("b") <= 25.5, "NEG").alias("Sign")),
        F.struct(F.lit("pdp").alias("method"), F.col("b").alias("Importance"), F.lit(None).cast("string").alias("Sign")),
    ))
    return rows.select("area", "month", "resp", "Variable", methods.alias("m")).select("area", "month", "resp", "Variable", "m.*")


_IMPORTANCES = f"""imp AS (SELECT {area_sql('l_partkey')} AS area, CAST(month(l_shipdate) AS INTEGER) AS month, {_label_sql(SENSOR_OF, 'l_suppkey')} AS tsen, {_NAMED} AS tvar,
  {_label_sql([*K.PREDICTOR_LABELS.values(), 'extra'], 'pos')} AS Variable, a, b FROM
  (SELECT *, {_label_sql(STATISTIC_OF, 'l_partkey')} AS tvar, list_position(['{"','".join(K.PREDICTOR_LABELS)}', 'extra'], {_label_sql([*K.PREDICTORS, 'extra'], 'l_orderkey + l_linenumber')}) - 1 AS pos,
    CASE WHEN l_partkey % 7 <> month(l_shipdate) % 7 THEN l_discount END AS a, CASE WHEN l_partkey % 7 <> month(l_shipdate) % 7 THEN l_quantity END AS b FROM lineitem)),
cells AS (SELECT area, month, tsen, tvar, Variable, avg(a) - 0.04 AS a, avg(b) AS b FROM imp WHERE tvar IS NOT NULL AND Variable <> 'extra' GROUP BY 1, 2, 3, 4, 5)"""


def _grid_sql(where: str) -> str:
    dims = ", ".join(f"(SELECT DISTINCT {d} FROM k)" for d in ("Variable", "tsen", "tvar", "month", "area"))
    return f"k AS (SELECT * FROM cells WHERE {where}), g AS (SELECT * FROM {dims}), f AS (SELECT * FROM g LEFT JOIN k USING (Variable, tsen, tvar, month, area))"


@query(
    "signed_importance",
    f"""WITH {_IMPORTANCES}, {_grid_sql("tsen = 'T1'")},
m AS (SELECT Variable, tvar, month, avg(coalesce(CASE WHEN a < 0 THEN 0 ELSE a END * CASE WHEN b > 25.5 THEN 1 WHEN b <= 25.5 THEN -1 END, 0)) AS v FROM f GROUP BY 1, 2, 3)
SELECT Variable AS "Predictor", tvar AS "T_var", {', '.join(f'{r(f"max(CASE WHEN month = {m} THEN v END)", 2)} AS "{K.MONTH_LABELS[m - 1]}"' for m in K.HYDRO_MONTHS)} FROM m GROUP BY 1, 2""",
)
def signed_importance(spark, sf_dir):
    return reports.signed_importance_table(_importances(spark, sf_dir), "T1")


@query(
    "weighted_signs",
    f"""WITH {_IMPORTANCES}, {_grid_sql("tsen = 'T3'")}, s AS (SELECT Variable, tvar, month, coalesce(CASE WHEN b > 25.5 THEN 1 WHEN b <= 25.5 THEN -1 END, 0) * CASE WHEN b IS NULL THEN 0 ELSE 1 END AS sg,
  coalesce(CASE WHEN a < 0 THEN 0 ELSE a END, 0) AS w FROM f)
SELECT Variable AS "Variable", tvar, month, {r('CASE WHEN sum(w) <> 0 THEN sum(sg * w) / sum(w) END', 5)} AS sign FROM s GROUP BY 1, 2, 3""",
)
def weighted_signs(spark, sf_dir):
    cells = reports.signed_cells(_importances(spark, sf_dir), "T3")
    return cells.groupBy("Variable", "tvar", "month").agg(
        round_to(weighted_mean("Sign_tstat", F.abs("Importance_perm_r2")), 5).alias("sign")
    )


@query(
    "importance_by_dimension",
    f"""WITH {_IMPORTANCES}, {_grid_sql("tsen <> 'T2'")}, z AS (SELECT * REPLACE (coalesce(a, 0) AS a) FROM f), o AS (
SELECT 'Variable' AS level, Variable, NULL AS tsen, NULL AS tvar, NULL AS month, avg(a) AS v FROM z GROUP BY Variable
UNION ALL SELECT 'Variable+tsen', Variable, tsen, NULL, NULL, avg(a) FROM z GROUP BY Variable, tsen
UNION ALL SELECT 'Variable+tvar', Variable, NULL, tvar, NULL, avg(a) FROM z GROUP BY Variable, tvar
UNION ALL SELECT 'Variable+month', Variable, NULL, NULL, month, avg(a) FROM z GROUP BY Variable, month)
SELECT level, Variable AS "Variable", tsen, tvar, CAST(month AS DOUBLE) AS month, {r('v', 2)} AS perm_r2 FROM o""",
)
def importance_by_dimension(spark, sf_dir):
    s = reports.importance_summary(_importances(spark, sf_dir))
    return s.select("level", "Variable", "tsen", "tvar", F.col("month").cast("double").alias("month"), "perm_r2")


_RANK = f"list_position(['{"','".join(K.PREDICTOR_LABELS.values())}'], Variable)"


@query(
    "stack_totals",
    f"""WITH {_IMPORTANCES}, c AS (SELECT area, tvar, month, Variable, CASE WHEN a < 0 THEN 0 ELSE a END AS v, {_RANK} AS rk FROM cells WHERE tsen = 'T4'),
t AS (SELECT *, sum(v) OVER (PARTITION BY area, tvar, month ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM c)
SELECT area, tvar, month, Variable AS "Variable", {r('v', 6)} AS "Importance", {r('top', 6)} AS top, {r('top - v', 6)} AS bottom FROM t""",
)
def stack_totals(spark, sf_dir):
    bars = reports.importance_bars(_importances(spark, sf_dir), "T4")
    return bars.select("area", "tvar", "month", "Variable", *rounded(["Importance", "top", "bottom"]))


_P_CLASS = "CASE WHEN p <= 0 THEN NULL WHEN p <= 0.001 THEN '< 0.001' WHEN p <= 0.01 THEN '0.01 - 0.001' WHEN p <= 0.05 THEN '0.05 - 0.01' WHEN p <= 0.1 THEN '0.1 - 0.05' WHEN p <= 0.5 THEN '0.5 - 0.1' ELSE '1 - 0.5' END"


@query(
    "p_class_bins",
    f"""SELECT class, count(*) AS n FROM (SELECT {_P_CLASS} AS class FROM
  (SELECT l_tax * l_discount * 10 AS p FROM lineitem UNION ALL SELECT l_tax FROM lineitem UNION ALL SELECT l_quantity / 50 FROM lineitem UNION ALL SELECT l_discount / 20 FROM lineitem)) GROUP BY 1""",
)
def p_class_bins(spark, sf_dir):
    values = F.array(
        F.col("l_tax") * F.col("l_discount") * 10, F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_discount") / 20
    )
    p = table(spark, sf_dir, "lineitem").select(F.explode(values).alias("p"))
    return p.groupBy(labels.p_class("p").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "effect_table",
    f"""WITH l AS (SELECT {area_sql('l_suppkey')} AS area, CAST(month(l_shipdate) AS INTEGER) AS month, l_linenumber AS resp, l_linestatus = 'O' AND l_partkey % 3 <> month(l_shipdate) % 3 AS mine, * FROM lineitem),
c AS (SELECT area, month, resp, avg(CASE WHEN mine THEN l_quantity END) AS e, avg(CASE WHEN mine THEN l_discount END) AS s, min(CASE WHEN mine THEN l_tax END) AS p FROM l GROUP BY 1, 2, 3)
SELECT area, month, resp, {r('e', 5)} AS estimate, {_P_CLASS} AS p_class, {r('e - s', 5)} AS lower, {r('e + s', 5)} AS upper FROM c""",
)
def effect_table(spark, sf_dir):
    mine = (F.col("l_linestatus") == "O") & (F.col("l_partkey") % 3 != F.month("l_shipdate") % 3)
    term = F.when(mine, K.EFFECT_PREDICTOR).otherwise("(Intercept)")
    coefs = table(spark, sf_dir, "lineitem").groupBy(
        area_of("l_suppkey").alias("area"), F.month("l_shipdate").alias("month"), F.col("l_linenumber").alias("resp"), term.alias("term")
    ).agg(F.avg("l_quantity").alias("estimate"), F.avg("l_discount").alias("std_error"), F.min("l_tax").alias("p_value"))
    e = reports.effect_table(coefs)
    return e.select("area", "month", "resp", *rounded(["estimate"], 5), "p_class", *rounded(["lower", "upper"], 5))


_EFFECT_CASE = "CASE tvar " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.EFFECT_LABELS.items()) + " ELSE tvar END"


@query(
    "effect_labels",
    f"""WITH l AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, {_label_sql(STATISTIC_OF, 'l_partkey')} AS tvar, l_quantity FROM lineitem)
SELECT month, {_EFFECT_CASE} AS label, {r('avg(l_quantity)', 5)} AS estimate FROM l GROUP BY 1, 2""",
)
def effect_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.month("l_shipdate").alias("month"), _label(STATISTIC_OF, F.col("l_partkey")).alias("tvar")
    ).agg(F.avg("l_quantity").alias("estimate"))
    return reports.effect_labels(rows).select("month", "label", *rounded(["estimate"], 5))


_GRADIENT = ["altitude", "snow_days", "tpi100", "moist_med", "canopy_cover2m_10m", "wetland_prop_100m", "water_prop_500m"]

_FIVE = {"mean": "avg({0})", "median": "median({0})", "min": "min({0})", "max": "max({0})", "range length": "max({0}) - min({0})"}


@query(
    "gradient_table",
    f"""WITH t AS (SELECT o_custkey AS id_code, {area_sql('c_nationkey')} AS area, month(o_orderdate) AS month, c_acctbal / 100 AS altitude, CAST(c_nationkey AS DOUBLE) AS snow_days,
  CAST(o_custkey % 11 AS DOUBLE) AS tpi100, o_totalprice / 10000 AS moist_med, CAST(o_custkey % 90 AS DOUBLE) AS canopy_cover2m_10m, CAST(o_custkey % 30 AS DOUBLE) AS wetland_prop_100m,
  CAST(o_custkey % 17 AS DOUBLE) AS water_prop_500m, c_acctbal * month(o_orderdate) AS pisr FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) IN (1, 7)),
c AS (SELECT id_code, area, {', '.join(_GRADIENT)}, max(CASE WHEN month = 1 THEN pisr / 3600 END) AS pisr_Jan, max(CASE WHEN month = 7 THEN pisr / 3600 END) AS pisr_Jul FROM t GROUP BY ALL),
s AS (SELECT id_code, area, {', '.join(f'avg({c}) AS {c}' for c in [*_GRADIENT, 'pisr_Jan', 'pisr_Jul'])} FROM c GROUP BY 1, 2),
"""
    + "z AS ("
    + " UNION ALL ".join(
        f"SELECT area, '{stat}' AS stat, "
        + ", ".join(f'{r(expr.format(c), K.GRADIENT_DECIMALS[c])} AS "{label}"' for c, label in K.GRADIENT_LABELS.items())
        + " FROM s GROUP BY area"
        for stat, expr in _FIVE.items()
    ) + ") SELECT * FROM z",
)
def gradient_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_custkey")
    rows = o.select(
        key.alias("id_code"), area_of("c_nationkey").alias("area"), F.month("o_orderdate").alias("month"),
        (F.col("c_acctbal") / 100).alias("altitude"), F.col("c_nationkey").cast("double").alias("snow_days"),
        (key % 11).cast("double").alias("tpi100"), (F.col("o_totalprice") / 10000).alias("moist_med"),
        (key % 90).cast("double").alias("canopy_cover2m_10m"), (key % 30).cast("double").alias("wetland_prop_100m"),
        (key % 17).cast("double").alias("water_prop_500m"), (F.col("c_acctbal") * F.month("o_orderdate")).alias("pisr"),
    )
    return reports.gradient_table(rows).drop("area_rank")
