"""Queries on grouped models, importances, imputation, correlation and smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.base import area_of, area_sql, query, r, r_list, rounded, table
from sensorframe import constants as K
from sensorframe.functions.nulls import round_to
from sensorframe.operators import features, importance, loess, mixed, ols, rank_corr, reshape
from sensorframe.plans import modelling

CELL = ["l_returnflag", "month"]
TWO = ["l_quantity", "l_discount"]

# A response with a known signal and a repeatable disturbance.
_SIGNAL = "2 + 3 * l_quantity - 40 * l_discount + CAST((l_partkey * 7919) % 1000 AS DOUBLE) / 100"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.month("l_shipdate").alias("month"), "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        F.expr(_SIGNAL).alias("y"),
    )


_LINES = f"""WITH l AS (SELECT l_returnflag, CAST(month(l_shipdate) AS INTEGER) AS month, l_quantity, l_discount, l_tax, l_extendedprice, {_SIGNAL} AS y FROM lineitem)"""

# Two-predictor least squares from centred sums; m1 and m2 are the predictor means.
_FIT2 = f"""{_LINES},
s AS (SELECT l_returnflag, month, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(y) AS my,
  var_pop(l_quantity) * count(*) AS s11, var_pop(l_discount) * count(*) AS s22, covar_pop(l_quantity, l_discount) * count(*) AS s12,
  covar_pop(y, l_quantity) * count(*) AS s1y, covar_pop(y, l_discount) * count(*) AS s2y, var_pop(y) * count(*) AS syy FROM l GROUP BY 1, 2),
d AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM s),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM d),
f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, syy - b1 * s1y - b2 * s2y AS rss FROM b),
v AS (SELECT *, rss / (n - 3) AS s2, 1 - rss / syy AS r2 FROM f),
e AS (SELECT *, sqrt(s2 * s22 / det) AS e1, sqrt(s2 * s11 / det) AS e2,
  sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS e0 FROM v),
c AS (SELECT l_returnflag, month, '(Intercept)' AS term, b0 AS estimate, e0 AS std_error FROM e
  UNION ALL SELECT l_returnflag, month, 'l_quantity', b1, e1 FROM e UNION ALL SELECT l_returnflag, month, 'l_discount', b2, e2 FROM e)"""


def _cells(spark, sf_dir, predictors=TWO, response="y"):
    return ols.moments(_lines(spark, sf_dir), CELL, response, predictors)


@query(
    "trend_lines",
    f"""{_LINES} SELECT month, {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept,
  {r('regr_r2(l_extendedprice, l_quantity)', 6)} AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM l GROUP BY 1""",
)
def trend_lines(spark, sf_dir):
    t = ols.trend_lines(_lines(spark, sf_dir), ["month"], "l_quantity", "l_extendedprice")
    return t.select("month", round_to("slope", 4).alias("slope"), round_to("intercept", 2).alias("intercept"), *rounded(["r2"]), "n")


@query(
    "grouped_ols_1",
    f"""{_LINES}, c AS (SELECT l_returnflag, month, '(Intercept)' AS term, regr_intercept(l_extendedprice, l_quantity) AS estimate FROM l GROUP BY 1, 2
UNION ALL SELECT l_returnflag, month, 'l_quantity', regr_slope(l_extendedprice, l_quantity) FROM l GROUP BY 1, 2)
SELECT l_returnflag, month, term, {r('estimate', 3)} AS estimate FROM c""",
)
def grouped_ols_1(spark, sf_dir):
    c = ols.coefficients(_cells(spark, sf_dir, ["l_quantity"], "l_extendedprice"), CELL, ["l_quantity"])
    return c.select(*CELL, "term", *rounded(["estimate"], 3))


@query(
    "grouped_ols_2",
    f"""{_FIT2} SELECT l_returnflag, month, {r('b0', 5)} AS intercept, {r('b1', 6)} AS quantity, {r('b2', 5)} AS discount, n FROM e""",
)
def grouped_ols_2(spark, sf_dir):
    m = ols.models(_cells(spark, sf_dir), CELL, TWO)
    b, mean = F.col("beta"), F.col("means")
    return m.select(
        *CELL,
        round_to(mean[2] - b[0] * mean[0] - b[1] * mean[1], 5).alias("intercept"),
        round_to(b[0], 6).alias("quantity"),
        round_to(b[1], 5).alias("discount"),
        F.col("nobs").alias("n"),
    )


@query(
    "ols_tidy",
    f"""{_FIT2} SELECT l_returnflag, month, term, {r('estimate', 5)} AS estimate, {r('std_error', 6)} AS std_error,
  {r('estimate / std_error', 4)} AS statistic FROM c""",
)
def ols_tidy(spark, sf_dir):
    c = ols.coefficients(_cells(spark, sf_dir), CELL, TWO)
    return c.select(*CELL, "term", *rounded(["estimate"], 5), *rounded(["std_error"]), *rounded(["statistic"], 4))


@query("ols_p_values")
def ols_p_values(spark, sf_dir):
    c = ols.coefficients(_cells(spark, sf_dir, [*TWO, "l_tax"], "l_extendedprice"), CELL, [*TWO, "l_tax"])
    return c.select(*CELL, "term", *rounded(["p_value"], 6))


@query(
    "ols_glance",
    f"""{_FIT2} SELECT l_returnflag, month, {r('r2', 7)} AS r_squared, {r('1 - (1 - r2) * (n - 1) / (n - 3)', 7)} AS adj_r_squared,
  {r('sqrt(s2)', 6)} AS sigma, {r('(syy - rss) / 2 / s2', 2)} AS statistic, CAST(2 AS DOUBLE) AS df,
  {r('-0.5 * n * (ln(2 * pi()) + 1 + ln(rss / n))', 4)} AS log_lik, {r('n * (ln(2 * pi()) + 1 + ln(rss / n)) + 8', 4)} AS aic,
  {r('n * (ln(2 * pi()) + 1 + ln(rss / n)) + 4 * ln(n)', 4)} AS bic, {r('rss', 4)} AS deviance, n - 3 AS df_residual, n AS nobs FROM e""",
)
def ols_glance(spark, sf_dir):
    g = ols.fit_summaries(_cells(spark, sf_dir), CELL, TWO)
    return g.select(
        *CELL, *rounded(["r_squared", "adj_r_squared"], 7), *rounded(["sigma"]), *rounded(["statistic"], 2), "df",
        *rounded(["log_lik", "aic", "bic", "deviance"], 4), "df_residual", "nobs",
    )


def _pair_sql(x1: str, x2: str, y: str) -> str:
    """The two-predictor fit for other columns."""
    body = _FIT2[len(_LINES):].replace("l_quantity", "{x1}").replace("l_discount", "{x2}")
    for call in ("avg(y)", "var_pop(y)", "covar_pop(y,"):
        body = body.replace(call, call.replace("(y", "({y}"))
    return _LINES + body.format(x1=x1, x2=x2, y=y)


_PAIR = ["l_discount", "l_tax"]

# Two-sided tail of t for whole degrees of freedom nu, as a finite series in the angle th; odd and even apart.
_T_TAIL = """CASE WHEN nu % 2 = 0
  THEN 1 - sin(th) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(th), 2 * k) for k in range(nu // 2)])
  ELSE 1 - 2 / pi() * (th + sin(th) * list_sum([exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * k + 1) for k in range((nu - 1) // 2)])) END"""


@query(
    "ols_p_values_pair",
    f"""{_pair_sql(*_PAIR, 'l_extendedprice')}, t AS (SELECT l_returnflag, month, term, n - 3 AS nu, atan(abs(estimate / std_error) / sqrt(n - 3)) AS th
  FROM c JOIN (SELECT l_returnflag, month, n FROM e) USING (l_returnflag, month))
SELECT l_returnflag, month, term, {r(_T_TAIL, 6)} AS p_value FROM t""",
)
def ols_p_values_pair(spark, sf_dir):
    c = ols.coefficients(_cells(spark, sf_dir, _PAIR, "l_extendedprice"), CELL, _PAIR)
    return c.select(*CELL, "term", *rounded(["p_value"], 6))


@query(
    "ols_glance_p_value",
    f"""{_pair_sql(*_PAIR, 'l_extendedprice')} SELECT l_returnflag, month, {r('pow(1 + 2 * ((syy - rss) / 2 / s2) / (n - 3), -(n - 3) / 2)', 6)} AS p_value FROM e""",
)
def ols_glance_p_value(spark, sf_dir):
    g = ols.fit_summaries(_cells(spark, sf_dir, _PAIR, "l_extendedprice"), CELL, _PAIR)
    return g.select(*CELL, *rounded(["p_value"], 6))


_STEP = f"""{_LINES}, s AS (SELECT l_returnflag, month, count(*) AS n, var_pop(l_discount) AS s11, var_pop(l_tax) AS s22, covar_pop(l_discount, l_tax) AS s12,
  covar_pop(l_extendedprice, l_discount) AS s1y, covar_pop(l_extendedprice, l_tax) AS s2y, var_pop(l_extendedprice) AS syy FROM l GROUP BY 1, 2),
a AS (SELECT *, n * ln(syy) + 2 AS a0, n * ln(syy - s1y * s1y / s11) + 4 AS a1, n * ln(syy - s2y * s2y / s22) + 4 AS a2,
  n * ln(syy - (s22 * s1y * s1y - 2 * s12 * s1y * s2y + s11 * s2y * s2y) / (s11 * s22 - s12 * s12)) + 6 AS a12 FROM s)"""


@query(
    "stepwise",
    f"""{_STEP} SELECT l_returnflag, month, CASE WHEN a12 <= least(a1, a2) THEN 'l_discount+l_tax'
  WHEN a1 <= a2 THEN CASE WHEN a0 < a1 THEN '' ELSE 'l_discount' END ELSE CASE WHEN a0 < a2 THEN '' ELSE 'l_tax' END END AS chosen FROM a""",
)
def stepwise(spark, sf_dir):
    names = ["l_discount", "l_tax"]
    c = ols.coefficients(_cells(spark, sf_dir, names, "l_extendedprice"), CELL, names, step=True)
    slopes = F.array_sort(F.collect_set(F.when(F.col("term") != ols.INTERCEPT, F.col("term"))))
    return c.groupBy(*CELL).agg(F.array_join(slopes, "+").alias("chosen"))


@query(
    "vi_tstat",
    f"""{_FIT2} SELECT l_returnflag, month, term AS "Variable", {r('abs(estimate / std_error)', 4)} AS "Importance",
  CASE WHEN estimate > 0 THEN 'POS' ELSE 'NEG' END AS "Sign" FROM c WHERE term <> '(Intercept)'""",
)
def vi_tstat(spark, sf_dir):
    v = importance.t_importance(ols.coefficients(_cells(spark, sf_dir), CELL, TWO), CELL)
    return v.select(*CELL, "Variable", *rounded(["Importance"], 4), "Sign")


@query(
    "vi_firm",
    f"""{_FIT2}, x AS (SELECT l_returnflag, month, 'l_quantity' AS term, min(l_quantity) AS lo, max(l_quantity) AS hi, least(count(DISTINCT l_quantity), 51) AS m FROM l GROUP BY 1, 2
  UNION ALL SELECT l_returnflag, month, 'l_discount', min(l_discount), max(l_discount), least(count(DISTINCT l_discount), 51) FROM l GROUP BY 1, 2)
SELECT l_returnflag, month, term AS "Variable", {r('abs(estimate) * (hi - lo) / (m - 1) * sqrt(m * (m + 1) / 12)', 5)} AS "Importance"
FROM c JOIN x USING (l_returnflag, month, term)""",
)
def vi_firm(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    coefs = ols.coefficients(_cells(spark, sf_dir), CELL, TWO)
    v = importance.pdp_importance(coefs, importance.predictor_ranges(lines, CELL, "y", TWO), CELL)
    return v.select(*CELL, "Variable", *rounded(["Importance"], 5))


def _permutation(spark, sf_dir, metric):
    fitted = ols.models(_cells(spark, sf_dir), CELL, TWO)
    permuted = importance.permuted_moments(_lines(spark, sf_dir), CELL, "y", TWO)
    v = importance.permutation_importance(fitted, permuted, CELL, TWO, metric)
    return v.select(*CELL, "Variable", *rounded(["Importance", "StDev"], 5), "method")


def _partners_sql(seed: int = 1) -> str:
    """CTEs ``w0`` .. ``w8``: the same bijection, walked up to eight times, on rows ``num`` (cell, i, n, values)."""
    keep = "l_returnflag, month, sim, n, a, own"
    out = """num AS (SELECT l_returnflag, month, l_quantity AS x1, l_discount AS x2, y,
    row_number() OVER (PARTITION BY l_returnflag, month ORDER BY l_quantity, l_discount, y) - 1 AS own,
    count(*) OVER (PARTITION BY l_returnflag, month) AS n FROM l),
w0 AS (SELECT l_returnflag, month, sim, n, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a, own, own AS i
  FROM num, (SELECT unnest(range(1, 11)) AS sim))"""
    for walk in range(8):
        inner = f"SELECT {keep}, i AS before, i // a AS l, i % a AS r FROM w{walk}"
        for turn in range(importance.ROUNDS):
            y = f"((r * {importance.FACTOR} + sim * {importance.STEP} + {turn * importance.LEAP + seed}) % {importance.PRIME})"
            mixed = f"(({y} * {y} + {y} * {turn + 1}) % {importance.PRIME})"
            inner = f"SELECT {keep}, before, r AS l, (l + {mixed}) % a AS r FROM ({inner})"
        moved = "l * a + r" if walk == 0 else "CASE WHEN before < n THEN before ELSE l * a + r END"
        out += f",\nw{walk + 1} AS (SELECT {keep}, {moved} AS i FROM ({inner}))"
    return out


def _permutation_sql(metric: str) -> str:
    full = "power(corr(y, b0 + b1 * x1 + b2 * x2), 2)" if metric == "perm_r2" else "sqrt(avg(power(y - b0 - b1 * x1 - b2 * x2, 2)))"

    def moved(x1: str, x2: str) -> str:
        fit = f"b0 + b1 * {x1} + b2 * {x2}"
        return f"power(corr(y, {fit}), 2)" if metric == "perm_r2" else f"sqrt(avg(power(y - ({fit}), 2)))"

    drop = "f - s" if metric == "perm_r2" else "s - f"
    return f"""{_FIT2}, {_partners_sql()},
met AS (SELECT w.l_returnflag, w.month, w.sim, o.x1, o.x2, o.y, p.x1 AS p1, p.x2 AS p2 FROM w8 w
  JOIN num o ON o.l_returnflag = w.l_returnflag AND o.month = w.month AND o.own = w.own
  JOIN num p ON p.l_returnflag = w.l_returnflag AND p.month = w.month AND p.own = w.i),
pv AS (SELECT l_returnflag, month, sim, {full} AS f, {moved('p1', 'x2')} AS s1, {moved('x1', 'p2')} AS s2
  FROM met JOIN (SELECT l_returnflag, month, b0, b1, b2 FROM e) USING (l_returnflag, month) GROUP BY 1, 2, 3),
u AS (SELECT l_returnflag, month, 'l_quantity' AS var, f, s1 AS s FROM pv UNION ALL SELECT l_returnflag, month, 'l_discount', f, s2 FROM pv)
SELECT l_returnflag, month, var AS "Variable", {r(f'avg({drop})', 5)} AS "Importance", {r(f'stddev_samp({drop})', 5)} AS "StDev", '{metric}' AS method
FROM u GROUP BY 1, 2, 3"""


@query("vi_permute_r2", _permutation_sql("perm_r2"))
def vi_permute_r2(spark, sf_dir):
    return _permutation(spark, sf_dir, "perm_r2")


@query("vi_permute_rmse", _permutation_sql("perm_rmse"))
def vi_permute_rmse(spark, sf_dir):
    return _permutation(spark, sf_dir, "perm_rmse")


SPEAR = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _spearman_sql() -> str:
    ranks = ", ".join(
        f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2 AS r_{c}"
        for c in SPEAR
    )
    pairs = " UNION ALL ".join(
        f"SELECT l_returnflag, count(*) AS n, '{a}' AS x, '{b}' AS y, {r(f'corr(r_{a}, r_{b})', 6)} AS rho FROM k GROUP BY 1"
        for a in SPEAR
        for b in SPEAR
    )
    return f"{_LINES}, k AS (SELECT l_returnflag, {ranks} FROM l) {pairs}"


@query("spearman_matrix", _spearman_sql())
def spearman_matrix(spark, sf_dir):
    m = rank_corr.spearman(_lines(spark, sf_dir), ["l_returnflag"], SPEAR)
    return m.select("l_returnflag", "n", "x", "y", *rounded(["rho"]))


_RADIATION = [f"pisr_m{m}_50m" for m in range(1, 13)]


def _sites(spark, sf_dir):
    """Customers as sites with twelve radiation columns and an altitude."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id_code"),
        area_of("c_nationkey").alias("area"),
        F.col("c_acctbal").alias("altitude"),
        (F.col("c_acctbal") / 50).alias("pgaps_a"),
        F.col("c_nationkey").cast("double").alias("tpi100"),
        *[(F.col("c_acctbal") * m).alias(c) for m, c in enumerate(_RADIATION, 1)],
    )


@query(
    "month_from_name",
    f"""WITH s AS (SELECT c_custkey AS id_code, {', '.join(f'c_acctbal * {m} AS {c}' for m, c in enumerate(_RADIATION, 1))} FROM customer)
SELECT id_code, CAST(regexp_extract(name, '_m([0-9]+)_', 1) AS INTEGER) AS month, {r('pisr', 4)} AS pisr FROM (FROM s UNPIVOT INCLUDE NULLS (pisr FOR name IN ({', '.join(_RADIATION)})))""",
)
def month_from_name(spark, sf_dir):
    return features.monthly_radiation(_sites(spark, sf_dir)).select("id_code", "month", *rounded(["pisr"], 4))


def _model_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sites = _sites(spark, sf_dir)
    rows = orders.join(sites.select("id_code", "area"), F.col("o_custkey") == F.col("id_code"))
    monthly = rows.groupBy("id_code", "area", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.avg("o_totalprice").alias("T1_mean"), F.max("o_totalprice").alias("T1_absmax")
    )
    moisture = rows.groupBy("id_code", "area", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.avg(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 10)).alias("moist_med")
    )
    snow = rows.groupBy("id_code", "area").agg(F.count_if(F.col("o_orderpriority") == "5-LOW").cast("double").alias("snow_days"))
    return features.model_table(
        monthly, features.monthly_radiation(sites), moisture, snow, features.site_covariates(sites), ["T1_mean", "T1_absmax"]
    )


_MODEL_TABLE_SQL = f"""WITH s AS (SELECT c_custkey AS id_code, {area_sql('c_nationkey')} AS area, c_acctbal, CAST(c_nationkey AS DOUBLE) AS tpi100 FROM customer),
o AS (SELECT s.*, year(o_orderdate) AS year, month(o_orderdate) AS month, o_totalprice, o_orderstatus, o_orderpriority FROM orders JOIN s ON o_custkey = id_code),
m AS (SELECT id_code, area, year, month, avg(o_totalprice) AS T1_mean, max(o_totalprice) AS T1_absmax,
  avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 10 END) AS moist_med FROM o GROUP BY 1, 2, 3, 4),
w AS (SELECT id_code, count(*) FILTER (o_orderpriority = '5-LOW') AS snow_days FROM o GROUP BY 1),
mt AS (SELECT m.id_code, m.area, m.year, m.month, T1_mean, T1_absmax, c_acctbal * m.month AS pisr, moist_med, snow_days, c_acctbal / 100 AS altitude, tpi100
  FROM m LEFT JOIN w USING (id_code) LEFT JOIN s USING (id_code))"""
_MODEL_COLUMNS = ["T1_mean", "T1_absmax", "pisr", "moist_med", "snow_days", "altitude", "tpi100"]


@query(
    "model_table",
    f"""{_MODEL_TABLE_SQL} SELECT id_code, area, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, {r_list(_MODEL_COLUMNS, 3)} FROM mt""",
)
def model_table(spark, sf_dir):
    return _model_table(spark, sf_dir).select("id_code", "area", "year", "month", *rounded(_MODEL_COLUMNS, 3))


@query(
    "wide_prefixed_mean",
    f"""{_MODEL_TABLE_SQL}, c AS (SELECT id_code, area, moist_med, max(CASE WHEN month = 1 THEN pisr / 3600 END) AS pisr_Jan, max(CASE WHEN month = 7 THEN pisr / 3600 END) AS pisr_Jul
  FROM mt WHERE month IN (1, 7) GROUP BY 1, 2, 3)
SELECT id_code, area, {r('avg(moist_med)', 3)} AS moist_med, {r('avg(pisr_Jan)', 5)} AS "pisr_Jan", {r('avg(pisr_Jul)', 5)} AS "pisr_Jul" FROM c GROUP BY 1, 2""",
)
def wide_prefixed_mean(spark, sf_dir):
    rows = _model_table(spark, sf_dir).filter(F.col("month").isin(1, 7)).withColumn("pisr", F.col("pisr") / K.KJ_PER_KWH)
    wide = reshape.to_wide(rows, ["id_code", "area", "moist_med"], "month", ["pisr"], [1, 7], prefix="pisr_")
    wide = wide.withColumnsRenamed({"pisr_1": "pisr_Jan", "pisr_7": "pisr_Jul"})
    means = reshape.double_means(wide, ["id_code", "area"])
    return means.select("id_code", "area", *rounded(["moist_med"], 3), *rounded(["pisr_Jan", "pisr_Jul"], 5))


def _months_of(spark, sf_dir):
    """Orders per customer as site values of an area, with year and month."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_custkey").alias("id_code"), F.col("c_nationkey").alias("area"), F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"), (F.col("o_totalprice") / 1000).alias("moist_med"),
    )


@query("mixed_impute")
def mixed_impute(spark, sf_dir):
    rows = _months_of(spark, sf_dir)
    every = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_custkey").alias("id_code"))
    months = F.explode(F.sequence(F.lit(1), F.lit(12)))
    targets = every.withColumn("year", F.lit(1998)).withColumn("month", months)
    return mixed.impute_gaussian(rows, targets, "area", "id_code", "moist_med", ["year", "month"], 2)


# Stationary points of the Laplace likelihood by fixed-point steps: a unit's mode moves by a Newton step, a level by the
# ratio of counted to expected, the variance by the ratio of its two terms. ``c`` has rows area, id_code, lvl, cnt.
def _poisson_sql(rounds: int = 400) -> str:
    unit, level = "PARTITION BY area, id_code", "PARTITION BY area, lvl"
    return f"""z AS (SELECT area, id_code, lvl, cnt, sum(cnt) OVER ({unit}) AS total, count(*) OVER ({unit}) AS k,
    sum(cnt) OVER ({level}) AS seen, count(*) OVER ({level}) AS n FROM c),
i AS (SELECT area, id_code, lvl, total, k, seen, 0 AS turn, ln(CAST(seen AS DOUBLE) / n) AS beta, CAST(0 AS DOUBLE) AS u, CAST(0.09 AS DOUBLE) AS v FROM z
  UNION ALL SELECT area, id_code, lvl, total, k, seen, turn + 1, beta + ln(seen / sum((1 + v * w * w / 2) * el) OVER ({level})), u,
    greatest(v * (sum(u * u / v / k) OVER (PARTITION BY area)) / (sum(v * e * w * (1 + u * w) / k) OVER (PARTITION BY area)), exp(CAST(-24 AS DOUBLE)))
  FROM (SELECT *, 1 / (1 + v * e) AS w FROM (SELECT *, sum(el) OVER ({unit}) AS e FROM (SELECT *, exp(beta + u) AS el FROM (
    SELECT area, id_code, lvl, total, k, seen, turn, beta, v, u + greatest(least((total - e0 - u / v) / (e0 + 1 / v), 2), -2) AS u
    FROM (SELECT *, sum(exp(beta + u)) OVER ({unit}) AS e0 FROM i WHERE turn < {rounds})))))),
f AS (SELECT * FROM i WHERE turn = {rounds}),
b AS (SELECT area, lvl, any_value(beta) AS beta FROM f GROUP BY 1, 2), x AS (SELECT area, id_code, any_value(u) AS u FROM f GROUP BY 1, 2)"""


@query(
    "poisson_mixed_impute",
    f"""WITH RECURSIVE c AS (SELECT c_nationkey AS area, o_custkey AS id_code, year(o_orderdate) AS lvl, count(*) AS cnt
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
{_poisson_sql()}
SELECT c_nationkey AS area, c_custkey AS id_code, CAST(1998 AS INTEGER) AS year, {r('exp(beta + coalesce(u, 0))', 0)} AS n_orders,
  CASE WHEN c_nationkey IN (SELECT area FROM b) THEN true END AS converged
FROM customer LEFT JOIN b ON b.area = c_nationkey AND lvl = 1998 LEFT JOIN x ON x.area = c_nationkey AND x.id_code = c_custkey""",
)
def poisson_mixed_impute(spark, sf_dir):
    counts = _months_of(spark, sf_dir).groupBy("area", "id_code", "year").agg(F.count(F.lit(1)).alias("n_orders"))
    every = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("area"), F.col("c_custkey").alias("id_code"))
    targets = every.withColumn("year", F.lit(1998))
    return mixed.impute_poisson(counts, targets, "area", "id_code", "n_orders", "year")


_SPREAD_COUNTS = "1 + o_custkey % 4 * 2"


@query(
    "poisson_mixed_spread",
    f"""WITH RECURSIVE c AS (SELECT c_nationkey AS area, o_custkey AS id_code, year(o_orderdate) AS lvl, sum({_SPREAD_COUNTS}) AS cnt
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
{_poisson_sql()}
SELECT x.area, x.id_code, {r('u', 3)} AS effect FROM x""",
)
def poisson_mixed_spread(spark, sf_dir):
    """Unit effects of counts that differ more between units than chance makes them."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = o.groupBy(F.col("c_nationkey").alias("area"), F.col("o_custkey").alias("id_code"), F.year("o_orderdate").alias("year"))
    counts = counts.agg(F.sum(F.expr(_SPREAD_COUNTS)).alias("cnt"))
    _, effects = mixed.poisson_fit(counts, "area", "id_code", "cnt", "year")
    return effects.select("area", "id_code", *rounded(["effect"], 3))


_BALANCED = "avg(l_extendedprice) / 1000 + any_value(l_suppkey % 8 * 3 % 7) / 2"


@query(
    "mixed_impute_balanced",
    f"""WITH a AS (SELECT l_linenumber AS area, CAST(l_suppkey % 8 AS INTEGER) AS unit, CAST(year(l_shipdate) AS INTEGER) AS year,
    CAST(month(l_shipdate) AS INTEGER) AS month, {_BALANCED} AS y FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3, 4),
c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY area, unit) AS cells FROM a) WHERE cells = 60),
m AS (SELECT *, avg(y) OVER (PARTITION BY area) AS g, avg(y) OVER (PARTITION BY area, unit) AS um,
  avg(y) OVER (PARTITION BY area, year) AS ym, avg(y) OVER (PARTITION BY area, month) AS mm FROM c),
s AS (SELECT area, any_value(g) AS g, count(DISTINCT unit) AS units, sum(power(y - um - ym - mm + 2 * g, 2)) AS ssw, sum(power(um - g, 2)) AS ssb FROM m GROUP BY 1),
v AS (SELECT *, greatest(0, (ssb / 60 / (units - 1)) / (ssw / (units * 59 - 15)) - 1 / CAST(60 AS DOUBLE)) AS ratio FROM s),
e AS (SELECT area, unit, any_value(60 * ratio / (1 + 60 * ratio) * (um - m.g)) AS effect FROM m JOIN v USING (area) GROUP BY 1, 2),
t AS (SELECT DISTINCT area, unit FROM a UNION ALL SELECT DISTINCT area, 99 FROM a),
f AS (SELECT DISTINCT area, month, ym + mm - g AS fixed FROM m WHERE year = 1998)
SELECT t.area, t.unit, CAST(1998 AS INTEGER) AS year, f.month, {r('fixed + coalesce(effect, 0)', 2)} AS y, true AS converged
FROM t JOIN f USING (area) LEFT JOIN e ON e.area = t.area AND e.unit = t.unit""",
)
def mixed_impute_balanced(spark, sf_dir):
    """Units with all months of five years, for which the variance ratio has a closed form."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"year": F.year("l_shipdate"), "month": F.month("l_shipdate")})
    keys = [F.col("l_linenumber").alias("area"), (F.col("l_suppkey") % 8).cast("int").alias("unit"), "year", "month"]
    cells = lines.filter(F.col("year").between(1996, 2000)).groupBy(*keys).agg(F.expr(_BALANCED).alias("y"))
    whole = cells.groupBy("area", "unit").agg(F.count(F.lit(1)).alias("cells")).filter("cells = 60").drop("cells")
    units = cells.select("area", "unit").distinct()
    units = units.unionByName(units.select("area").distinct().withColumn("unit", F.lit(99)))
    targets = units.withColumn("year", F.lit(1998)).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return mixed.impute_gaussian(cells.join(whole, ["area", "unit"]), targets, "area", "unit", "y", ["year", "month"], 2)


def _daily_prices(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("price")
    ).withColumn("x", F.unix_date("date").cast("double"))


def loess_sql(source: str, span: float) -> str:
    """CTEs up to ``fits`` (k, j, g, fit) from a CTE ``p`` (k, x, y)."""
    fit = "(t0 * (s2 * s4 - s3 * s3) + t1 * (s2 * s3 - s1 * s4) + t2 * (s1 * s3 - s2 * s2)) / (s0 * (s2 * s4 - s3 * s3) + s1 * (s2 * s3 - s1 * s4) + s2 * (s1 * s3 - s2 * s2))"
    return f"""WITH {source},
e AS (SELECT k, min(x) AS lo, max(x) AS hi, count(*) AS n FROM p GROUP BY 1),
g AS (SELECT k, j, lo + (hi - lo) / 79 * j AS g, n FROM e, (SELECT unnest(range(80)) AS j)),
d AS (SELECT k, j, g, x - g AS d, y, row_number() OVER (PARTITION BY k, j ORDER BY abs(x - g)) AS rn, floor(n * CAST({span} AS DOUBLE) + 1e-5) AS q FROM p JOIN g USING (k)),
h AS (SELECT k, j, max(abs(d)) AS h FROM d WHERE rn <= q GROUP BY 1, 2),
w AS (SELECT k, j, g, y, d / h AS u, pow(1 - pow(abs(d / h), 3), 3) AS w FROM d JOIN h USING (k, j) WHERE abs(d) < h),
s AS (SELECT k, j, g, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
  sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM w GROUP BY 1, 2, 3),
fits AS (SELECT k, j, g, {fit} AS fit FROM s)"""


_PRICES = "p AS (SELECT o_orderstatus AS k, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2)"


@query("loess", f"""{loess_sql(_PRICES, 0.3)} SELECT k AS o_orderstatus, {r('g', 4)} AS x, {r('fit', 1)} AS fit FROM fits""")
def loess_curve(spark, sf_dir):
    curve = loess.loess(_daily_prices(spark, sf_dir), ["o_orderstatus"], "x", "price", span=0.3)
    return curve.select("o_orderstatus", round_to("x", 4).alias("x"), *rounded(["fit"], 1))


@query("loess_band")
def loess_band(spark, sf_dir):
    return loess.loess(_daily_prices(spark, sf_dir), ["o_orderstatus"], "x", "price", span=0.3, se=True)


# Site properties from the customer's number: a multiplier and a modulus each.
_SITE_NUMBERS = {
    "snow_days": (48_271, 200), "tpi100": (16_807, 21), "water_prop_500m": (69_621, 30), "canopy_cover2m_10m": (39_373, 90),
}


def _site_number(multiplier: int, modulus: int) -> str:
    """A whole number that varies from site to site, the same in any engine."""
    return f"CAST((c_custkey * {multiplier}) % 104729 % {modulus} AS DOUBLE)"


_SITE = _site_number(7919, 1000)


def _study(spark, sf_dir):
    """Sites, months and covariates of a full study derived from orders and customers."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    site = F.expr(_SITE)
    price, month = F.col("o_totalprice") / 10000, F.month("o_orderdate")
    base = o.select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("id_code"),
        area_of("c_nationkey").alias("area"),
        month.alias("month"),
        (site / 100).alias("altitude"),
        (site * month / 50).alias("pisr"),
        (F.col("c_acctbal") / 1000).alias("wetland_prop_100m"),
        *[F.expr(_site_number(*v)).alias(c) for c, v in _SITE_NUMBERS.items()],
        (F.col("o_orderkey") % 60).cast("double").alias("moist_med"),
        price.alias("noise"),
    )
    signal = 5 - F.col("altitude") - F.col("canopy_cover2m_10m") / 30 + F.col("moist_med") / 20 + F.col("noise") / 10
    responses = {c: signal - F.col("snow_days") / (50 + 5 * i) for i, c in enumerate(modelling.RESPONSES)}
    return base.withColumns(responses).drop("noise")


def _windows(spark, sf_dir):
    dates = table(spark, sf_dir, "customer").select(area_of("c_nationkey").alias("area")).distinct()
    return dates.select(
        "area", F.lit("2019-10-28").cast("date").alias("first_snow_date"), F.lit("2020-05-04").cast("date").alias("last_snow_date")
    )


def _fits(spark, sf_dir, name):
    results = modelling.fit_models(_study(spark, sf_dir), _windows(spark, sf_dir), wanted=[name.split("_")[0]])
    return results[name]


@query("study_coefficients")
def study_coefficients(spark, sf_dir):
    return _fits(spark, sf_dir, "coef_step")


@query("study_coefficients_full")
def study_coefficients_full(spark, sf_dir):
    return _fits(spark, sf_dir, "coef")


@query("study_summaries")
def study_summaries(spark, sf_dir):
    return _fits(spark, sf_dir, "summ_step")


@query("study_summaries_full")
def study_summaries_full(spark, sf_dir):
    return _fits(spark, sf_dir, "summ")


@query("study_importances")
def study_importances(spark, sf_dir):
    return _fits(spark, sf_dir, "vi_step")


@query("study_importances_full")
def study_importances_full(spark, sf_dir):
    return _fits(spark, sf_dir, "vi")


def _snow_seasons(spark, sf_dir):
    """Late orders per customer and year as snow days of a season."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(
        area_of("c_nationkey").alias("area"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("id_code"),
        (F.year("o_orderdate") + (K.SNOW_YEAR - 1998)).alias("hydro_year"),
    ).agg(F.count(F.lit(1)).cast("int").alias("snow_days"))


def _study_sites(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("id_code"), area_of("c_nationkey").alias("area")
    )


@query("impute_snow")
def impute_snow(spark, sf_dir):
    return modelling.impute_snow(_snow_seasons(spark, sf_dir), _study_sites(spark, sf_dir))


@query("impute_moisture")
def impute_moisture(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    moisture = o.groupBy(
        area_of("c_nationkey").alias("area"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("id_code"),
        (F.year("o_orderdate") + (K.STUDY_YEAR - 1997)).alias("year"), F.month("o_orderdate").alias("month"),
    ).agg(F.lit(1.0).alias("moist_prop"), (F.avg("o_totalprice") / 1000).alias("moist_med"))
    return modelling.impute_moisture(moisture, _study_sites(spark, sf_dir))


def _study_correlations_sql() -> str:
    columns = {
        "altitude": f"{_SITE} / 100", "pisr": f"{_SITE} * month(o_orderdate) / 50", "wetland_prop_100m": "c_acctbal / 1000",
        "moist_med": "CAST(o_orderkey % 60 AS DOUBLE)", **{c: _site_number(*v) for c, v in _SITE_NUMBERS.items()},
    }
    rank = lambda c: f"rank() OVER (PARTITION BY area, month ORDER BY {c}) + (count(*) OVER (PARTITION BY area, month, {c}) - 1) / 2 AS {c}"
    pairs = " UNION ALL ".join(
        f"SELECT area, month, count(*) AS n, '{a}' AS x, '{b}' AS y, {r(f'corr({a}, {b})', 6)} AS rho FROM k GROUP BY 1, 2" for a in K.PREDICTORS for b in K.PREDICTORS
    )
    return f"""WITH s AS (SELECT {area_sql('c_nationkey')} AS area, CAST(month(o_orderdate) AS INTEGER) AS month, {', '.join(f'{v} AS {c}' for c, v in columns.items())}
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) IN (1, 7)),
k AS (SELECT area, month, {', '.join(rank(c) for c in K.PREDICTORS)} FROM s) {pairs}"""


@query("study_correlations", _study_correlations_sql())
def study_correlations(spark, sf_dir):
    out = modelling.predictor_correlations(_study(spark, sf_dir))
    return out.select("area", "month", "n", "x", "y", *rounded(["rho"]))


# --- stepwise selection over four predictors -----------------------------------------------------------

FOUR = ["l_quantity", "l_discount", "x3", "x4"]
# Related predictors and a response of which each explains a little: some are dropped and come back on the way.
_FOUR_COLUMNS = {
    "x3": "l_quantity + l_discount * 300 + CAST(l_partkey % 17 AS DOUBLE)",
    "x4": "l_quantity - l_discount * 200 + CAST(l_orderkey % 13 AS DOUBLE)",
    "y": "CAST((l_partkey * 7919) % 1000 AS DOUBLE) / 40 + l_tax * 30 + CAST(l_partkey % 17 AS DOUBLE) / 5 + CAST(l_orderkey % 13 AS DOUBLE) / 5",
}


def _step_sql() -> str:
    """All 16 models by sweeping one predictor after the other out of the covariances, then the walk from the full one.

    ``c{a}{b}`` are covariances given the predictors of the model, of which the last bit was swept last; 4 is the response.
    """
    names = [*FOUR, "y"]
    pairs = [(a, b) for a in range(5) for b in range(a, 5)]
    cov = ", ".join(f"covar_pop({names[a]}, {names[b]}) AS c{a}{b}" for a, b in pairs)
    columns = ", ".join(f"{v} AS {k}" for k, v in _FOUR_COLUMNS.items())
    out = f"""WITH RECURSIVE l AS (SELECT l_suppkey, l_linenumber, l_quantity, l_discount, {columns} FROM lineitem),
m0 AS (SELECT l_suppkey, l_linenumber, count(*) AS n, {cov} FROM l GROUP BY 1, 2)"""
    key = lambda a, b: f"c{min(a, b)}{max(a, b)}"
    for mask in range(1, 16):
        bit = mask.bit_length() - 1
        swept = ", ".join(f"{key(a, b)} - {key(a, bit)} * {key(b, bit)} / {key(bit, bit)} AS {key(a, b)}" for a, b in pairs if bit not in (a, b))
        kept = ", ".join(f"0.0::DOUBLE AS {key(a, b)}" for a, b in pairs if bit in (a, b))
        out += f",\nm{mask} AS (SELECT l_suppkey, l_linenumber, n, {swept}, {kept} FROM m{mask ^ (1 << bit)})"
    aic = " UNION ALL ".join(
        f"SELECT l_suppkey, l_linenumber, {mask} AS mask, n * ln(c44) + {2 * (mask.bit_count() + 1)} AS aic FROM m{mask}" for mask in range(16)
    )
    chosen = ", ".join(f"CASE WHEN mask & {1 << FOUR.index(n)} > 0 THEN '{n}' END" for n in sorted(FOUR))
    return f"""{out},
a AS ({aic}),
b AS (SELECT l_suppkey, l_linenumber, a.mask AS mask, a.aic AS aic, arg_min(o.mask, o.aic) AS best, min(o.aic) AS lowest FROM a JOIN a o USING (l_suppkey, l_linenumber)
  WHERE bit_count(xor(a.mask, o.mask)) = 1 GROUP BY 1, 2, a.mask, a.aic),
w AS (SELECT l_suppkey, l_linenumber, 15 AS mask, 0 AS turn FROM m0
  UNION ALL SELECT w.l_suppkey, w.l_linenumber, b.best, turn + 1 FROM w JOIN b USING (l_suppkey, l_linenumber, mask) WHERE lowest < aic AND turn < 40)
SELECT l_suppkey, l_linenumber, concat_ws('+', {chosen}) AS chosen
FROM (SELECT l_suppkey, l_linenumber, arg_max(mask, turn) AS mask FROM w GROUP BY 1, 2)"""


@query("stepwise_four", _step_sql())
def stepwise_four(spark, sf_dir):
    """Selection among four related predictors of a response with signal, dropping and adding back."""
    keys = ["l_suppkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(
        *keys, "l_quantity", "l_discount", *[F.expr(v).alias(k) for k, v in _FOUR_COLUMNS.items()]
    )
    c = ols.coefficients(ols.moments(lines, keys, "y", FOUR), keys, FOUR, step=True)
    slopes = F.array_sort(F.collect_set(F.when(F.col("term") != ols.INTERCEPT, F.col("term"))))
    return c.groupBy(*keys).agg(F.array_join(slopes, "+").alias("chosen"))
