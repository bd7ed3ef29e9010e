"""Summary tables built from monthly values and model results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.dates import month_label, month_start, study_year
from sensorframe.functions.labels import p_class, rank_of, recode, sign_value, split_part
from sensorframe.functions.nulls import clamp_negative, round_to, strict_mean, weighted_mean
from sensorframe.operators.clean import drop_matching, drop_values, keep_values
from sensorframe.operators.loess import loess
from sensorframe.operators.order_stats import exact_medians
from sensorframe.operators.reshape import (
    complete_grid,
    null_safe_join,
    share_of_group_max,
    stacked_totals,
    to_long,
    to_wide,
)
from sensorframe.operators.rollup import cross_site_sd
from sensorframe.operators.stations import against_normals, merge_areas

HYDRO_LABELS = [K.MONTH_LABELS[m - 1] for m in K.HYDRO_MONTHS]


def enrich_results(results: DataFrame) -> DataFrame:
    """Model results with sensor, statistic, study year, month date and area order."""
    out = results.withColumns(
        {"tsen": split_part("resp", 1), "tvar": split_part("resp", 2), "year": study_year("month")}
    )
    out = out.withColumns({"ym": month_start("year", "month"), "area_rank": rank_of("area", K.AREAS)})
    return drop_matching(out, "Variable", "^extra") if "Variable" in results.columns else out


def main_responses(results: DataFrame, labels=K.RESPONSE_LABELS) -> DataFrame:
    """Only minimum, mean and maximum, under their display names."""
    return keep_values(results, "tvar", list(labels)).withColumn("tvar", recode("tvar", labels))


def gradient_values(table: DataFrame) -> DataFrame:
    """One row per site and environmental variable (``id_code, area, name, value``)."""
    names = [c for c in K.GRADIENT_LABELS if not c.startswith("pisr_")]
    rows = table.filter(F.col("area").isNotNull() & F.col("month").isin(1, 7))
    kwh = F.col("pisr") / K.KJ_PER_KWH
    # A site has one row per month; rows that agree in all covariates count once.
    cells = rows.groupBy("id_code", "area", *names).agg(
        *[F.max(F.when(F.col("month") == m, kwh)).alias(f"pisr_{K.MONTH_LABELS[m - 1]}") for m in (1, 7)]
    )
    sites = cells.groupBy("id_code", "area").agg(*[F.avg(c).alias(c) for c in K.GRADIENT_LABELS])
    return to_long(sites, ["id_code", "area"], list(K.GRADIENT_LABELS), "name", "value")


def five_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, min, max and range length per group."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    median = exact_medians(df, keys, [value]).withColumnRenamed(f"{value}_median", "median")
    out = null_safe_join(stats, median, keys, "left")
    return out.withColumn("range length", F.col("max") - F.col("min")).select(*keys, *K.GRADIENT_STATISTICS)


def gradient_table(table: DataFrame) -> DataFrame:
    """Five statistics of every environmental variable per area, one column per variable."""
    stats = five_stats(gradient_values(table), ["area", "name"], "value")
    long = to_long(stats, ["area", "name"], K.GRADIENT_STATISTICS, "stat", "value")
    wide = to_wide(long, ["area", "stat"], "name", ["value"], list(K.GRADIENT_LABELS))
    return wide.select(
        "area",
        "stat",
        *[round_to(c, K.GRADIENT_DECIMALS[c]).alias(label) for c, label in K.GRADIENT_LABELS.items()],
        rank_of("area", K.AREAS).alias("area_rank"),
    ).orderBy("area_rank", rank_of("stat", K.GRADIENT_STATISTICS))


def r2_table(summaries: DataFrame) -> DataFrame:
    """R squared of the stepwise models by statistic, sensor and month, averaged over areas.

    A month in which an area has no model is empty.
    """
    rows = main_responses(drop_values(enrich_results(summaries), "tsen", ["T2"]))
    rows = rows.withColumn("label", month_label("month"))
    wide = to_wide(rows, ["tsen", "tvar", "area"], "label", ["r_squared"], HYDRO_LABELS)
    return (
        wide.groupBy(F.col("tvar").alias("T variable"), F.col("tsen").alias("T height"))
        .agg(*[round_to(strict_mean(m), 2).alias(m) for m in HYDRO_LABELS])
        .orderBy(rank_of("T variable", list(K.RESPONSE_LABELS.values())), "T height")
    )


def signed_cells(importances: DataFrame, sensor: str) -> DataFrame:
    """Permutation importance with the sign of the t value, zero where a predictor was not used."""
    rows = main_responses(enrich_results(importances).filter(F.col("tsen") == sensor))
    rows = rows.withColumn("Variable", recode("Variable", K.PREDICTOR_LABELS))
    ids = ["Variable", "tsen", "tvar", "month", "area"]
    rows = keep_values(rows, "method", ["tstat", "perm_r2"])
    wide = to_wide(rows, ids, "method", ["Importance", "Sign"], ["tstat", "perm_r2"])
    signed = wide.withColumn("Sign_tstat", sign_value("Sign_tstat").cast("double"))
    signed = signed.select(
        *ids, "Sign_tstat", (clamp_negative("Importance_perm_r2") * F.col("Sign_tstat")).alias("Importance_perm_r2")
    )
    return complete_grid(signed, ids, {"Sign_tstat": 0.0, "Importance_perm_r2": 0.0})


def signed_importance_table(importances: DataFrame, sensor: str) -> DataFrame:
    """Mean signed importance per predictor and statistic, one column per month."""
    cells = signed_cells(importances, sensor)
    means = cells.groupBy("Variable", "month", "tvar").agg(
        weighted_mean("Sign_tstat", F.abs("Importance_perm_r2")).alias("Sign_tstat"),
        F.avg("Importance_perm_r2").alias("value"),
    )
    means = means.withColumn("label", month_label("month"))
    wide = to_wide(means, ["Variable", "tvar"], "label", ["value"], HYDRO_LABELS)
    return wide.select(
        F.col("Variable").alias("Predictor"),
        F.col("tvar").alias("T_var"),
        *[round_to(m, 2).alias(m) for m in HYDRO_LABELS],
    ).orderBy(
        rank_of("Predictor", list(K.PREDICTOR_LABELS.values())), rank_of("T_var", list(K.RESPONSE_LABELS.values()))
    )


def importance_cells(importances: DataFrame) -> DataFrame:
    """Permutation importance of every predictor in every cell, zero where it was not used."""
    rows = main_responses(drop_values(enrich_results(importances), "tsen", ["T2"]))
    rows = rows.filter(F.col("method") == "perm_r2").withColumn("Variable", recode("Variable", K.PREDICTOR_LABELS))
    ids = ["Variable", "tsen", "tvar", "month", "area"]
    wide = to_wide(rows, ids, "method", ["Importance"], ["perm_r2"])
    return complete_grid(wide, ids, {"perm_r2": 0.0})


def grouping_means(df: DataFrame, sets: Sequence[Sequence[str]], value: str, digits: int | None = 2) -> DataFrame:
    """Mean per group for several sets of grouping columns in one pass over the data.

    ``level`` names the set a row belongs to; columns outside the set are null.
    """
    every = list(dict.fromkeys(c for s in sets for c in s))
    mean = strict_mean(value)
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(
        (mean if digits is None else round_to(mean, digits)).alias(value), F.grouping_id().alias("_g")
    )
    return out.withColumn("level", _level(sets, every)).drop("_g")


def _level(sets: Sequence[Sequence[str]], every: Sequence[str]):
    label = F.lit(None).cast("string")
    for s in sets:
        code = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in s)
        label = F.when(F.col("_g") == code, F.lit("+".join(s))).otherwise(label)
    return label


def importance_summary(importances: DataFrame) -> DataFrame:
    """Mean importance per predictor: overall, by sensor, by statistic and by month."""
    sets = [["Variable"], ["Variable", "tsen"], ["Variable", "tvar"], ["Variable", "month"]]
    out = grouping_means(importance_cells(importances), sets, "perm_r2")
    return out.orderBy("level", "tsen", "tvar", "month", F.desc("perm_r2"))


def r2_summary(summaries: DataFrame) -> DataFrame:
    """Mean, smallest and largest R squared by sensor, statistic and area; mean adjusted one by month."""
    rows = keep_values(enrich_results(summaries), "tvar", list(K.RESPONSE_LABELS))
    sets, every = [["tsen"], ["tvar"], ["area"], ["month"]], ["tsen", "tvar", "area", "month"]
    by_month = F.grouping("month") == 0
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(
        F.when(by_month, strict_mean("adj_r_squared")).otherwise(strict_mean("r_squared")).alias("mean"),
        F.when(~by_month, F.min("r_squared")).alias("min"),
        F.when(~by_month, F.max("r_squared")).alias("max"),
        F.grouping_id().alias("_g"),
    )
    return out.withColumn("level", _level(sets, every)).drop("_g").orderBy("level", "mean")


def importance_bars(importances: DataFrame, sensor: str) -> DataFrame:
    """Edges of the stacked importance bars per area, statistic and month."""
    rows = enrich_results(importances).filter((F.col("method") == "perm_r2") & (F.col("tsen") == sensor))
    rows = main_responses(rows).withColumn("Variable", recode("Variable", K.PREDICTOR_LABELS))
    rows = rows.withColumn("rank", rank_of("Variable", list(K.PREDICTOR_LABELS.values())))
    return stacked_totals(rows, ["area", "tvar", "month"], "rank", "Importance")


def sensor_availability(monthly: DataFrame, limit: float = K.SENSOR_COVERAGE) -> DataFrame:
    """Number of working sensors per area and month, and its share of the area's best month."""
    sensors = [c for c in monthly.columns if c.endswith("_prop")]
    long = to_long(monthly, ["area", "year", "month"], sensors, "var", "prop")
    long = long.withColumn("var", F.regexp_replace("var", "_prop", "")).filter(F.col("prop") > limit)
    counts = long.groupBy("area", "year", "month", "var").agg(F.count(F.lit(1)).alias("n"))
    out = share_of_group_max(counts, "n", ["area", "var"])
    return out.withColumns({"ym": month_start("year", "month"), "area_rank": rank_of("area", K.AREAS)})


def sd_series(readings: DataFrame) -> DataFrame:
    """Spread across sites per area, time and sensor, in long form."""
    return to_long(cross_site_sd(readings), ["area", "datetime"], K.TEMPERATURES, "tsen", "Temperature")


def spread_curves(readings: DataFrame, span: float = K.SPREAD_SPAN, se: bool = False) -> DataFrame:
    """Smoothed spread across sites over days, per area and sensor: ``area, tsen, x, fit[, se]`` with ``x`` in days since 1970."""
    rows = sd_series(readings).withColumn("day", F.unix_micros(F.col("datetime").cast("timestamp")) / 86_400e6)
    return loess(rows, ["area", "tsen"], "day", "Temperature", span, se=se)


def weather_curves(days: DataFrame, span: float = K.WEATHER_SPAN) -> DataFrame:
    """Smoothed days of the study year and their normals, per area: ``area, series, x, fit``."""
    rows = to_long(days.withColumn("day", F.unix_date("time").cast("double")), ["area", "day"], ["tday", "Tavg30"], "series", "value")
    return loess(rows, ["area", "series"], "day", "value", span)


def r2_curves(summaries: DataFrame, span: float = K.R2_SPAN) -> DataFrame:
    """Smoothed adjusted R squared over the months, per sensor and statistic: ``tsen, tvar, x, fit``, months in study order."""
    rows = keep_values(enrich_results(summaries), "tvar", list(K.RESPONSE_LABELS))
    rows = rows.withColumn("place", F.array_position(F.array(*[F.lit(m) for m in K.HYDRO_MONTHS]), F.col("month").cast("int")).cast("double"))
    return loess(rows, ["tsen", "tvar"], "place", "adj_r_squared", span)


def weather_against_normals(weather: DataFrame, normals: DataFrame) -> DataFrame:
    """Study-year days next to their normals, areas that share a station merged."""
    out = merge_areas(against_normals(weather, normals))
    return out.withColumn("area_rank", rank_of("area", K.WEATHER_ORDER))


def effect_table(coefs: DataFrame, predictor: str = K.EFFECT_PREDICTOR, keys: Sequence[str] = ("area", "month", "resp")) -> DataFrame:
    """Slope of one predictor in every model, with its standard-error band and p-value class."""
    mine = F.col("term") == predictor
    slopes = coefs.groupBy(*keys).agg(
        *[F.max(F.when(mine, F.col(c))).alias(c) for c in ("estimate", "std_error", "p_value")]
    )
    return slopes.withColumns(
        {
            "p_class": p_class("p_value"),
            "lower": F.col("estimate") - F.col("std_error"),
            "upper": F.col("estimate") + F.col("std_error"),
        }
    )


def effect_labels(effects: DataFrame, column: str = "tvar", out: str = "label") -> DataFrame:
    """Effects with the printed name of their statistic; one without such a name keeps its own."""
    names = F.create_map(*[F.lit(x) for pair in K.EFFECT_LABELS.items() for x in pair])
    return effects.withColumn(out, F.coalesce(F.try_element_at(names, F.col(column)), F.col(column)))
