"""Monthly models: covariates, fits and importances for all cells in grouped jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.operators import features, importance, mixed, ols
from sensorframe.operators.clean import apply_overrides, complete_cases, exclude_sites, keep_values
from sensorframe.operators.gaps import carry_forward
from sensorframe.operators.rank_corr import spearman
from sensorframe.operators.reshape import stack_rows
from sensorframe.sources.readers import constant_table
from sensorframe.session import stored, temporary
from sensorframe.sources.schemas import RESPONSES

CELL = ["area", "month", "resp"]
STUDY_MONTHS = [(K.STUDY_YEAR + (m not in K.FIRST_YEAR_MONTHS), m) for m in K.HYDRO_MONTHS]


def study_sites(sites: DataFrame, logger: str = "Tomst") -> DataFrame:
    """Sites of the modelled areas that carry the soil logger; ``id_code`` is unique from here on."""
    kept = keep_values(sites.filter(F.col("logger") == logger), "area", K.AREAS)
    return exclude_sites(kept, areas=())


def snow_overrides(spark: SparkSession) -> DataFrame:
    rows = constant_table(
        spark, K.SNOW_OVERRIDES, "id_code string, snow_days int, first_snow_date string, last_snow_date string"
    )
    return rows.withColumns({c: F.col(c).cast("date") for c in ("first_snow_date", "last_snow_date")})


def corrected_snow(snow: DataFrame) -> DataFrame:
    """Snow seasons with the hand-checked dates of one year."""
    dates = ["first_snow_date", "last_snow_date"]
    return apply_overrides(
        snow, snow_overrides(snow.sparkSession), "id_code", dates, F.col("hydro_year") == K.SNOW_YEAR
    )


def impute_snow(snow: DataFrame, sites: DataFrame) -> DataFrame:
    """Snow days of the study year for every site, hand-checked values last.

    Most areas get a Poisson model, the listed ones a Gaussian one, because theirs cannot be fitted otherwise.
    A site is null where the study year has no data in its area's group.
    """
    targets = sites.select("area", "id_code").distinct().withColumn("hydro_year", F.lit(K.SNOW_YEAR))
    gaussian = F.col("area").isin(*K.GAUSSIAN_SNOW_AREAS)
    counts = mixed.impute_poisson(
        snow.filter(~gaussian), targets.filter(~gaussian), "area", "id_code", "snow_days", "hydro_year"
    )
    normal = mixed.impute_gaussian(
        snow.filter(gaussian), targets.filter(gaussian), "area", "id_code", "snow_days", ["hydro_year"], 0
    )
    table = stack_rows(counts, normal)
    fixed = snow_overrides(snow.sparkSession).withColumn("snow_days", F.col("snow_days").cast("double"))
    return apply_overrides(table, fixed, "id_code", ["snow_days"])


def impute_moisture(moisture: DataFrame, sites: DataFrame) -> DataFrame:
    """Monthly moisture for every site and study month."""
    carried = carry_forward(
        features.clean_moisture(moisture), ["id_code"], ["year", "month"], ["moist_med"], chunk="year"
    )
    months = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.lit(m).alias("month")) for y, m in STUDY_MONTHS]))
    targets = sites.select("area", "id_code").distinct().withColumn("_m", months)
    targets = targets.select("area", "id_code", "_m.year", "_m.month")
    return mixed.impute_gaussian(carried, targets, "area", "id_code", "moist_med", ["year", "month"], 2)


def model_input(
    monthly: DataFrame, sites: DataFrame, moisture: DataFrame, snow: DataFrame, responses: Sequence[str] = tuple(RESPONSES)
) -> DataFrame:
    """Responses with all covariates. ``moisture`` and ``snow`` are the imputed tables; look at their ``converged`` first."""
    moisture, snow = moisture.drop("converged"), snow.drop("converged")
    return features.model_table(
        monthly, features.monthly_radiation(sites), moisture, snow, features.site_covariates(sites), responses
    )


def fit_models(
    table: DataFrame,
    windows: DataFrame,
    responses: Sequence[str] = tuple(RESPONSES),
    predictors: Sequence[str] = tuple(K.PREDICTORS),
    nsim: int = K.PERMUTATIONS,
    seed: int = 1,
    wanted: Sequence[str] = ("coef", "summ", "vi"),
) -> dict[str, DataFrame]:
    """Result tables: coefficients, summaries and importances (``wanted``) of the full and stepwise models.

    Every (area, month, response) is a cell of one grouped job. Rows must be complete in all predictors,
    also in those a cell may not use. The moments, which all results are worked out from, are small; they
    are stored once, so no result goes back to the rows.
    """
    predictors = list(predictors)
    others = [c for c in ("year", "hydro_year") if c in table.columns]
    rows = complete_cases(table, ["id_code", "area", "month", *others, *predictors])
    keys = CELL[:2]

    def moments(rows: DataFrame) -> DataFrame:
        cells = ols.moments(ols.stack_responses(rows, [*keys, *predictors], responses), CELL, "y", predictors)
        cells = cells.join(features.snowy_months(windows), "area", "left")
        return stored(cells.withColumn("eligible", features.eligible("area", "month", "snowy", predictors)).drop("snowy"))

    if "vi" in wanted:
        with temporary(importance.response_rows(rows, keys, responses, predictors)) as rows:
            cells = moments(rows)
            permuted, ranges = importance.permuted_rows(rows, keys, responses, predictors, nsim, seed)
        permuted, ranges = stored(permuted), stored(ranges)
    else:
        cells = moments(rows)
    out = {}
    for suffix, step in (("", False), ("_step", True)):
        coefs = ols.coefficients(cells, CELL, predictors, step)
        fitted = ols.models(cells, CELL, predictors, step)
        if "coef" in wanted:
            out[f"coef{suffix}"] = coefs
        if "summ" in wanted:
            out[f"summ{suffix}"] = ols.fit_summaries(cells, CELL, predictors, step)
        if "vi" not in wanted:
            continue
        out[f"vi{suffix}"] = stack_rows(
            importance.t_importance(coefs, CELL),
            importance.permutation_importance(fitted, permuted, CELL, predictors, "perm_r2"),
            importance.permutation_importance(fitted, permuted, CELL, predictors, "perm_rmse"),
            importance.pdp_importance(coefs, ranges, CELL),
        )
    return out


def predictor_correlations(table: DataFrame, months: Sequence[int] = (1, 7)) -> DataFrame:
    """Rank correlation of the predictors per area in the given months, over rows without gaps."""
    rows = complete_cases(table.filter(F.col("month").isin(*months)))
    return spearman(rows, ["area", "month"], K.PREDICTORS)
