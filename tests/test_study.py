"""The modelling chain on a small made-up study: imputation, model table, fits, reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe import session
from sensorframe.operators import features
from sensorframe.plans import modelling, reports
from sensorframe.sources import schemas


@pytest.fixture(scope="module")
def study(spark):
    sites = []
    for a, area in enumerate(["TII", "HYY"]):
        for i in range(30):
            h = (i * 37 + a * 11) % 30
            sites.append((f"{area}{i:03d}", area, i, "Tomst", 100.0 + 10 * h, *[float(h * m) for m in range(1, 13)],
                          float(h % 7), float(i % 9), float((i * 5) % 11), float((i * 13) % 80)))
    sites.append(("KAR001", "KAR", 1, "Other", *[1.0] * 17))
    e = spark.createDataFrame(sites, schemas.SITE_VARIABLES)
    snow = [
        (s[0], s[1], s[2], y, 150 + (s[2] * 7) % 40 + y - 2018, dt.date(y - 1, 11, 5), dt.date(y, 4, 20))
        for s in sites for y in (2019, 2020) if s[2] % 10 != 9 and s[3] == "Tomst"
    ]
    moisture = [
        (s[0], s[1], y, m, 1.0 if m != 2 else 0.05, 20.0 + s[2] % 5 + m)
        for s in sites for y, m in modelling.STUDY_MONTHS if s[2] % 8 and s[3] == "Tomst"
    ]
    return (
        modelling.study_sites(e),
        spark.createDataFrame(snow, schemas.SNOW),
        spark.createDataFrame(moisture, schemas.MOISTURE),
    )


def test_study_sites(study):
    assert study[0].count() == 60


def test_snow_imputation(study):
    sites, snow, _ = study
    rows = {r.id_code: r for r in modelling.impute_snow(modelling.corrected_snow(snow), sites).collect()}
    assert len(rows) == 60
    assert rows["TII006"].snow_days == 177 and rows["TII020"].snow_days == 189
    assert all(140 < r.snow_days < 210 for r in rows.values())


def test_snow_dates_are_corrected(study):
    windows = {r.area: r for r in features.snow_windows(modelling.corrected_snow(study[1])).collect()}
    assert windows["TII"].first_snow_date == dt.date(2019, 10, 28)
    assert windows["HYY"].last_snow_date == dt.date(2020, 4, 20)


def test_moisture_imputation(study):
    rows = modelling.impute_moisture(study[2], study[0]).collect()
    assert len(rows) == 60 * 12
    by = {(r.id_code, r.month): r.moist_med for r in rows}
    assert by[("TII001", 7)] == pytest.approx(28, abs=1)
    assert by[("TII008", 7)] is not None  # no readings at all


def test_eligibility(spark):
    df = spark.createDataFrame([("KAR", 7, [7]), ("HYY", 1, [1]), ("VAR", 7, [1]), ("MAL", 4, None)], "area string, month int, s array<int>")
    got = [dict(zip(K.PREDICTORS, r[0])) for r in df.select(features.eligible("area", "month", "s")).collect()]
    off = [{p for p, ok in g.items() if not ok} for g in got]
    assert off == [{"altitude", "snow_days"}, {"altitude", "pisr"}, {"snow_days", "water_prop_500m"}, {"snow_days"}]


@pytest.fixture(scope="module")
def table(spark, study):
    sites, snow, moisture = study
    monthly = sites.select("id_code", "area", "altitude", "canopy_cover2m_10m", F.explode(F.array(F.lit(4), F.lit(7))).alias("month"))
    wiggle = (F.pmod(F.xxhash64("id_code", "month"), F.lit(100)) / 100).cast("double")
    monthly = monthly.select(
        "id_code", "area", F.lit(2020).alias("year"), "month",
        (10 - F.col("canopy_cover2m_10m") / 20 + wiggle).alias("T1_mean"),
        (15 - F.col("canopy_cover2m_10m") / 40 + wiggle).alias("T1_absmax"),
        (wiggle * 3).alias("T3_absmin"),
    )
    moist = modelling.impute_moisture(moisture, sites)
    snows = modelling.impute_snow(modelling.corrected_snow(snow), sites)
    return modelling.model_input(monthly, sites, moist, snows, ["T1_mean", "T1_absmax", "T3_absmin"])


def test_model_table_keeps_rows(table):
    assert table.count() == 120
    assert set(K.PREDICTORS) <= set(table.columns) and "hydro_year" in table.columns


@pytest.fixture(scope="module")
def fits(study, table):
    windows = features.snow_windows(modelling.corrected_snow(study[1]))
    return modelling.fit_models(table, windows, ["T1_mean", "T1_absmax", "T3_absmin"], nsim=3)


def test_fits(fits):
    coef = {(r.area, r.month, r.resp, r.term): r for r in fits["coef"].collect()}
    assert coef[("TII", 7, "T1_mean", "canopy_cover2m_10m")].estimate == pytest.approx(-0.05, abs=0.02)
    assert ("TII", 7, "T1_mean", "altitude") not in coef  # not offered there
    assert ("TII", 7, "T1_mean", "snow_days") not in coef and ("TII", 4, "T1_mean", "snow_days") in coef
    assert fits["summ"].count() == 12
    steps = {(r.area, r.month, r.resp): r for r in fits["summ_step"].collect()}
    for r in fits["summ"].collect():
        assert steps[(r.area, r.month, r.resp)].aic <= r.aic + 1e-6


def test_importances(fits):
    vi = fits["vi_step"].collect()
    assert {r.method for r in vi} == {"tstat", "perm_r2", "perm_rmse", "pdp"}
    top = max((r for r in vi if r.method == "perm_r2" and (r.area, r.month, r.resp) == ("TII", 7, "T1_mean")), key=lambda r: r.Importance)
    assert top.Variable == "canopy_cover2m_10m" and top.StDev is not None


def test_importances_keep_no_rows(spark, study, table, monkeypatch, tmp_path):
    """When the models are fitted, no stored table has the rows of the study any more."""
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    windows = features.snow_windows(modelling.corrected_snow(study[1]))
    out = modelling.fit_models(table, windows, ["T1_mean", "T1_absmax"], nsim=2, wanted=["vi"])
    left = [set(spark.read.parquet(str(p)).columns) for p in tmp_path.iterdir()]
    assert left and not any(set(K.PREDICTORS) <= columns for columns in left)
    assert {r.method for r in out["vi"].select("method").distinct().collect()} == {"tstat", "perm_r2", "perm_rmse", "pdp"}


def test_reports(fits, table):
    r2 = reports.r2_table(fits["summ_step"]).collect()
    assert [r["T variable"] for r in r2] == ["Tmin", "Tavg", "Tmax"] and r2[1]["Jul"] > 0.5 and r2[0]["Nov"] is None
    signed = reports.signed_importance_table(fits["vi_step"], "T1").collect()
    canopy = [r for r in signed if r.Predictor == "Canopy cover" and r.T_var == "Tavg"][0]
    assert canopy.Jul < -0.3
    assert reports.importance_summary(fits["vi_step"]).filter("level = 'Variable'").count() >= 1
    effects = reports.effect_table(fits["coef"]).collect()
    assert len(effects) == 12 and all(e.lower <= e.estimate <= e.upper for e in effects)
    gradient = reports.gradient_table(table).collect()
    assert len(gradient) == 10 and [g.stat for g in gradient[:5]] == K.GRADIENT_STATISTICS
    bars = reports.importance_bars(fits["vi_step"], "T1").collect()
    assert all(b.bottom <= b.top for b in bars)


def test_correlations(table):
    rows = modelling.predictor_correlations(table, [4, 7]).collect()
    assert len(rows) == 2 * 2 * 64 and all(abs(r.rho) <= 1 + 1e-9 for r in rows if r.rho is not None)
