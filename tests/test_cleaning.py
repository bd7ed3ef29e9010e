import pytest
from pyspark.sql import functions as F

from sensorframe.operators import clean, rollup
from sensorframe.plans import preprocess

READING = "id_code string, area string, site int, datetime string, T1 double, T2 double, T3 double, T4 double, moist double, error_tomst int, error_T4 int, logger_T4 string"


def readings(spark, rows):
    df = spark.createDataFrame(rows, READING)
    return df.withColumn("datetime", F.to_timestamp("datetime"))


def masked(spark, code, t1, moist):
    row = ("a", "KAR", 1, "2020-01-01 00:00:00", t1, 3.0, 3.0, 3.0, moist, code, 0, "x")
    return clean.mask_errors(readings(spark, [row])).first()


def test_missing_code_keeps_sets_and_voids_thresholds(spark):
    r = masked(spark, None, 3.0, 20.0)
    assert (r.T1, r.T2, r.T3, r.moist) == (3.0, 3.0, None, 20.0)


def test_moisture_follows_masked_t1(spark):
    r = masked(spark, 4, 5.0, 20.0)
    assert r.T1 is None and r.moist is None


def test_frozen_soil_has_no_moisture(spark):
    assert masked(spark, 0, 0.5, 20.0).moist is None


def test_site_filters_keep_unknown_area(spark):
    rows = [(i, a, s) for i, (a, s) in enumerate([("PIS", 100), ("PIS", 99), ("SAA", 1), ("KAR", 500)])]
    df = spark.createDataFrame(rows + [(9, None, 5)], "i int, area string, site int")
    assert sorted(r.i for r in clean.exclude_sites(df).collect()) == [1, 3, 9]
    assert clean.drop_values(df, "area", ["SAA"]).count() == 4


def test_period_is_local_and_pushed_down(spark, tmp_path):
    rows = [("2019-10-31 21:59:59",), ("2019-10-31 22:00:00",), ("2020-10-31 21:59:59",), ("2020-10-31 22:00:00",)]
    df = spark.createDataFrame(rows, "s string").select(F.to_timestamp("s").alias("datetime"))
    df.write.parquet(str(tmp_path / "t"))
    kept = clean.period_filter(spark.read.parquet(str(tmp_path / "t")))
    assert kept.count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(datetime" in plan and "LessThan(datetime" in plan


def test_thinning(spark):
    rows = [("a", "KAR", 1, f"2020-01-01 {h}:00", 1.0, 1.0, 1.0, 5.0, 1.0, 0, 0, "x") for h in ("01:00", "02:00", "03:30")]
    df = readings(spark, rows)
    assert [r.T4 for r in clean.thin_hours(df).orderBy("datetime").collect()] == [5.0, None, None]
    assert clean.keep_odd_hours(df).count() == 1


def test_overrides(spark):
    df = spark.createDataFrame([("a", 1, 2020), ("a", 2, 2019), ("b", 3, 2020)], "id string, v int, y int")
    new = spark.createDataFrame([("a", 9)], "id string, v int")
    out = clean.apply_overrides(df, new, "id", ["v"], F.col("y") == 2020)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2, 2019), ("a", 9, 2020), ("b", 3, 2020)]


def test_complete_cases(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, "a"), (2.0, None)], "x double, s string")
    assert clean.complete_cases(df).count() == 1
    assert clean.complete_cases(df, ["s"]).count() == 3


def daily_row(spark, **kw):
    base = {f"{s}_{k}": 1.0 for s in ("T1", "T2", "T3", "T4") for k in ("mean", "min", "max")}
    base |= {f"{s}_prop": 100.0 for s in ("T1", "T2", "T3", "T4")} | {"error_tomst": 0, "error_T4": 0} | kw
    return spark.createDataFrame([base])


def test_daily_share_is_in_percent(spark):
    df = daily_row(spark, T1_prop=50.0)
    assert rollup.mask_days(df).first().T1_mean == 1.0
    assert rollup.mask_days(df, 95).first().T1_mean is None


def test_worst_code_hides_a_lower_one(spark):
    r = rollup.mask_days(daily_row(spark, error_tomst=3)).first()
    assert r.T1_mean == 1.0 and r.T3_mean is None


def days(spark, n):
    df = spark.range(n).select(
        F.lit("a").alias("id_code"), F.lit("KAR").alias("area"), F.lit(1).alias("site"),
        F.date_add(F.lit("2019-11-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit("x").alias("logger_T4"),
    )
    stats = {f"{s}_{k}": F.lit(2.0) for s in ("T1", "T2", "T3", "T4", "moist") for k in ("mean", "min", "max")}
    return df.withColumns(stats)


def test_month_coverage(spark):
    full = rollup.monthly_stats(days(spark, 30)).first()
    half = rollup.monthly_stats(days(spark, 15))
    assert full.day_frac_T1 == 1.0 and half.first().day_frac_T1 == 0.5
    r = rollup.mask_months(half).first()
    assert r.T1_mean is None and r.moist_mean == 2.0 and r.moist_sd == 0.0


def test_single_day_has_no_spread(spark):
    r = rollup.monthly_stats(days(spark, 1)).first()
    assert r.moist_sd is None and r.moist_cv is None and r.moist_med == 2.0


def test_quantile_only_month_survives(spark):
    m = rollup.monthly_stats(days(spark, 30))
    q = spark.createDataFrame(
        [("a", 11, *[1.0] * 20), ("b", 3, *[2.0] * 20)],
        "id_code string, month int, " + ", ".join(f"T{i}_{p} double" for i in range(1, 5) for p in (99, 98, 97, 96, 95)),
    )
    rows = {r.id_code: r for r in rollup.months_with_quantiles(m, q).collect()}
    assert rows["b"].area is None and rows["b"].day_frac_T1 == 0.0 and rows["b"].T1_99 == 2.0
    assert rows["a"].T1_mean == 2.0 and rows["a"].T1_99 == 1.0


def test_whole_chain(spark):
    rows = []
    for d in range(1, 31):
        for h in range(0, 24):
            value = None if h in (5, 6, 7) else float(h)
            rows.append(("a", "KAR", 1, f"2020-04-{d:02d} {h:02d}:00:00", value, 1.0, 2.0, float(h), 30.0, 0, 0, "tomst"))
    clean_rows, daily, monthly = preprocess.preprocess(readings(spark, rows))
    assert "error_T4" not in clean_rows.columns
    day = daily.filter("date = '2020-04-10'").first()
    # The three missing hours lie on the line through their neighbours, so the daily mean is that of all
    # hours. T4 keeps the local odd hours: 23 of the day before, then 1, 3, ..., 21 in UTC.
    assert day.T1_mean == pytest.approx(11.5) and day.T1_min == 0.0 and day.T4_mean == pytest.approx(12.0)
    month = monthly.filter("month = 4").first()
    assert month.T1_prop == 1.0 and month.T1_mean is not None and month.T4_95 is not None
    assert monthly.columns[:5] == ["id_code", "area", "site", "year", "month"] and len(monthly.columns) == 57


def test_cleaning_runs_on_a_stream(spark, tmp_path):
    row = ("a", "KAR", 1, "2020-01-01 00:00:00", 3.0, 3.0, 3.0, 3.0, 9.0, 0, 0, "x")
    readings(spark, [row]).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = clean.clean_readings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_labels_of_days_in_one_aggregate(spark):
    """A day with one label has it, one with several the flag, one without none; readings are grouped once."""
    soil = spark.createDataFrame([("a", "KAR", 1, d, 1.0, None, 3.0, 4.0, 2) for d in ("d1", "d2")], "id_code string, area string, site int, date string, T1 double, T2 double, T3 double, moist double, error_tomst int")
    rows = [("d1", 2.0, "x"), ("d1", 4.0, "x"), ("d1", None, None), ("d2", 1.0, "x"), ("d2", 1.0, "y"), ("d3", 1.0, None), ("d4", float("nan"), "z")]
    air = spark.createDataFrame([("a", "KAR", 1, d, t, 0, x) for d, t, x in rows], "id_code string, area string, site int, date string, T4 double, error_T4 int, logger_T4 string")
    days = rollup.daily_rollup(soil, air)
    got = {r.date: r for r in days.collect()}
    assert {d: r.logger_T4 for d, r in got.items()} == {"d1": "x", "d2": "b", "d3": None, "d4": "z"}
    assert (got["d1"].T4_mean, got["d1"].T4_prop, got["d1"].T1_prop, got["d1"].T2_prop, got["d1"].error_tomst) == (3.0, 66.7, 100.0, 0.0, 2)
    assert (got["d3"].T1_prop, got["d3"].T1_mean, got["d4"].T4_mean, got["d4"].T4_prop) == (None, None, None, 0.0)
    assert days._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
