import datetime as dt

from pyspark.sql import functions as F

from sensorframe.operators import stations
from sensorframe.sources import readers, schemas, writers


def test_csv_nulls(spark, tmp_path):
    (tmp_path / "d.csv").write_text("FMISID,area,time,tday\n1,NA,2020-01-01,NA\n2,,2020-01-02,NaN\n3,KAR,2020-01-03,1.5\n")
    rows = readers.read_weather(spark, str(tmp_path / "d.csv")).orderBy("FMISID").collect()
    assert [(r.area, r.tday) for r in rows] == [(None, None), (None, None), ("KAR", 1.5)]


def test_round_trip_and_two_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "KAR", 1.5), ("ä", None, None)], "id string, area string, v double")
    for fmt in ("parquet", "csv"):
        one, two = str(tmp_path / f"{fmt}1"), str(tmp_path / f"{fmt}2")
        writers.write_twice(df, one, two, fmt=fmt)
        for p in (one, two):
            back = readers.read_table(spark, p, "id string, area string, v double", fmt)
            assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_partitioned_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "KAR"), ("b", "HYY")], "id string, area string")
    writers.write_table(df, str(tmp_path / "p"), partition_by=["area"])
    plan = spark.read.parquet(str(tmp_path / "p")).filter("area = 'KAR'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(area" in plan


def test_readings_scan_prunes_columns(spark, tmp_path):
    row = ("a", "KAR", 1, dt.datetime(2020, 1, 1), *[1.0] * 7, 0, 0, "x")
    spark.createDataFrame([row], schemas.READINGS).write.parquet(str(tmp_path / "r"))
    df = readers.read_readings(spark, str(tmp_path / "r"), "parquet").groupBy("id_code").agg(F.avg("T1"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id_code:string,T1:double>" in plan


def test_calendar(spark):
    cal = readers.calendar(spark, "2018-01-01", "2021-12-31")
    assert cal.count() == 1461


STATION_ROWS = [
    # id, first, last, distance per area
    (1, "1990-01-01", "2021-11-12", {"KAR": 5.0, "HYY": 9.0, "MAL": 1.0, "AIL": 2.0}),
    (2, "1990-01-01", "2021-11-12", {"KAR": 5.0, "HYY": 3.0, "MAL": 8.0, "AIL": 7.0}),
    (3, "2020-01-01", "2021-11-12", {"KAR": 0.1, "HYY": 0.1, "MAL": 0.1, "AIL": 0.1}),
]


def station_table(spark):
    rows = [
        (f"S{i}", i, i, i, 1, 0.0, 0.0, 1990, dt.date.fromisoformat(a), dt.date.fromisoformat(b), 1, 1, "KAR",
         *[d.get(c) for c in schemas.STATION_DISTANCES], None)
        for i, a, b, d in STATION_ROWS
    ]
    return spark.createDataFrame(rows, schemas.STATIONS)


def test_nearest_station(spark):
    long = readers.station_distances(station_table(spark))
    assert long.count() == 27
    # Station 1 is closest to KAR (tie, first row), MAL and AIL; it keeps the last area in order, KAR.
    got = {r.FMISID: r.area for r in stations.nearest_stations(long).collect()}
    assert got == {1: "KAR", 2: "HYY"}
    every = sorted((r.area, r.FMISID) for r in stations.nearest_stations(long, one_area=False).collect())
    assert every == [("AIL", 1), ("HYY", 2), ("KAR", 1), ("MAL", 1)]


def test_normals_and_merge(spark):
    rows = [(1, dt.date(y, 3, 1), float(y - 1990), "MAL") for y in (1990, 1991, 1992)] + [(1, dt.date(1993, 3, 1), None, "MAL")]
    w = spark.createDataFrame(rows, "FMISID int, time date, tday double, area string")
    n = {r.yday: (r.n_days, r.Tavg30) for r in stations.day_normals(w).collect()}
    assert n == {60: (1, 1.0), 61: (1, 2.0)}  # 1992 is a leap year
    assert stations.study_means(w).first().Tavg is None
    assert {r.area for r in stations.merge_areas(w).collect()} == {"MAL & AIL"}


def test_damaged_lines_are_kept_apart(spark, tmp_path):
    lines = ["FMISID,area,time,tday", "1,KAR,2020-01-01,1.5", "2,KAR", "3,KAR,2020-01-02,2.5,7", "x,KAR,2020-01-02,2.5", "", "4,NA,2020-01-03,NA", "5,,2020-01-04,NaN"]
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    good, damaged = readers.read_checked(spark, str(tmp_path), schemas.WEATHER_DAILY)
    assert sorted((r.FMISID, r.area, r.tday) for r in good.collect()) == sorted([(1, "KAR", 1.5), (4, None, None), (5, None, None)] * 2, key=str)
    assert sorted(r.line for r in damaged.collect()) == sorted([lines[2], lines[3], lines[4]] * 2)
    assert damaged.count() == 6 and good.select("tday").count() == 6 and damaged.select("file").distinct().count() == 2
    plain, _ = readers.read_checked(spark, str(tmp_path), schemas.WEATHER_DAILY, header=False)
    assert plain.count() == 6


def test_one_partition_reads_its_files_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, a) for i in range(6) for a in ("KAR", "HYY", "PIS")], "v int, area string")
    writers.write_table(df, str(tmp_path / "p"), partition_by=["area"])
    one = readers.read_partition(spark, str(tmp_path / "p"), "v int, area string", area="HYY")
    assert sorted(r.v for r in one.collect()) == list(range(6))
    files = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert files and all("area=HYY" in f for f in files)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(area" in plan and "HYY" in plan
