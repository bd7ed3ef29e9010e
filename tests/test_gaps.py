import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import gaps
from sensorframe.operators.gaps import carry_forward, interpolate_gaps, ranges
from sensorframe.session import stored


def fill(spark, t, v, max_gap=3, parts=None, ids=None):
    ids = ids or ["a"] * len(t)
    df = spark.createDataFrame(list(zip(ids, t, v)), "id string, t long, v double")
    out = interpolate_gaps(df, ["id"], "t", ["v"], max_gap, parts)
    return [r.v for r in out.orderBy("id", "t", "v").collect()]


def test_short_run_is_filled_and_long_run_stays(spark):
    v = [1.0, None, None, 4.0, None, None, None, None, 9.0, None]
    for parts in (None, 1, 2, 4, 10):
        assert fill(spark, range(1, 11), v, 3, parts) == [1, 2, 3, 4, None, None, None, None, 9, None]


def test_weights_use_elapsed_time(spark):
    for parts in (None, 1, 3):
        assert fill(spark, [0, 1, 4], [0.0, None, 8.0], 3, parts) == [0, 2, 8]


def test_no_extrapolation(spark):
    assert fill(spark, [1, 2, 3], [None, 5.0, None]) == [None, 5, None]


def test_rows_sharing_a_time_are_one_point(spark):
    df = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, None), ("a", 2, 4.0)], "id string, t long, v double"
    )
    out = interpolate_gaps(df, ["id"], "t", ["v"], 1)
    assert sorted((r.t, r.v) for r in out.collect()) == [(0, 1.0), (0, 3.0), (1, 3.0), (2, 4.0)]


def plain(frame, max_gap):
    """Brute force: walk each series point by point."""
    out = []
    for _, g in frame.sort_values(["id", "t"]).groupby("id"):
        t, v = g["t"].tolist(), g["v"].tolist()
        known = [i for i, x in enumerate(v) if not pd.isna(x)]
        for i, x in enumerate(v):
            if not pd.isna(x):
                out.append(x)
                continue
            before = [k for k in known if k < i]
            after = [k for k in known if k > i]
            if before and after and after[0] - before[-1] - 1 <= max_gap:
                a, b = before[-1], after[0]
                out.append(v[a] + (v[b] - v[a]) * (t[i] - t[a]) / (t[b] - t[a]))
            else:
                out.append(None)
    return out


@pytest.mark.parametrize("parts", [1, 5, 17, 60, 300])
@pytest.mark.parametrize("max_gap", [1, 3])
def test_cuts_do_not_change_the_result(spark, parts, max_gap):
    rows = spark.range(600).select(
        F.concat(F.lit("s"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3)).alias("id"),
        (F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("t"),
        F.when(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)) < 5, F.col("id") * 1.5).alias("v"),
    )
    got = interpolate_gaps(rows, ["id"], "t", ["v"], max_gap, parts).orderBy("id", "t").collect()
    want = plain(rows.toPandas(), max_gap)
    assert len(got) == len(want) == 600
    for g, w in zip(got, want):
        assert (g.v is None) == (w is None)
        assert w is None or abs(g.v - w) < 1e-9


def test_ranges_are_even_for_a_long_and_dense_series(spark):
    """A third of all rows in one series, half of these within a minute."""
    t = F.when(F.col("id") < 15_000, 1e9 + F.col("id") * 4e3).when(F.col("id") < 30_000, F.col("id") * 6e8).otherwise(F.col("id") * 1e9)
    s = F.when(F.col("id") < 30_000, 0).otherwise(F.col("id") % 500)
    rows = spark.range(90_000).select(s.alias("id"), t.cast("long").alias("t"), F.lit(1.0).alias("v"))
    sizes = sorted(r["count"] for r in ranges(rows, ["id"], "t", 12).groupBy("_p").count().collect())
    assert len(sizes) == 12 and sizes[-1] < 2 * sizes[6]


def test_series_without_a_name_is_one_series(spark):
    df = spark.createDataFrame([(None, 0, 1.0), (None, 1, None), (None, 2, 3.0), ("a", 1, None)], "id string, t long, v double")
    for parts in (1, 4):
        out = {(r.id, r.t): r.v for r in interpolate_gaps(df, ["id"], "t", ["v"], 1, parts).collect()}
        assert out == {(None, 0): 1.0, (None, 1): 2.0, (None, 2): 3.0, ("a", 1): None}


def test_carry_forward(spark):
    v = [None, 2.0, None, 5.0, None]
    for width in (1, 2, 10):
        df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "id string, t long, v double")
        out = carry_forward(df, ["id"], ["t"], ["v"], F.floor(F.col("t") / width))
        assert [r.v for r in out.orderBy("t").collect()] == [None, 2, 2, 5, 5]


def test_ranges_grow_in_number_with_the_readings(spark, monkeypatch):
    """No range holds more than a fixed number of readings, and the filled values stay the same."""
    df = spark.range(4000).select(F.lit("a").alias("id"), F.col("id").alias("t"), F.when(F.col("id") % 5 > 1, F.col("id") * 1.0).alias("v"))
    monkeypatch.setattr(gaps, "READINGS", 100)
    sizes = [r["count"] for r in ranges(df, ["id"], "t").groupBy("_p").count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 400
    out = {r.t: r.v for r in interpolate_gaps(df, ["id"], "t", ["v"], 3).collect()}
    assert out == {t: (None if t < 2 else float(t)) for t in range(4000)}


def test_only_series_that_may_be_cut_wait_for_other_ranges(spark, monkeypatch):
    """Of a range at most the first and the last series; all others are filled when their range is stored."""
    kept = []
    monkeypatch.setattr(gaps, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    df = spark.range(6000).select(
        F.format_string("s%03d", F.floor(F.col("id") / 20)).alias("id"), F.col("id").alias("t"), F.when(F.col("id") % 3 != 1, F.col("id") * 1.0).alias("v")
    )
    out = {r.t: r.v for r in interpolate_gaps(df, ["id"], "t", ["v"], 1, 6).collect()}
    assert out == {t: None if t % 3 == 1 and t % 20 in (0, 19) else float(t) for t in range(6000)}
    done = kept[0].filter("_side = 0")
    assert done.count() > 5500 and done.filter("v IS NULL AND t % 20 NOT IN (0, 19)").count() == 0
    waiting = kept[0].filter("_side > 0").groupBy("_p").agg(F.countDistinct("id").alias("n"))
    assert waiting.agg(F.max("n")).first()[0] <= 2


@pytest.mark.parametrize("parts", [2, 7, 40])
def test_several_columns_and_shared_times_over_cuts(spark, parts):
    """Rows that share a time, some of them missing, NaN as a known value, whole numbers, and time stamps; against one range."""
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10)) for i in range(3)]
    rows = spark.range(900).select(
        "id", F.when(F.col("id") < 500, "long").otherwise(F.concat(F.lit("s"), F.floor(F.col("id") / 45))).alias("series"),
        F.timestamp_seconds(F.floor(F.col("id") / 2) * 600 + F.when(h[0] < 5, 0).otherwise(60)).alias("time"),
        F.when(h[1] < 4, F.col("id") * 0.7).alias("v"),
        F.when(h[2] < 3, F.col("id").cast("int")).alias("whole"),
        F.when(h[0] < 3, F.when(h[1] < 1, float("nan")).otherwise(F.col("id") * 1.1)).alias("n"),
    )
    columns = ["v", "whole", "n"]
    one, several = (interpolate_gaps(rows, ["series"], "time", columns, 3, n).orderBy("id").collect() for n in (1, parts))
    assert [str(r) for r in one] == [str(r) for r in several]
    before = rows.orderBy("id").collect()
    assert sum(a[c] is None for a in before for c in columns) > sum(b[c] is None for b in one for c in columns) > 0
    assert all(a[c] is None or str(float(a[c])) == str(b[c]) for a, b in zip(before, one) for c in columns)
