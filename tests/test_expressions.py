import pytest
from pyspark.sql import functions as F

from sensorframe.functions import dates, labels, nulls


def one(spark, schema, rows, *exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_is_finite(spark):
    rows = [(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    assert [r[0] for r in one(spark, "x double", rows, nulls.is_finite("x"))] == [True, False, False, False, False]


def test_if_else_keeps_unknown(spark):
    got = one(spark, "x int", [(1,), (0,), (None,)], nulls.if_else(F.col("x") > 0, "y", "n"))
    assert [g[0] for g in got] == ["y", "n", None]


def test_in_set_is_false_for_null(spark):
    assert [g[0] for g in one(spark, "x string", [("a",), (None,)], ~nulls.in_set("x", ["a"]))] == [False, True]


@pytest.mark.parametrize("values, want", [([1.0, None], None), ([1.0, 3.0], 2.0)])
def test_strict_mean(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.agg(nulls.strict_mean("x")).first()[0] == want


def test_weighted_mean_without_weight(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0)], "x double, w double")
    assert df.agg(nulls.weighted_mean("x", "w")).first()[0] is None


def test_finite_share(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert df.agg(nulls.finite_share("x")).first()[0] == 25.0


def test_round_to_sends_ties_up(spark):
    got = one(spark, "x double", [(1.005,), (0.125,), (-0.125,), (2.5,), (None,)], nulls.round_to("x", 2))
    assert [g[0] for g in got] == [1.01, 0.13, -0.12, 2.5, None]


def test_clamp_negative(spark):
    assert [g[0] for g in one(spark, "x double", [(-1.0,), (2.0,), (None,)], nulls.clamp_negative("x"))] == [0, 2, None]


def test_local_date_crosses_midnight(spark):
    got = one(spark, "s string", [("2019-10-31 22:30:00",)], dates.local_time(F.to_timestamp("s")).cast("string"))
    assert got[0][0] == "2019-11-01 00:30:00"


def test_month_sequence_stops_before_an_unreached_month(spark):
    got = one(
        spark, "a string, b string", [("2019-10-28", "2020-05-04")],
        dates.month_sequence(F.col("a").cast("date"), F.col("b").cast("date")),
    )
    assert got[0][0] == [10, 11, 12, 1, 2, 3, 4]


def test_study_calendar(spark):
    got = one(spark, "m int", [(11,), (1,), (10,), (None,)], dates.study_year("m"), dates.hydro_rank("m"), dates.month_label("m"))
    assert got == [(2019, 1, "Nov"), (2020, 3, "Jan"), (2020, 12, "Oct"), (None, None, None)]


def test_labels(spark):
    assert one(spark, "s string", [("pisr_m7_50m",), ("x",)], labels.month_from_name("s")) == [(7,), (None,)]
    assert one(spark, "s string", [("POS",), ("NEG",), (None,)], labels.sign_value("s")) == [(1,), (-1,), (None,)]
    assert one(spark, "s string", [("T1_mean",)], labels.split_part("s", 2), labels.split_part("s", 3)) == [("mean", None)]
    order = one(spark, "s string", [("b",), ("z",)], labels.rank_of("s", ["a", "b"]), labels.recode("s", {"b": "B"}))
    assert order == [(2, "B"), (None, "z")]


def test_p_classes(spark):
    got = one(spark, "p double", [(0.0,), (0.001,), (0.01,), (0.7,), (None,)], labels.p_class("p"))
    assert [g[0] for g in got] == [None, "< 0.001", "0.01 - 0.001", "1 - 0.5", None]


@pytest.mark.parametrize("values, want", [(["a", "a", None], "a"), (["a", "c"], "b"), ([None], None)])
def test_collapse_label(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    assert df.agg(labels.collapse_label("x")).first()[0] == want


def test_round_to_leaves_what_cannot_be_rounded(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1e15, 1.7e300, -1e17]
    got = [g[0] for g in one(spark, "x double", [(v,) for v in values], nulls.round_to("x", 6))]
    assert got[0] != got[0] and got[1:] == values[1:]
    assert [g[0] for g in one(spark, "x double", [(0.49999995,), (0.5,)], nulls.round_to("x"))] == [0.0, 1.0]
