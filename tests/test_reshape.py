import pytest
from pyspark.sql import functions as F

from sensorframe.operators import reshape


@pytest.mark.parametrize("known", [None, {"y": [1, 2]}])
def test_grid_fill(spark, known):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 7.0)], "x string, y int, v double")
    out = reshape.complete_grid(df, ["x", "y"], {"v": 0.0}, known=known)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, 5.0), ("a", 2, 0.0), ("b", 1, 0.0), ("b", 2, 7.0)]
    assert sorted(tuple(r) for r in reshape.missing_cells(df, ["x", "y"], known=known).collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("unfold", [4096, 3])
def test_grid_size_is_the_product(spark, monkeypatch, unfold):
    monkeypatch.setattr(reshape, "UNFOLD", unfold)
    df = spark.range(60).select((F.col("id") % 5).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") % 3).alias("c"))
    g = reshape.grid(df.filter("id < 13"), ["a", "b", "c"])
    assert g.count() == g.distinct().count() == 60
    assert "CartesianProduct" not in g._jdf.queryExecution().executedPlan().toString()


def test_grid_with_missing_value(spark):
    df = spark.createDataFrame([("a", None), ("b", 1)], "x string, y int")
    assert reshape.grid(df, ["x", "y"]).count() == 4
    assert reshape.grid(df.filter("false"), ["x", "y"]).count() == 0


def test_full_join_on_missing_key(spark):
    a = spark.createDataFrame([(1, None, "l")], "k int, j int, a string")
    b = spark.createDataFrame([(1, None, "r"), (2, 2, "s")], "k int, j int, b string")
    rows = sorted((tuple(r) for r in reshape.null_safe_join(a, b, ["k", "j"], "full").collect()), key=str)
    assert rows == [(1, None, "l", "r"), (2, 2, None, "s")]


def test_long_and_back(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 4.0)], "k string, x double, y double")
    long = reshape.to_long(df, ["k"], ["x", "y"], "n", "v")
    assert long.count() == 4
    assert sorted(map(tuple, reshape.to_wide(long, ["k"], "n", ["v"], ["x", "y"]).collect())) == sorted(map(tuple, df.collect()))
    wide = reshape.to_wide(long.withColumn("w", F.col("v")), ["k"], "n", ["v", "w"], ["x", "y"])
    assert wide.columns == ["k", "v_x", "v_y", "w_x", "w_y"]


def test_column_picks(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, T1_mean int, T2_mean int, moist int")
    assert reshape.select_cols(df, prefix="T", suffix="mean").columns == ["T1_mean", "T2_mean"]
    assert reshape.select_cols(df, regex="^T", drop=True).columns == ["id", "moist"]
    assert reshape.relocate(df, ["moist"], "id").columns == ["id", "moist", "T1_mean", "T2_mean"]
    assert reshape.relocate(df, ["moist"]).columns[0] == "moist"


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, 5), ("a", 1, 6), ("b", 9, 7)], "k string, t int, v int")
    assert sorted(map(tuple, reshape.first_per_group(df, ["k"], ["t"]).collect())) == [("a", 1, 6), ("b", 9, 7)]
    assert [r.t for r in reshape.last_rows(df, ["t"], 2).collect()] == [9, 2]


def test_salted_join_keeps_every_match(spark):
    big = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    out = reshape.salted_join(big, small, ["k"])
    assert out.count() == 1000 and out.columns == ["k", "id", "v"]


def test_shares_and_stacks(spark):
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, -2.0), ("a", 3, 1.0)], "k string, r int, v double")
    s = reshape.stacked_totals(df, ["k"], "r", "v").orderBy("r").collect()
    assert [(x.bottom, x.top) for x in s] == [(0, 4), (4, 4), (4, 5)]
    p = reshape.share_of_group_max(df.filter("v > 0"), "v", ["k"]).orderBy("r").collect()
    assert [x.prop for x in p] == [100, 25]


@pytest.mark.parametrize("how, rows", [("inner", 1), ("left", 2)])
def test_compact_join_leaves_the_choice_to_spark(spark, how, rows):
    df = spark.createDataFrame([("a", 1), ("z", 2)], "k string, x int")
    compact = spark.createDataFrame([("a", 7), ("b", 8)], "k string, v int")
    out = reshape.compact_join(df, compact, ["k"], how)
    assert out.count() == rows and out.columns == ["k", "x", "v"]
    assert out.filter("k = 'a'").first().v == 7
    assert "strategy=broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_grids_never_hold_all_ids_in_one_array(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    cells = reshape.grid(df, ["a", "b"])
    assert cells.distinct().count() == 90_000
    assert "collect_list" not in cells._jdf.queryExecution().optimizedPlan().toString()
