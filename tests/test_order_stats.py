import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import order_stats
from sensorframe.operators.order_stats import exact_quantiles, magnitude_bucket, mean_ranks, select_ranks, sortable
from sensorframe.session import stored


def test_known_quantiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 8, 16)], "k string, v double")
    q = exact_quantiles(df, ["k"], ["v"], [0.99, 0.95, 0.5]).first().q
    assert q == pytest.approx([15.68, 14.4, 4.0])


def test_group_of_missing_values_stays(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), (None, 3.0), ("b", float("nan"))], "k string, v double")
    rows = {r.k: r.q for r in exact_quantiles(df, ["k"], ["v"], [0.5]).collect()}
    assert rows == {"a": [None], "b": [None], None: [2.0]}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = {
        "wide": rng.normal(0, 1e6, 999) ** 3,
        "ties": rng.integers(-3, 4, 500).astype(float),
        "small": rng.normal(0, 1e-7, 400),
        "one": np.array([7.0]),
        "tiny": np.array([0.0, 5e-324, -5e-324, 1e308, -1e308]),
    }
    rows = [(k, float(x)) for k, v in data.items() for x in v]
    p = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in exact_quantiles(df, ["k"], ["v"], p).collect():
        assert r.q == pytest.approx(list(np.quantile(data[r.k], p)), rel=1e-12)


def test_buckets_follow_the_order(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 2000) * 10.0 ** rng.integers(-200, 200, 2000), 2.0 ** np.arange(-40, 40)])
    x = np.concatenate([x, np.nextafter(2.0 ** np.arange(-40, 40), 0), [np.inf, -np.inf, 0.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    rows = df.select("v", magnitude_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    b = [r.b for r in rows]
    assert b == sorted(b)


def test_sortable_bits_are_those_of_the_number(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 500) * 10.0 ** rng.integers(-300, 300, 500), 2.0 ** np.arange(-1022, 1023, 7)])
    x = np.concatenate([x, np.nextafter(x, 0), np.nextafter(x, np.inf), [5e-324, 1e-310, np.inf]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for r in df.select("v", sortable(F.col("v")).alias("b")).collect():
        assert r.b == int(np.abs(np.float64(r.v)).view(np.int64)) * (1 if r.v >= 0 else -1)


@pytest.mark.parametrize("values", [[5, 1, 5, 9], [3] * 400, list(range(300)) + [150] * 500 + [7, 7]])
def test_mean_ranks_of_values_over_several_ranges(spark, values):
    rows = [(k, float(v), i) for k in "ab" for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(4)
    got = {(r.k, r.i): (r["rank"], r.total) for r in mean_ranks(df, ["k"], "v").collect()}
    for i, v in enumerate(values):
        before, same = sum(x < v for x in values), sum(x == v for x in values)
        assert got["a", i] == got["b", i] == (before + (same + 1) / 2, len(values))


def test_time_stamps_of_one_day(spark, monkeypatch):
    """Microseconds of a day lie in a few first buckets; what is sorted in the end is far less."""
    df = spark.range(86_400).select(F.lit("a").alias("k"), (F.lit(1.6e15) + F.col("id") * 1e6).alias("v"))
    q = exact_quantiles(df, ["k"], ["v"], [0.0, 0.3, 1.0]).first().q
    assert q == [1.6e15, 1.6e15 + 0.3 * 86_399e6, 1.6e15 + 86_399e6]
    assert df.select(magnitude_bucket(F.col("v"))).distinct().count() < 10
    left = df.groupBy(F.shiftright(sortable(F.col("v")), 18)).count().agg(F.max("count")).first()[0]
    assert left == 1


def test_narrow_ranges_fill_many_buckets(spark):
    df = spark.range(1_000_000).select((F.col("id") / 1e6 + 1000).alias("v"))
    sizes = df.groupBy(magnitude_bucket(F.col("v")).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 10_000


def test_ranges_of_ranks_grow_in_number_with_the_rows(spark, monkeypatch):
    """One frequent value and others over many small ranges; no range gets a large share."""
    monkeypatch.setattr(order_stats, "RANKED", 50)
    kept = []
    monkeypatch.setattr(order_stats, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    df = spark.range(2000).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("v"))
    got = {r.i: r["rank"] for r in mean_ranks(df, ["k"], "v").collect()}
    assert got == {i: 500.5 if i % 2 == 0 else 1000 + (i + 1) / 2 for i in range(2000)}
    assert max(r["count"] for r in kept[0].groupBy("_p").count().collect()) < 200


@pytest.mark.parametrize("most", [0, 60, 1000])
def test_small_groups_are_sorted_and_large_ones_selected(spark, monkeypatch, most):
    """Group sizes 1 to 120, one without a name and one without values; the bound between both ways changes nothing."""
    called = []
    monkeypatch.setattr(order_stats, "SORTED", most)
    monkeypatch.setattr(order_stats, "select_ranks", lambda *args: called.append(1) or select_ranks(*args))
    rng = np.random.default_rng(8)
    data = {k: rng.normal(0, 100, n).round(1).tolist() for k, n in [("a", 120), ("b", 61), ("c", 60), ("d", 1), (None, 80)]}
    data |= {"none": [None, float("nan")], "some": [3.0, None, float("nan"), -1.0]}
    rows = [(k, x, -x if x is not None and k != "d" else None) for k, v in data.items() for x in v]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    p = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r.k, r.name): r.q for r in exact_quantiles(df, ["k"], ["v", "w"], p).collect()}
    assert len(got) == 2 * len(data)
    for k, v in data.items():
        known = np.array([x for x in v if x is not None and x == x])
        for name, values in (("v", known), ("w", [] if k == "d" else -known)):
            want = list(np.quantile(values, p)) if len(values) else [None] * len(p)
            assert got[k, name] == (pytest.approx(want, rel=1e-12) if len(values) else want)
    assert bool(called) == (most < 120)
