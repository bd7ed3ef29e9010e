"""Permutation moments: rows of many blocks, many responses at once."""

import os
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import sensorframe
from sensorframe import session
from sensorframe.operators import importance


def test_sources_run_the_network_backward(spark):
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).withColumn("sim", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
        rows = importance.with_partner(rows.withColumn("n", F.lit(n).cast("long")), "id", "n", "sim", "to", 4).collect()
        for sim in (1, 2, 3):
            mine = [r for r in rows if r.sim == sim]
            to = np.array([r.to for r in mine])
            assert importance.sources(to, np.full(n, n), sim, 4).tolist() == [r.id for r in mine]


def test_permuted_moments_over_several_blocks(spark):
    """A cell of three blocks and a small one, against rows that meet one by one."""
    rows = spark.range(150_000).select(
        F.when(F.col("id") < 149_000, "a").otherwise("b").alias("k"),
        (F.col("id") * 7919 % 10_007).cast("double").alias("x"), (F.col("id") * 104_729 % 7_001).cast("double").alias("z"), (F.col("id") % 101).cast("double").alias("y"),
    )
    got = {(r.k, r.sim): r.cross for r in importance.permuted_moments(rows, ["k"], "y", ["x", "z"], 2).collect()}
    cell = W.partitionBy("k")
    placed = rows.withColumns({"i": F.row_number().over(cell.orderBy("x", "z", "y")).cast("long") - 1, "n": F.count(F.lit(1)).over(cell)})
    placed = placed.withColumns({c: F.col(c) - F.avg(c).over(cell) for c in "xzy"})
    sims = placed.withColumn("sim", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    sims = importance.with_partner(sims, "i", "n", "sim", "to")
    other = placed.select("k", F.col("i").alias("to"), F.col("x").alias("px"), F.col("z").alias("pz"))
    pairs = [F.avg(F.col(a) * F.col(p)) for a in "xzy" for p in ("px", "pz")]
    want = sims.join(other, ["k", "to"]).groupBy("k", "sim").agg(F.array(*pairs).alias("cross")).collect()
    assert len(got) == len(want) == 4
    for r in want:
        assert got[r.k, r.sim] == pytest.approx(r.cross, rel=1e-6, abs=1e-3)


def test_many_responses_as_one_by_one(spark):
    """Responses known in the same rows or not, one unknown in a cell, and missing predictors."""
    rng = np.random.default_rng(2)
    data = []
    for i in range(300):
        k, x, z = "ab"[i % 2], float(rng.normal()), float(rng.normal())
        y = [float(v) for v in rng.normal(size=4)]
        gap = i % 7 == 0
        data.append((k, None if i == 5 else x, z, y[0], y[1], None if gap else y[2], float("nan") if gap or k == "b" else y[3]))
    df = spark.createDataFrame(data, "k string, x double, z double, y0 double, y1 double, y2 double, y3 double").repartition(3)
    responses = ["y0", "y1", "y2", "y3"]
    shared = {(r.k, r.resp): r._lead for r in importance.same_rows(df, ["k"], responses).collect()}
    assert shared == {("a", "y0"): 0, ("a", "y1"): 0, ("a", "y2"): 2, ("a", "y3"): 2, ("b", "y0"): 0, ("b", "y1"): 0, ("b", "y2"): 2}
    crossed, ranges = importance.permuted_responses(df, ["k"], responses, ["x", "z"], 3)
    got = {(r.k, r.resp, r.sim): r.cross for r in crossed.collect()}
    spans = {(r.k, r.resp, r.Variable): (r.low, r.high, r.distinct) for r in ranges.collect()}
    want, wanted = {}, {}
    for y in responses:
        want |= {(r.k, y, r.sim): r.cross for r in importance.permuted_moments(df, ["k"], y, ["x", "z"], 3).collect()}
        wanted |= {(r.k, y, r.Variable): (r.low, r.high, r.distinct) for r in importance.predictor_ranges(df, ["k"], y, ["x", "z"]).collect()}
    assert spans == wanted and got.keys() == want.keys() and len(want) == 21
    for key, cross in want.items():
        assert got[key] == pytest.approx(cross, abs=1e-12)


def _cells(spark, n):
    """A cell with two thirds of the rows, a smaller one and a tiny one; ties, and responses known in other rows."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 != 0, "a").when(i < n - 30, "b").otherwise("c").alias("k"),
        (i * 7919 % 1_009).cast("double").alias("x"), (i * 104_729 % 53).cast("double").alias("z"),
        (i * 31 % 101).cast("double").alias("y0"), F.when(i % 5 != 0, i * 17 % 97).cast("double").alias("y1"),
    )


def test_portions_and_turns_change_nothing(spark, monkeypatch, request):
    """Cells in several portions, blocks in several turns, some of which get no row: the same as all at a time."""
    def both():
        crossed, ranges = importance.permuted_responses(_cells(spark, 3000), ["k"], ["y0", "y1"], ["x", "z"], 3)
        cross = {(r.k, r.resp, r.sim): r.cross for r in crossed.collect()}
        return cross, {(r.k, r.resp, r.Variable): (r.low, r.high, r.distinct) for r in ranges.collect()}

    met = []
    dealt = importance._dealt
    cloudpickle.register_pickle_by_value(sensorframe)  # so that workers see the patched sizes
    request.addfinalizer(lambda: cloudpickle.unregister_pickle_by_value(sensorframe))
    monkeypatch.setattr(importance, "_dealt", lambda *a: met.append(a[-2:]) or dealt(*a))
    monkeypatch.setattr(importance, "PLACES", 64)
    want, spans = both()
    assert met == [(0, 1)]
    monkeypatch.setattr(importance, "SENT", 1 << 15)
    monkeypatch.setattr(importance, "PORTIONS", 3)
    got, wanted = both()
    assert len(met) > 10 and max(turns for _, turns in met) > 3
    assert spans == wanted and got.keys() == want.keys() and len(want) == 3 * 2 * 3
    for key, cross in want.items():
        assert got[key] == pytest.approx(cross, rel=1e-9, abs=1e-9)


def test_rows_leave_nothing_behind(spark, monkeypatch, tmp_path):
    """Stored rows and shuffled parcels go with the step that needs them, and no row is stored twice at a time."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def size(*tops):
        return sum(os.lstat(f"{d}/{f}").st_size for top in tops for d, _, files in os.walk(top) for f in files if not f.endswith(".crc"))

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(importance, "SENT", 1 << 20, raising=False)
    rows = _cells(spark, 30_000).withColumn("noise", F.rand(3))
    rows.write.parquet(f"{tmp_path}-rows")
    one = size(f"{tmp_path}-rows")
    before, peaks = size(*local), []
    dealt = importance._dealt
    monkeypatch.setattr(importance, "_dealt", lambda *a: peaks.append(size(tmp_path)) or dealt(*a))
    crossed, ranges = importance.permuted_responses(spark.read.parquet(f"{tmp_path}-rows"), ["k"], ["y0", "y1", "noise"], ["x", "z"], 3)
    assert max(peaks) < 2.5 * one and len(peaks) > 4
    deadline = time.time() + 30
    while size(*local) - before > one / 2 and time.time() < deadline:
        time.sleep(0.5)  # the files go in the background
    assert size(*local) - before < one / 2 and size(tmp_path) < one / 2
    assert crossed.count() == 3 * 3 * 3 and ranges.count() == 3 * 3 * 2
