"""Local quadratic smoothing per group on an even grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.functions.nulls import is_finite
from sensorframe.operators.order_stats import select_ranks
from sensorframe.operators.reshape import compact_join
from sensorframe.session import stored

# Cells of the histogram between two neighbouring places.
CELLS = 16


def _solve(s: list[Column]) -> list[Column]:
    """First row of the inverse of the 3x3 moment matrix, each entry null where it is singular."""
    c0 = s[2] * s[4] - s[3] * s[3]
    c1 = s[2] * s[3] - s[1] * s[4]
    c2 = s[1] * s[3] - s[2] * s[2]
    det = s[0] * c0 + s[1] * c1 + s[2] * c2
    det = F.when(F.abs(det) > F.lit(1e-12) * s[0] * s[0] * s[0], det)
    return [c / det for c in (c0, c1, c2)]


def _in_cells(at_x: DataFrame, extent: DataFrame, points: int) -> DataFrame:
    """Rows with the cell of the histogram that holds their ``x``; its borders include all places."""
    cells = CELLS * (points - 1)
    share = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return compact_join(at_x, extent, ["_k"]).withColumn("cell", F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int"))


def _spans(at_x: DataFrame, extent: DataFrame, span: float, points: int) -> DataFrame:
    """Per place ``j`` at ``g``: the first and last cell of its width, and the wanted rank among the rows of these two.

    Cells at the same distance on both sides of a place are taken together, as a place is a border of cells.
    """
    cells = CELLS * (points - 1)
    counts = _in_cells(at_x, extent, points).groupBy("_k", "cell").agg(F.sum("n").alias("n"))
    # One row per group, of as many numbers as there are cells.
    groups = counts.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.sum("n").alias("total"))
    upto = F.aggregate(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        F.array(F.lit(0).cast("long")),
        lambda done, c: F.concat(done, F.array(F.element_at(done, -1) + F.coalesce(F.try_element_at("m", c), F.lit(0)))),
    )
    groups = compact_join(groups.select("_k", "total", upto.alias("upto")), extent, ["_k"])
    places = groups.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("j") * CELLS

    def within(distance: Column) -> Column:
        """Rows in cells up to that distance, 0 for the two next to the place."""
        last, first = F.least(at + distance + 1, F.lit(cells)), F.greatest(at - distance - 1, F.lit(0))
        return F.get("upto", last.cast("int")) - F.get("upto", first.cast("int"))

    nearest = F.least(F.greatest(F.floor(F.col("total") * span + 1e-5), F.lit(1)), F.col("total"))
    places = places.withColumn("nearest", nearest.cast("long"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["few"] + s["enough"]) / 2).cast("int")
        holds = within(middle) >= F.col("nearest")
        return F.when(s["enough"] - s["few"] <= 1, s).otherwise(
            F.struct(F.when(holds, s["few"]).otherwise(middle).alias("few"), F.when(holds, middle).otherwise(s["enough"]).alias("enough"))
        )

    start = F.struct(F.lit(-1).alias("few"), F.lit(cells).alias("enough"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(cells.bit_length() + 1)), start, halve)
    places = places.withColumn("ring", found["enough"])
    inner = F.when(F.col("ring") > 0, within(F.col("ring") - 1)).otherwise(0)
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    return places.select(
        "_k", "j", (F.col("lo") + step * F.col("j")).alias("g"),
        (at - F.col("ring") - 1).alias("first"), (at + F.col("ring")).alias("last"),
        (F.col("nearest") - inner - 1).cast("long").alias("wanted"),
    )


def loess(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    span: float = 0.75,
    points: int = K.SMOOTH_POINTS,
    se: bool = False,
) -> DataFrame:
    """Smooth ``y`` over a numeric ``x`` per group at ``points`` even places: ``keys, x, fit[, se]``.

    Rows with equal ``x`` are summed up first and stored. Around each place the nearest ``span`` share of the rows is
    weighted by the tricube of its distance. Counts per cell of an even histogram tell in which cells a place's width
    ends; its exact value is an order statistic of the rows in these cells alone. Then a place meets the rows of the
    cells within its width, and weighted power sums give the local fit. ``se`` uses the residual variance
    and leverages interpolated between places. A ``span`` above 1 takes all rows and widens the largest distance by
    it. Every place comes back; ``fit`` is null where too few different ``x`` lie within the width.
    """
    rows = df.filter(is_finite(x) & is_finite(y)).select(
        F.struct(*keys).alias("_k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    at_x = rows.groupBy("_k", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")
    )
    at_x = stored(at_x)
    extent = at_x.groupBy("_k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spans = stored(_spans(at_x, extent, span, points))
    bands = spans.withColumn("at", F.explode(F.sequence(F.greatest(F.col("first"), F.lit(0)), F.least(F.col("last"), F.lit(CELLS * (points - 1) - 1)))))
    located = _in_cells(at_x, extent, points).select("_k", F.col("cell").alias("at"), "x", "n", "sy")
    # The rows of the two outer cells of a width decide it: the wanted one has ``inner`` rows nearer to the place.
    ends = bands.filter((F.col("at") == F.col("first")) | (F.col("at") == F.col("last")))
    ends = compact_join(located, ends.select("_k", "j", "g", "at", "wanted"), ["_k", "at"])
    ends = ends.select(F.struct("_k", "j", "wanted").alias("_kj"), "n", F.abs(F.col("x") - F.col("g")).alias("size"))
    widths = select_ranks(ends, "_kj", "size", [F.col("_kj.wanted")], weight="n")
    widths = widths.select("_kj._k", "_kj.j", (F.col("r0") * max(span, 1.0)).alias("h"))
    places = spans.select("_k", "j", "g")
    bands = compact_join(bands.select("_k", "j", "g", "at"), widths, ["_k", "j"])
    near = compact_join(located, bands, ["_k", "at"]).withColumn("d", F.col("x") - F.col("g")).filter(F.abs("d") < F.col("h"))
    near = near.withColumn("_kj", F.struct("_k", "j", "g"))
    u = F.col("d") / F.col("h")
    edge = 1 - F.pow(F.abs(u), 3)
    w = edge * edge * edge
    powers = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u]
    sums = near.groupBy("_kj").agg(
        *[F.sum(w * p * F.col("n")).alias(f"s{i}") for i, p in enumerate(powers)],
        *[F.sum(w * p * F.col("sy")).alias(f"t{i}") for i, p in enumerate(powers[:3])],
        *[F.sum(w * w * p * F.col("n")).alias(f"v{i}") for i, p in enumerate(powers)],
    )
    sums = places.select(F.struct("_k", "j", "g").alias("_kj")).join(sums, "_kj", "left")
    a, b, c = _solve([F.col(f"s{i}") for i in range(5)])
    v = [F.col(f"v{i}") for i in range(5)]
    out = sums.select(
        F.col("_kj._k").alias("_k"),
        F.col("_kj.j").alias("j"),
        F.col("_kj.g").alias("x"),
        (a * F.col("t0") + b * F.col("t1") + c * F.col("t2")).alias("fit"),
        a.alias("leverage"),
        (
            a * a * v[0]
            + 2 * a * b * v[1]
            + (b * b + 2 * a * c) * v[2]
            + 2 * b * c * v[3]
            + c * c * v[4]
        ).alias("spread"),
    )
    if not se:
        return out.select("_k.*", "x", "fit")
    out = stored(out)  # groups times places; used three times below
    place = (F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / (points - 1))
    located = (
        compact_join(at_x, extent, ["_k"])
        .withColumn("j", F.least(F.floor(place), F.lit(points - 2)).cast("int"))
        .withColumn("share", place - F.col("j"))
        .select("_k", "j", "share", "n", "sy", "syy")
    )
    left = out.select("_k", "j", *[F.col(m).alias(f"l_{m}") for m in ("fit", "leverage", "spread")])
    right = out.select("_k", (F.col("j") - 1).alias("j"), *[F.col(m).alias(f"r_{m}") for m in ("fit", "leverage", "spread")])
    segments = left.join(right, ["_k", "j"])

    def between(m: str) -> Column:
        return F.col(f"l_{m}") + (F.col(f"r_{m}") - F.col(f"l_{m}")) * F.col("share")

    f = between("fit")
    variance = (
        compact_join(located, segments, ["_k", "j"])
        .groupBy("_k")
        .agg(
            F.sum(F.col("syy") - 2 * f * F.col("sy") + f * f * F.col("n")).alias("rss"),
            F.sum(F.col("n") * (1 - 2 * between("leverage") + between("spread"))).alias("dof"),
        )
        .select("_k", F.try_divide(F.col("rss"), F.col("dof")).alias("sigma2"))
    )
    return out.join(variance, "_k").select("_k.*", "x", "fit", F.sqrt(F.col("sigma2") * F.col("spread")).alias("se"))
