"""Reshaping, grids, joins and column picks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.functions.nulls import clamp_negative, round_to
from sensorframe.session import stored

# Cells of a grid that one array of numbers unfolds to.
UNFOLD = 4096

# Tasks over which the rows of a hot join key are spread.
SALTS = 16


def select_cols(
    df: DataFrame,
    prefix: str | None = None,
    suffix: str | None = None,
    regex: str | None = None,
    names: Sequence[str] | None = None,
    drop: bool = False,
) -> DataFrame:
    """Keep (or drop) the columns that meet all given conditions, in their order."""

    def hit(c: str) -> bool:
        return (
            (prefix is None or c.startswith(prefix))
            and (suffix is None or c.endswith(suffix))
            and (regex is None or re.search(regex, c) is not None)
            and (names is None or c in names)
        )

    return df.select(*[c for c in df.columns if hit(c) != drop])


def relocate(df: DataFrame, names: Sequence[str], after: str | None = None) -> DataFrame:
    """Move columns behind another one, or to the front."""
    rest = [c for c in df.columns if c not in names]
    at = rest.index(after) + 1 if after else 0
    return df.select(*rest[:at], *names, *rest[at:])


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long; missing values keep their row."""
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, values: Sequence[str], labels: Sequence, prefix: str = ""
) -> DataFrame:
    """Long to wide for a known list of labels. Several value columns give ``{value}_{label}``."""
    several = len(values) > 1
    aggs = []
    for v in values:
        for label in labels:
            out = f"{v}_{label}" if several else f"{prefix}{label}"
            aggs.append(F.max(F.when(F.col(name) == F.lit(label), F.col(v))).alias(out))
    return df.groupBy(*ids).agg(*aggs)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which a missing key matches a missing key; key columns come out once."""
    keys = list(keys)
    a = left.select(F.struct(*keys).alias("_k"), *[c for c in left.columns if c not in keys])
    b = right.select(F.struct(*keys).alias("_k"), *[c for c in right.columns if c not in keys])
    joined = a.join(b, "_k", how)
    return joined.select("_k.*", *[c for c in joined.columns if c != "_k"])


def salted_join(
    df: DataFrame, compact: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Inner or left join in which the rows of a hot key are spread over several tasks.

    Each row of the compact side is repeated once per salt; the rows of the other side draw their salt
    from a hash of all their columns.
    """
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    right = compact.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def compact_join(df: DataFrame, compact: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left join with a table that is expected to be small.

    No hint: Spark measures the compact side in bytes and broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold``, at run time too. Beyond that both sides are dealt out by key and
    adaptive execution splits hot keys of the large side. Nothing runs while the plan is built.
    """
    return df.join(compact, list(keys), how)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lay compact rows out over all shuffle partitions by key.

    For rows that are small but costly to work on: adaptive execution would pack them into a few tasks by
    their size alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parts_of(spark: SparkSession, count: int, rows: int) -> int:
    """A number of parts for ``count`` rows: the shuffle partitions, or more, so that a part has about ``rows`` of them at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // rows))


def even_parts(df: DataFrame, rows: int) -> int:
    """``parts_of`` for rows that are cheap to count."""
    return parts_of(df.sparkSession, df.count(), rows)


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all tables; a column that one of them lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def double_means(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every double column per group."""
    columns = [c for c, t in df.dtypes if t == "double" and c not in keys]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def _numbered_values(df: DataFrame, dims: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (``_d``, ``_number``, ``_v0``, ``_v1``, …) with the values of each dimension numbered from 0, and one row of their counts.

    All dimensions go in one pass. Values are numbered within hashed parts, and the sizes of the parts give the offsets.
    """
    fields = [[(F.col(c) if c == d else F.lit(None).cast(df.schema[c].dataType)).alias(f"_v{j}") for j, c in enumerate(dims)] for d in dims]
    entries = F.array(*[F.struct(F.lit(i).alias("_d"), *f) for i, f in enumerate(fields)])
    names = [f"_v{j}" for j in range(len(dims))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.inline(entries)).distinct().withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)))
    values = stored(values)
    sizes = values.groupBy("_d", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.sum("_n").over(W.partitionBy("_d").orderBy("_part")) - F.col("_n")
    place = F.row_number().over(W.partitionBy("_d", "_part").orderBy(*names)) - 1
    numbered = values.withColumn("_place", place).join(sizes.select("_d", "_part", offset.alias("_off")), ["_d", "_part"])
    numbered = numbered.select("_d", (F.col("_off") + F.col("_place")).alias("_number"), *names)
    counts = sizes.agg(*[F.sum(F.when(F.col("_d") == i, F.col("_n"))).alias(f"_n{i}") for i in range(len(dims))])
    return numbered, counts


def grid(df: DataFrame, dims: Sequence[str], known: Mapping[str, Sequence] | None = None) -> DataFrame:
    """All combinations of the values of several columns.

    The values of the first column stay a distributed table. A column with values given in ``known`` is unfolded from a
    literal. The values of all others are numbered; every row of the table unfolds the numbers of their
    combinations, and the digits of a number, in the mixed radix of the columns' counts, lead to the values by joins that
    Spark sizes itself. No list of values is ever built. The distinct combinations of ``df`` are stored first, so what
    leads to them runs once.
    """
    known = dict(known or {})
    others = [d for d in dims[1:] if d not in known]
    base = stored(df.select(*dims).distinct())
    out = base.select(dims[0]).distinct()
    if others:
        numbered, counts = _numbered_values(base, others)
        every = F.col("_n0")
        for i in range(1, len(others)):
            every = every * F.col(f"_n{i}")
        out = out.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one")  # one row of counts
        out = out.withColumn("_all", every).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_all - 1) div {UNFOLD}"))))
        first = F.col("_block") * UNFOLD
        out = out.withColumn("_cell", F.explode(F.sequence(first, F.least(first + UNFOLD, F.col("_all")) - 1)))
        for i, d in enumerate(others):
            out = out.withColumn("_number", F.col("_cell") % F.col(f"_n{i}")).withColumn("_cell", F.expr(f"_cell div _n{i}"))
            out = compact_join(out, numbered.filter(F.col("_d") == i).select("_number", F.col(f"_v{i}").alias(d)), ["_number"]).drop("_number")
    for d in dims[1:]:
        if d in known:
            out = out.withColumn(d, F.explode(F.array(*[F.lit(v).cast(df.schema[d].dataType) for v in known[d]])))
    return out.select(*dims)


def missing_cells(df: DataFrame, dims: Sequence[str], **kwargs) -> DataFrame:
    """Combinations of the grid that have no row."""
    cells = grid(df, dims, **kwargs).withColumn("_k", F.struct(*dims))
    present = df.select(F.struct(*dims).alias("_k")).distinct()
    return cells.join(present, "_k", "left_anti").drop("_k")


def complete_grid(df: DataFrame, dims: Sequence[str], fill: Mapping[str, object], **kwargs) -> DataFrame:
    """Add a row for every missing combination and replace missing values of the filled columns.

    The rows are stored first; the grid and the join start from there.
    """
    df = stored(df)
    full = null_safe_join(grid(df, dims, **kwargs), df, dims, "left")
    full = full.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return full.select(*df.columns)


def last_rows(df: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The last ``n`` rows in an order; kept as a top-n, not a full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each group, found by an aggregate that combines before the shuffle."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    pick = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(pick.alias("_first")).select(*keys, "_first._row.*")


def share_of_group_max(df: DataFrame, value: str, keys: Sequence[str], out: str = "prop") -> DataFrame:
    """Whole percentage of the largest value in the group, from already counted rows."""
    top = F.max(value).over(W.partitionBy(*keys))
    return df.withColumn(f"max_{value}", top).withColumn(out, round_to(F.try_divide(F.col(value), top) * 100))


def stacked_totals(df: DataFrame, keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """Lower and upper edge of each bar segment when values are stacked by rank, negatives as zero."""
    w = W.partitionBy(*keys).orderBy(rank).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.withColumn(value, clamp_negative(value)).withColumn("top", F.sum(value).over(w))
    return out.withColumn("bottom", F.col("top") - F.col(value))
