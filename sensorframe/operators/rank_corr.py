"""Rank correlation per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.operators.clean import complete_cases
from sensorframe.operators.order_stats import mean_ranks
from sensorframe.operators.reshape import even_parts
from sensorframe.session import stored

# Rows whose ranks meet in one task.
TOGETHER = 1 << 18


def spearman(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns over the complete rows of each group, in long form.

    All columns are ranked in one pass over long rows, which carry the number of their row, and one grouped pass brings
    a row's ranks together by that number. Ranks are centred on their known mean, so only sums of products are left to add up.
    """
    keys, columns = list(keys), list(columns)
    rows = complete_cases(df, [*keys, *columns]).select(*keys, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    each = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_x{i}").alias("_x")) for i in range(len(columns))])
    long = rows.select(*keys, "_row", F.inline(each))
    ranks = mean_ranks(long, [*keys, "_c"], "_x", "_rank")
    centred = ranks.select(*keys, "_row", "_c", (F.col("_rank") - (F.col("total") + 1) / 2.0).alias("_rank"))
    together = centred.repartition(even_parts(rows, TOGETHER), *keys, "_row").groupBy(*keys, "_row").agg(
        *[F.max(F.when(F.col("_c") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(columns))]
    )
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    cells = together.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"_r{i}") * F.col(f"_r{j}")).alias(f"_s{i}_{j}") for i, j in pairs],
    )
    entries = []
    for i, j in pairs:
        rho = F.try_divide(F.col(f"_s{i}_{j}"), F.sqrt(F.col(f"_s{i}_{i}") * F.col(f"_s{j}_{j}")))
        for a, b in {(i, j), (j, i)}:
            entries.append(F.struct(F.lit(columns[a]).alias("x"), F.lit(columns[b]).alias("y"), rho.alias("rho")))
    return cells.select(*keys, "n", F.inline(F.array(*entries)))
