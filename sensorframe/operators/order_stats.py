"""Exact quantiles and ranks without bringing a large group into one task.

Groups of at most ``SORTED`` rows have their values sorted, each group by itself, in one pass. In larger ones quantiles
are found by radix selection on the bits of a number: equal values are counted first (with map-side combine), then counts by the leading bits tell which bucket holds a wanted rank, and within it counts by the next bits.
What is left to sort has equal leading bits but the last 18, whatever the data. Ranks of all rows come from ranges of rows:
each range is ranked by itself, and one row per range tells what lies before it. Both are exact for any data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators.reshape import compact_join, even_parts
from sensorframe.session import stored

# Bits of a number below the first and the second digit of the selection.
FIRST, SECOND = 36, 18
_MISSING = -(10**18)
# Rows of a group whose values are sorted together for its quantiles.
SORTED = 1 << 14
# Rows of a range that are ranked together.
RANKED = 1 << 20


def sortable(value: Column) -> Column:
    """The bits of a double as a whole number in the order of the values: octave, then the fraction within it.

    An octave that the logarithm puts one too high or too low is set right by comparing with the powers of two.
    """
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022)).cast("long")
    two = F.lit(2.0)
    octave = guess + (size >= F.pow(two, guess + 1)).cast("long") - ((size < F.pow(two, guess)) & (guess > -1022)).cast("long")
    fraction = F.floor((size / F.pow(two, octave) - 1) * float(1 << 52)).cast("long")
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).otherwise((octave + 1023) * (1 << 52) + fraction)
    return F.when(value == 0, F.lit(0)).when(value > 0, bits).otherwise(-bits).cast("long")


def magnitude_bucket(value: Column) -> Column:
    """A whole number that never decreases with the value: 65,536 steps per power of two, sign included."""
    return F.shiftright(sortable(value), FIRST)


def _counted(df: DataFrame, group: str, value: str, weight: str | None) -> DataFrame:
    """Every distinct value with its count ``n`` and its first digit; missing values count nothing but keep their group."""
    number = F.col(value).cast("double")
    number = F.when(~F.isnan(number), number)
    one = F.lit(1) if weight is None else F.col(weight)
    counted = df.select(F.col(group), number.alias(value), one.cast("long").alias("n")).groupBy(group, value).agg(F.sum("n").alias("n"))
    counted = counted.withColumn("n", F.when(F.col(value).isNull(), F.lit(0).cast("long")).otherwise(F.col("n")))
    return counted.withColumn("_b", F.coalesce(magnitude_bucket(F.col(value)), F.lit(_MISSING)))


def _holding(ranks: Sequence[Column], before: Column, n: Column) -> Column:
    """Whether one of the ranks is among ``n`` values with ``before`` smaller ones."""
    out = F.lit(False)
    for r in ranks:
        out = out | ((r >= before) & (r < before + n))
    return out


def select_ranks(df: DataFrame, group: str, value: str, ranks: Sequence[Column], weight: str | None = None) -> DataFrame:
    """One row per group with ``total`` and the values at the given 0-based ranks, ``r0``, ``r1``, …

    ``ranks`` are expressions over ``total`` and the group. Missing values count as nothing but keep their group in the
    result. With ``weight`` a row counts that often. Only buckets that hold a wanted rank are looked into, twice: the
    second time by 18 more bits.
    """
    counted = _counted(df, group, value, weight)

    def running(*part: str) -> Column:
        *outer, digit = part
        return F.coalesce(F.sum("_bn").over(W.partitionBy(*outer).orderBy(digit).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    first = counted.groupBy(group, "_b").agg(F.sum("n").alias("_bn"))
    first = first.withColumns({"_off": running(group, "_b"), "total": F.sum("_bn").over(W.partitionBy(group))})
    first = first.filter((F.col("_b") == _MISSING) | _holding(ranks, F.col("_off"), F.col("_bn")))
    rest = counted.join(first.select(group, "_b", "_off", "total"), [group, "_b"])
    rest = rest.withColumn("_s", F.coalesce(F.shiftright(sortable(F.col(value)), SECOND), F.lit(_MISSING)))

    second = rest.groupBy(group, "_b", "_s").agg(F.sum("n").alias("_bn"), F.min("_off").alias("_off"), F.min("total").alias("total"))
    second = second.withColumn("_off", F.col("_off") + running(group, "_b", "_s"))
    second = second.filter((F.col("_s") == _MISSING) | _holding(ranks, F.col("_off"), F.col("_bn")))
    rest = rest.select(group, "_s", value, "n").join(second.select(group, "_s", "_off", "total"), [group, "_s"])

    inside = W.partitionBy(group, "_s").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = rest.withColumn("before", F.col("_off") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    here = [(r >= F.col("before")) & (r < F.col("before") + F.col("n")) for r in ranks]
    return placed.groupBy(group).agg(
        F.max("total").alias("total"),
        *[F.max(F.when(h, F.col(value))).alias(f"r{i}") for i, h in enumerate(here)],
    )


def mean_ranks(rows: DataFrame, group: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """The rows with the mean 1-based rank of their value in their group, equal values sharing it, and the group's ``total``.

    Values and group columns are not missing. Rows are dealt into ranges of equal size, within a frequent value
    too, and ranked there; there are more ranges for more rows, so a range stays small. One row per group and range holds its count and its smallest and largest value, which
    alone may lie in several ranges; so no value of a row has to be looked up.
    """
    names, group = rows.columns, list(group)
    tie = F.xxhash64(*[c for c in names if c not in group])
    parts = even_parts(rows, RANKED)
    ranged = rows.withColumn("_t", tie).repartitionByRange(parts, *group, value, "_t").withColumn("_p", F.spark_partition_id())
    ranged = ranged.repartition(parts, *group, "_p")
    ordered = W.partitionBy(*group, "_p").orderBy(value)
    first = F.rank().over(ordered)
    peers = F.count(F.lit(1)).over(ordered.rangeBetween(W.currentRow, W.currentRow))
    ranged = stored(ranged.drop("_t").withColumns({"_first": first, "_peers": peers}))
    ranges = ranged.groupBy(*group, "_p").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
        F.max(F.when(F.col("_first") == 1, F.col("_peers"))).alias("_low_n"),
        F.max("_first").alias("_high_first"),
    )
    earlier = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offset, total = F.coalesce(F.sum("_n").over(earlier), F.lit(0)), F.sum("_n").over(W.partitionBy(*group))
    ranges = ranges.withColumns({"_off": offset, "total": total})
    low = F.struct(F.col("_low").alias("v"), F.col("_low_n").alias("n"), F.col("_off").alias("before"))
    upper = F.col("_off") + F.col("_high_first") - 1
    high = F.struct(F.col("_high").alias("v"), (F.col("_off") + F.col("_n") - upper).alias("n"), upper.alias("before"))
    both = F.when(F.col("_low") == F.col("_high"), F.array(low)).otherwise(F.array(low, high))
    ends = ranges.select(*group, "_p", "_off", "total", F.explode(both).alias("_e"))
    # An end value's rows lie in neighbouring ranges: their number, and what is before the first of them.
    same = W.partitionBy(*group, "_e.v")
    middle = F.min("_e.before").over(same) + (F.sum("_e.n").over(same) + 1) / 2.0
    ends = ends.select(*group, "_p", "_off", "total", F.struct(F.col("_e.v").alias("v"), middle.alias("rank")).alias("_e"))
    ends = ends.groupBy(*group, "_p").agg(
        F.min("_off").alias("_off"), F.min("total").alias("total"), F.min("_e").alias("_low"), F.max("_e").alias("_high")
    )
    placed = compact_join(ranged, stored(ends), [*group, "_p"])
    rank = F.when(F.col(value) == F.col("_low.v"), F.col("_low.rank")).when(F.col(value) == F.col("_high.v"), F.col("_high.rank"))
    rank = rank.otherwise(F.col("_off") + F.col("_first") + (F.col("_peers") - 1) / 2.0)
    return placed.select(*names, rank.alias(out), "total")


def _on_line(low: Column, high: Column, place: Column) -> Column:
    return low + (high - low) * (place - F.floor(place))


def _sorted_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float], name: str) -> DataFrame:
    """Quantiles of groups that are small enough for their values to be sorted together."""
    lists = []
    for i, c in enumerate(columns):
        number = F.col(c).cast("double")
        lists.append(F.sort_array(F.collect_list(F.when(~F.isnan(number), number))).alias(f"_v{i}"))
    entries = []
    for i, c in enumerate(columns):
        places = [(F.size(f"_v{i}") - 1) * F.lit(float(p)) for p in probabilities]
        # Places outside an empty list give null.
        values = [_on_line(*[F.get(f"_v{i}", f(p).cast("int")) for f in (F.floor, F.ceil)], p) for p in places]
        entries.append(F.struct(F.lit(c).alias(name), F.array(*values).alias("q")))
    return df.groupBy(*keys).agg(*lists).select(*keys, F.inline(F.array(*entries)))


def _selected_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float], name: str) -> DataFrame:
    """Quantiles of groups of any size."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(
        F.struct(*keys, F.col("_p.name").alias(name)).alias("_k"), F.col("_p.value").alias("value")
    )
    places = [(F.col("total") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = [f(p) for p in places for f in (F.floor, F.ceil)]
    found = select_ranks(long, "_k", "value", ranks)
    values = [_on_line(F.col(f"r{2 * i}"), F.col(f"r{2 * i + 1}"), place) for i, place in enumerate(places)]
    return found.select("_k.*", F.array(*values).alias("q"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float], name: str = "name"
) -> DataFrame:
    """Linear-interpolation quantiles of several columns per group.

    Gives one row per group and column: ``keys``, the column's ``name`` and ``q``, an array in the order of
    ``probabilities`` (null where the group has no value). The rows of the groups are counted first: groups of more than ``SORTED``
    rows go by radix selection, the others have their values sorted. Both give the same.
    """
    keys, columns = list(keys), list(columns)
    args = (keys, columns, probabilities, name)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = F.col("_n") > SORTED
    many, few = sizes.agg(F.count_if(over), F.count_if(~over)).first()
    if not many:
        return _sorted_quantiles(df, *args)
    if not few:
        return _selected_quantiles(df, *args)
    group = F.struct(F.lit(0).alias("_all"), *keys).alias("_k")
    large = stored(sizes.filter(over).select(group))
    rows = df.select(group, *dict.fromkeys([*keys, *columns]))
    small, rest = (compact_join(rows, large, ["_k"], how).drop("_k") for how in ("left_anti", "left_semi"))
    return _sorted_quantiles(small, *args).unionByName(_selected_quantiles(rest, *args))


def wide_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float],
    labels: Sequence[str],
) -> DataFrame:
    """The same, one row per group with columns ``{column}_{label}``."""
    quantiles = exact_quantiles(df, keys, columns, probabilities, "_name")
    return quantiles.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_name") == c, F.col("q")[i])).alias(f"{c}_{label}")
            for c in columns
            for i, label in enumerate(labels)
        ]
    )


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Medians per group, columns ``{column}_median``."""
    return wide_quantiles(df, keys, columns, [0.5], ["median"])
