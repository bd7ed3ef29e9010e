"""Gap filling along time.

Interpolation deals the readings into ranges of equal size along series and time, so a single very long or dense series
is spread over many tasks. Each range is filled by itself; only its first and its last series can go on in other ranges, and a
table of at most two rows per range carries the known points over the cuts. Carrying forward works on chunks that the caller names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.operators.reshape import compact_join, even_parts
from sensorframe.session import stored

# Readings of a range, which one task holds at a time, and rows of a batch that it hands on.
READINGS, BATCH = 1 << 18, 10_000


def _time_number(df: DataFrame, time: str) -> Column:
    """Time as a number: microseconds for timestamps, days for dates, the value itself otherwise."""
    kind = dict(df.dtypes)[time]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(time).cast("timestamp"))
    if kind == "date":
        return F.unix_date(time)
    return F.col(time)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; the first one does, and missing values are equal."""
    after, before = column[1:], column[:-1]
    differ = pc.or_(pc.fill_null(pc.not_equal(after, before), False), pc.xor(pc.is_null(after), pc.is_null(before)))
    return np.concatenate([[True], differ.to_numpy(zero_copy_only=False)])


def _elapsed(time: pa.Array, at: np.ndarray, since: np.ndarray) -> pa.Array:
    """Time from one row to another as a double; missing where one of the times is."""
    if pa.types.is_decimal(time.type):
        time = time.cast(pa.decimal256(75, time.type.scale))
    return pc.subtract_checked(time.take(pa.array(at)), time.take(pa.array(since))).cast(pa.float64())


def _line_share(time: pa.Array, low: np.ndarray, at: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far a row lies on the way between two others; 0 if that cannot be told."""
    part, whole = _elapsed(time, at, low), _elapsed(time, high, low)
    known = pc.and_(part.is_valid(), whole.is_valid()).to_numpy(zero_copy_only=False)
    part, whole = (x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in (part, whole))
    known &= whole != 0
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(known, part / np.where(known, whole, 1.0), 0.0)


def _filled_within(keys: Sequence[str], columns: Sequence[str], max_gap: int):
    """Fills, in the rows of one sorted range, the runs whose known points on both sides are in the range.

    A series can go on in other ranges only if it is the first (``_side`` 1) or the last (2) of its range; rows of all others
    (0) are done. Rows of the two keep their time and come with their place in it (``_r``), the last place of the series (``_last``)
    and, per column, the known points before and after a row, itself included, where they are wanted: at missing values, and at
    both ends of the series in the range, for the ranges next to it.

    A point is a distinct time; rows that share one count once and their values are averaged.
    """

    def look(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        time = table.column("_t").combine_chunks()
        begins = np.logical_or.reduce([_changes(table.column(k).combine_chunks()) for k in keys])
        fresh = begins | _changes(time)
        starts = np.flatnonzero(fresh)  # the first row of each point
        point = np.cumsum(fresh) - 1
        firsts = np.flatnonzero(begins[starts])  # the first point of each series
        points, of = len(starts), np.cumsum(begins[starts]) - 1
        counts = np.diff(np.append(firsts, points))
        low, high = firsts[of], (firsts + counts)[of]
        here = np.arange(points)
        place, last = (here - low + 1).astype(np.int32), counts[of].astype(np.int32)
        kind = np.where(of == 0, 1, np.where(of == of[-1], 2, 0))[point]
        inner, end = kind == 0, ((place == 1) | (place == last))[point]
        size = np.diff(np.append(starts, len(point)))
        sides = {}
        for c in columns:
            column = table.column(c).combine_chunks()
            known = column.is_valid().to_numpy(zero_copy_only=False)
            value = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            n = np.add.reduceat(known.astype(np.int64), starts)
            mean = np.add.reduceat(value, starts) / np.maximum(n, 1)
            before = np.maximum.accumulate(np.where(n > 0, here, -1))
            after = np.minimum.accumulate(np.where(n > 0, here, points)[::-1])[::-1]
            earlier, later = before >= low, after < high
            before, after = np.clip(before, 0, points - 1), np.clip(after, 0, points - 1)
            run = (n < size) & earlier & later & (place[after] - place[before] - 1 <= max_gap)
            at = np.flatnonzero(run)
            a, b = before[at], after[at]
            line = np.zeros(points)
            with np.errstate(invalid="ignore", over="ignore"):
                line[at] = mean[a] + (mean[b] - mean[a]) * _line_share(time, starts[a], starts[at], starts[b])
            done = known | run[point]
            filled = pa.array(np.where(known, value, line[point]), mask=~done)
            table = table.set_column(table.column_names.index(c), c, filled)
            wanted = ~inner & (~done | end)
            for side, to, there in (("_p_", before, earlier), ("_n_", after, later)):
                rows = np.flatnonzero(wanted & there[point])
                to = to[point[rows]]
                fields = [time.take(pa.array(starts[to])), pa.array(place[to]), pa.array(mean[to])]
                spots = np.full(len(point), -1)
                spots[rows] = np.arange(len(rows))
                sides[f"{side}{c}"] = pa.StructArray.from_arrays(fields, ["_t", "_r", "v"]).take(pa.array(spots, mask=spots < 0))
        nothing = pa.scalar(None, time.type)
        table = table.set_column(table.column_names.index("_t"), "_t", pc.if_else(pa.array(inner), nothing, time))
        places = {"_r": pa.array(place[point], mask=inner), "_last": pa.array(last[point], mask=inner)}
        for c, x in ({"_side": pa.array(kind.astype(np.int32))} | places | sides).items():
            table = table.append_column(c, x)
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from look(pa.Table.from_batches(held)).to_batches(max_chunksize=BATCH)

    return run


def _filled(c: str, max_gap: int) -> str:
    before, after = f"`_p_{c}`", f"`_n_{c}`"
    share = f"coalesce((_t - {before}._t) / nullif(CAST({after}._t - {before}._t AS DOUBLE), 0), 0)"
    return (
        f"CASE WHEN `{c}` IS NOT NULL THEN `{c}` WHEN {after}._r - {before}._r - 1 <= {int(max_gap)} "
        f"THEN {before}.v + ({after}.v - {before}.v) * {share} END"
    )


def ranges(df: DataFrame, keys: Sequence[str], time: str, parts: int | None = None) -> DataFrame:
    """The rows in ranges of about equal size along the series and time (as a number, ``_t``), with the number of the range, ``_p``.

    Rows of a series at the same time are in the same range.
    """
    n = parts or even_parts(df, READINGS)
    rows = df.withColumn("_t", _time_number(df, time))
    return rows.repartitionByRange(n, *keys, "_t").withColumn("_p", F.spark_partition_id())


def interpolate_gaps(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    max_gap: int = 3,
    parts: int | None = None,
) -> DataFrame:
    """Fill runs of at most ``max_gap`` missing points on the straight line over elapsed time.

    Longer runs and the ends of a series stay missing; known values never change. ``parts`` is the number of ranges the
    rows are dealt into (default: the shuffle partitions, more if a range had over ``READINGS`` rows); the result does not
    depend on it. The rows are stored range by range, with all runs filled that have both known points in their range.
    What is left are runs of the at most two series of a range that go on in other ranges. Their known points come from the
    nearest range of the series that has one, by a table of at most two rows per range.
    """
    keys, columns = list(keys), list(columns)
    part = ["_p", "_side"]
    rows = df.withColumns({c: F.col(c).cast("double") for c in columns})
    ranged = ranges(rows, keys, time, parts).sortWithinPartitions(*keys, "_t")
    kind = dict(ranged.dtypes)["_t"]
    extra = [f"`{side}{c}` struct<_t: {kind}, _r: int, v: double>" for c in columns for side in ("_p_", "_n_")]
    fields = [f if f.name != "_t" else T.StructField("_t", f.dataType) for f in ranged.schema]
    schema = T.StructType([*fields, *T.StructType.fromDDL(", ".join(["_side int", "_r int", "_last int", *extra]))])
    near = stored(ranged.mapInArrow(_filled_within(keys, columns, max_gap), schema))

    done, cut = near.filter("_side = 0"), near.filter("_side > 0")
    ends = cut.filter((F.col("_r") == 1) | (F.col("_r") == F.col("_last"))).groupBy(*keys, *part).agg(
        F.max("_last").alias("_points"),
        *[F.max(F.when(F.col("_r") == F.col("_last"), F.col(f"_p_{c}"))).alias(f"_last_{c}") for c in columns],
        *[F.max(F.when(F.col("_r") == 1, F.col(f"_n_{c}"))).alias(f"_first_{c}") for c in columns],
    )
    # A series in one range gets nothing from others.
    ends = ends.withColumn("_ranges", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter("_ranges > 1")
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_off", F.coalesce(F.sum("_points").over(before), F.lit(0)))

    def placed(point: str) -> Column:
        """A known point with its place in the whole series."""
        shifted = F.struct(F.col(f"{point}._t").alias("_t"), (F.col(f"{point}._r") + F.coalesce("_off", F.lit(0))).alias("_r"), F.col(f"{point}.v").alias("v"))
        return F.when(F.col(point).isNotNull(), shifted)

    carried = ends.select(
        *part, "_off",
        *[F.last(placed(f"_last_{c}"), True).over(before).alias(f"_before_{c}") for c in columns],
        *[F.last(placed(f"_first_{c}"), True).over(after).alias(f"_after_{c}") for c in columns],
    )
    rows = compact_join(cut, stored(carried), part, "left")
    rows = rows.withColumns(
        {f"_p_{c}": F.coalesce(placed(f"_p_{c}"), F.col(f"_before_{c}")) for c in columns}
        | {f"_n_{c}": F.coalesce(placed(f"_n_{c}"), F.col(f"_after_{c}")) for c in columns}
    )
    rows = rows.selectExpr(*[f"{_filled(c, max_gap)} AS `{c}`" if c in columns else f"`{c}`" for c in df.columns])
    return done.select(*df.columns).union(rows)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    chunk: Column | str,
) -> DataFrame:
    """Replace missing values by the last known one before them in the series.

    ``chunk`` cuts a series into pieces and must not decrease along ``order`` (such as the year). Each
    piece is carried on its own; the last known value of earlier pieces comes from a table with one
    row per piece. ``order`` identifies a row within a series, and ``keys`` are not null.
    """
    keys, order, columns = list(keys), list(order), list(columns)
    base = df.withColumn("_chunk", F.col(chunk) if isinstance(chunk, str) else chunk)
    part = [*keys, "_chunk"]
    here = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    tails = base.groupBy(*part).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in columns])
    tails = tails.select(*part, *[F.last(c, True).over(earlier).alias(f"_c_{c}") for c in columns])
    local = base.withColumns({c: F.last(c, True).over(here) for c in columns})
    return local.join(tails, part, "left").select(
        *[F.coalesce(F.col(c), F.col(f"_c_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )
