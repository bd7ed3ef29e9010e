"""Predictor importance of grouped linear models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe import constants as K
from sensorframe.operators.clean import complete_cases
from sensorframe.operators.mixed import _vectors, summed
from sensorframe.operators.ols import INTERCEPT, _schema, _square
from sensorframe.operators.reshape import compact_join, parts_of, spread, stack_rows
from sensorframe.session import stored, temporary


def t_importance(coefs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute t value and sign of each slope."""
    return coefs.filter((F.col("term") != INTERCEPT) & F.col("statistic").isNotNull()).select(
        F.col("term").alias("Variable"),
        F.abs("statistic").alias("Importance"),
        F.when(F.col("statistic") > 0, "POS").otherwise("NEG").alias("Sign"),
        F.lit(None).cast("double").alias("StDev"),
        F.lit("tstat").alias("method"),
        *keys,
    )


# Constants of the mixing function: a prime below 2^31, and a multiplier and increments below it.
PRIME, FACTOR, STEP, LEAP = 2_147_483_647, 48_271, 1_000_003, 7_919
ROUNDS = 4
# Steps of a walk back inside. A step stays outside with a chance below 2 / sqrt(n), and small cells have fewer places.
WALKS = 64


def with_partner(df: DataFrame, i: str, n: str, sim: str, out: str, seed: int = 1) -> DataFrame:
    """Add a seeded bijection of 0 .. ``n`` - 1 for each ``sim``, as a function of three whole numbers.

    A Feistel network on pairs below the root of ``n``, rounded up; numbers that land beyond ``n`` walk on until
    they are inside, which ends as the network is a bijection itself. Each round is columns of their own, so that the
    expressions stay small and are compiled; the few that walk on do so in an ``aggregate``, which is not.
    """
    df = df.withColumn("_a", F.ceil(F.sqrt(F.col(n).cast("double"))).cast("long"))
    a, left, right = F.col("_a"), F.col("_l"), F.col("_r")
    turns = [(F.lit(t + 1).cast("long"), F.lit(t * LEAP + seed).cast("long")) for t in range(ROUNDS)]
    df = df.withColumns({"_l": F.expr(f"{i} div _a"), "_r": F.col(i) % a})
    for times, plus in turns:
        df = df.withColumn("_y", (right * FACTOR + F.col(sim) * STEP + plus) % PRIME)
        df = df.withColumns({"_l": right, "_r": (left + (F.col("_y") * (F.col("_y") + times)) % PRIME) % a})

    def mixed(pair: Column, turn: Column) -> Column:
        y = (pair["right"] * FACTOR + F.col(sim) * STEP + turn["plus"]) % PRIME
        return F.struct(pair["right"].alias("left"), ((pair["left"] + (y * (y + turn["times"])) % PRIME) % a).alias("right"))

    def moved(x: Column) -> Column:
        start = F.struct(F.floor(x / a).cast("long").alias("left"), (x % a).alias("right"))
        every = F.array(*[F.struct(times.alias("times"), plus.alias("plus")) for times, plus in turns])
        return F.aggregate(every, start, mixed, lambda pair: pair["left"] * a + pair["right"])

    df = df.withColumn(out, left * a + right)
    steps = F.sequence(F.lit(1), F.lit(WALKS))
    walked = F.aggregate(steps, F.col(out), lambda at, _: F.when(at < F.col(n), at).otherwise(moved(at)))
    return df.withColumn(out, F.when(F.col(out) < F.col(n), F.col(out)).otherwise(walked)).drop("_a", "_l", "_r", "_y")


def sources(place: np.ndarray, n: np.ndarray, sim: int, seed: int = 1) -> np.ndarray:
    """The numbers whose partner ``with_partner`` puts at ``place``: its network run backward, by the same walks."""
    a = np.ceil(np.sqrt(n.astype(float))).astype(np.int64)

    def back(x: np.ndarray, a: np.ndarray) -> np.ndarray:
        left, right = x // a, x % a
        for t in reversed(range(ROUNDS)):
            y = (left * FACTOR + (sim * STEP + t * LEAP + seed)) % PRIME
            left, right = (right - (y * (y + (t + 1))) % PRIME) % a, left
        return left * a + right

    out = back(place, a)
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = back(out[outside], a[outside])
    return out


# Places of a cell whose rows meet in one task, and rows that a task deals out at a time.
PLACES = DEALT = 1 << 16
# Rows that are sorted together when the rows of all cells are numbered.
SORTED = 1 << 20
# Bytes that rows send to blocks at a time. If there is more, cells are worked on in portions, and the blocks of a portion
# in turns, and disk holds only the files of one turn. The numbers of both have a bound, and so have the passes over a row.
SENT = 4 << 30
PORTIONS, TURNS = 4, 16


def _matrix(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy() for c in names])


def _parcels(cell: np.ndarray, place: np.ndarray, at: np.ndarray, of: np.ndarray, values: np.ndarray, moved: bool):
    """Rows (cell, block of places, moved, places, values): what goes to one block together. Entry e carries ``values[of[e]]``."""
    if not len(of):
        return
    order = np.lexsort((place // PLACES, cell[of]))
    cells, blocks = cell[of][order], (place // PLACES)[order]
    starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1])])
    for start, end in zip(starts, [*starts[1:], len(order)]):
        take = order[start:end]
        yield cells[start], blocks[start], moved, at[take].astype("<i4").tobytes(), values[of[take]].tobytes()


def _turn(cell: np.ndarray, place: np.ndarray, turns: int) -> np.ndarray:
    """Which turn a block belongs to. The bits of a cell's number are its partition and its place there."""
    return ((cell >> 33) + (cell & 0xFFFFFFFF) + place // PLACES) % turns


def _dealt(predictors: list[str], names: list[str], nsim: int, seed: int, turn: int, turns: int):
    """Sends every row to the block of its place, and its predictors to the blocks of the rows that get them, by simulation.

    Only to blocks of this turn.
    """

    def deal(table: pa.Table) -> pa.RecordBatch:
        cell, i, n = (table.column(c).to_numpy() for c in ("_cell", "_i", "_n"))
        values, given, rows = _matrix(table, names), _matrix(table, predictors), np.arange(len(cell))
        to = np.concatenate([sources(i, n, sim, seed) for sim in range(1, nsim + 1)])
        at, of = np.repeat(np.arange(nsim, dtype=np.int64) * PLACES, len(cell)) + to % PLACES, np.tile(rows, nsim)
        if turns > 1:
            rows = rows[_turn(cell, i, turns) == turn]
            mine = _turn(cell[of], to, turns) == turn
            to, at, of = to[mine], at[mine], of[mine]
        out = [*_parcels(cell, i[rows], i[rows] % PLACES, rows, values, False), *_parcels(cell, to, at, of, given, True)]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        columns = zip(*out) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_cell", "_block", "_moved", "_at", "_values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= DEALT:
                yield deal(pa.Table.from_batches(held))
                held = []
        if held:
            yield deal(pa.Table.from_batches(held))

    return run


def _met(width: int, given: int, nsim: int):
    """Products of the rows of a block with the predictors that they got, added up per simulation."""

    def unpacked(table: pa.Table, moved: bool, columns: int) -> tuple[np.ndarray, np.ndarray]:
        mine = table.filter(pc.equal(table.column("_moved"), moved))
        at = np.concatenate([np.frombuffer(b.as_buffer(), "<i4") for b in mine.column("_at")])
        return at.astype(np.int64), np.concatenate([np.frombuffer(b.as_buffer()) for b in mine.column("_values")]).reshape(-1, columns)

    def meet(table: pa.Table) -> pa.Table:
        at, values = unpacked(table, False, width)
        rows = np.empty((len(at), width))
        rows[at] = values
        at, values = unpacked(table, True, given)
        got = np.empty((nsim * len(rows), given))
        got[at // PLACES * len(rows) + at % PLACES] = values
        cross = np.matmul(rows.T, got.reshape(nsim, len(rows), given)).reshape(nsim, -1)
        cell = pa.array([table.column("_cell")[0].as_py()] * nsim, pa.int64())
        return pa.table({"_cell": cell, "sim": pa.array(range(1, nsim + 1), pa.int32()), "cross": pa.array(list(cross), pa.list_(pa.float64()))})

    return meet


def _numbered(rows: DataFrame, cells: DataFrame, names: list[str], count: int) -> DataFrame:
    """The rows of these cells, ``count`` in all, sorted within their cell and numbered over all of them (``_cell``, ``_at``, names)."""
    ranged = compact_join(rows, cells.select("_k", "_cell"), ["_k"]).drop("_k").withColumn("_t", F.monotonically_increasing_id())
    order = ["_cell", *names, "_t"]  # equal rows are interchangeable, and may lie in several ranges
    ranged = ranged.repartitionByRange(parts_of(rows.sparkSession, count, SORTED), *order).sortWithinPartitions(*order).drop("_t")
    # The upper bits of this number are the range, the lower ones count its rows.
    return ranged.withColumn("_at", F.monotonically_increasing_id())


def _placed(numbered: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """Numbered rows with their place in the cell (``_i``) and the cell's size (``_n``), and values around the cell's means."""
    ranged = numbered.withColumn("_p", F.shiftright("_at", 33))
    pieces = ranged.groupBy("_cell", "_p").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    earlier = W.partitionBy("_cell").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("_cell", "_p", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_off"))
    # Stored, these few rows have a known size, and the rows need not be dealt out to meet them.
    pieces = stored(compact_join(pieces, cells.drop("_k"), ["_cell"]), lean=True)
    placed = compact_join(ranged, pieces, ["_cell", "_p"])
    return placed.select("_cell", "_n", (F.col("_at") + F.col("_off")).alias("_i"), *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in names])


def _permuted(
    rows: DataFrame, predictors: list[str], responses: list[str], nsim: int, seed: int, spans: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """(``_k``, ``sim``, ``cross``) of complete rows (``_k``, predictors, responses); see ``permuted_moments``.

    With ``spans`` also ``predictor_ranges`` by ``_k``. The rows are read several times, and all that is made of them is stored.
    """
    names, spark = [*predictors, *responses], rows.sparkSession
    if nsim * PLACES > 1 << 31:
        raise ValueError("too many simulations")
    # Around the cell means a covariance is a plain mean of products, which is cheap to add up.
    cells = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in names])
    cells = stored(cells.withColumn("_cell", F.monotonically_increasing_id()), lean=True)
    weight = 8 * len(names) + 4 + nsim * (8 * len(predictors) + 4)  # bytes that a row sends
    parts = lambda count, most: max(1, min(most, -(-count * weight // SENT)))
    portions = parts(cells.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], PORTIONS)
    portion = F.pmod(F.xxhash64("_k"), F.lit(portions))
    sizes = cells.groupBy(portion.alias("_portion")).agg(F.sum("_n").alias("_rows")).collect()
    sums, found = [], []
    for number, count in sorted(map(tuple, sizes)) or [(0, 0)]:
        mine, turns = cells.filter(portion == number), parts(count, TURNS)
        with temporary(_numbered(rows.filter(portion == number), mine, names, count)) as numbered:
            placed = _placed(numbered, mine, names)
            for turn in range(turns):
                sent = placed.mapInArrow(_dealt(predictors, names, nsim, seed, turn, turns), "_cell long, _block long, _moved boolean, _at binary, _values binary")
                sent = sent.repartition(parts_of(spark, -(-count // turns), 4 * PLACES), "_cell", "_block")
                met = sent.groupBy("_cell", "_block").applyInArrow(_met(len(names), len(predictors), nsim), "_cell long, sim int, cross array<double>")
                sums.append(stored(summed(met, ["_cell", "sim"], lambda batch: _vectors(batch.column("cross")).sum(0)), lean=True))
            if spans:
                found.append(stored(predictor_ranges(numbered.withColumn("_y", F.lit(0.0)), ["_cell"], "_y", predictors), lean=True))
    total = stack_rows(*sums)
    if len(sums) > 1:
        total = summed(total, ["_cell", "sim"], lambda batch: _vectors(batch.column("vector")).sum(0))
    mean = F.transform("vector", lambda x: x / F.col("_n"))
    crossed = compact_join(total, cells.select("_k", "_cell", "_n"), ["_cell"]).select("_k", "sim", mean.alias("cross"))
    ranges = compact_join(stack_rows(*found), cells.select("_k", "_cell"), ["_cell"]).drop("_cell") if spans else None
    return crossed, ranges


def permuted_moments(
    df: DataFrame,
    keys: Sequence[str],
    response: str,
    predictors: Sequence[str],
    nsim: int = K.PERMUTATIONS,
    seed: int = 1,
) -> DataFrame:
    """Covariances of each row's values with the predictors of a randomly assigned row of its cell.

    One row per cell and simulation. ``cross`` holds, row by row, the population covariance of the
    actual (predictors, then response) with the permuted predictors. A permutation is drawn per
    simulation and shared by the predictors; each predictor on its own is shuffled uniformly. Rows of a cell
    are numbered once, range by range; the partner of a row in a simulation comes from its number by a seeded
    bijection, so nothing is sorted per simulation. The predictors travel, in packed arrays, to the block of numbers
    they are wanted in; blocks have a fixed number of rows, so no key is hot, and hand on sums of products.
    The permutations depend on the data and the seed only.
    """
    keys, predictors = list(keys), list(predictors)
    names = [*predictors, response]
    rows = complete_cases(df, [*keys, *names]).select(F.struct(*keys).alias("_k"), *[F.col(c).cast("double").alias(c) for c in names])
    with temporary(rows) as rows:
        crossed, _ = _permuted(rows, predictors, [response], nsim, seed)
    return crossed.select("_k.*", "sim", "cross")


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def _mask(responses: Sequence[str]) -> Column:
    """Bit r is set where response r is known."""
    return sum((F.when(_known(c), F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r, c in enumerate(responses)), F.lit(0).cast("long"))


def same_rows(df: DataFrame, keys: Sequence[str], responses: Sequence[str]) -> DataFrame:
    """(``keys``, ``resp``, ``_r``, ``_lead``): responses of a cell known in the same rows share the first of them as lead.

    ``_r`` and ``_lead`` are places in ``responses``, at most 62; responses without any value in a cell have no row.
    """
    if len(responses) > 62:
        raise ValueError("more than 62 responses at a time")
    bit = lambda x, r: x.bitwiseAND(F.lit(1 << r).cast("long")) != 0
    differ = [F.bit_or(F.when(bit(F.col("_mask"), r), F.bitwise_not("_mask")).otherwise(F.col("_mask"))) for r in range(len(responses))]
    masked = df if "_mask" in df.columns else df.withColumn("_mask", _mask(responses))
    found = masked.groupBy(*keys).agg(F.bit_or("_mask").alias("_any"), *[d.alias(f"_d{r}") for r, d in enumerate(differ)])
    entries = []
    for r, c in enumerate(responses):
        lead = F.coalesce(*[F.when(~bit(F.col(f"_d{r}"), q), F.lit(q)) for q in range(r + 1)])
        entries.append(F.struct(F.lit(c).alias("resp"), F.lit(r).alias("_r"), lead.alias("_lead"), bit(F.col("_any"), r).alias("_some")))
    return found.select(*keys, F.inline(F.array(*entries))).filter("_some").drop("_some")


def response_rows(df: DataFrame, keys: Sequence[str], responses: Sequence[str], predictors: Sequence[str]) -> DataFrame:
    """Rows complete in keys and predictors, with ``_mask``, in which bit r is set where response r is known."""
    rows = complete_cases(df, [*keys, *predictors]).select(*keys, *predictors, *[F.col(c).cast("double").alias(c) for c in responses])
    return rows.withColumn("_mask", _mask(responses))


def permuted_rows(
    rows: DataFrame,
    keys: Sequence[str],
    responses: Sequence[str],
    predictors: Sequence[str],
    nsim: int = K.PERMUTATIONS,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """``permuted_responses`` of a stored table of ``response_rows``, which is read several times and may go afterwards.

    To store it first also keeps the code that Spark makes for a row so small that the JVM compiles it.
    """
    keys, responses, predictors = list(keys), list(responses), list(predictors)
    shared = stored(same_rows(rows, keys, responses), lean=True)
    # Responses of a lead are known where the lead is, so one bit of a row's mask tells whether it is one of theirs.
    leads = stored(shared.groupBy(*keys, "_lead").agg(F.bit_or(F.expr("shiftleft(1L, _r)")).alias("_members")), lean=True)
    rows = compact_join(rows, leads, keys).filter(F.getbit("_mask", F.col("_lead")) == 1)
    values = [F.when(F.getbit("_members", F.lit(r)) == 1, F.col(c)).otherwise(0.0).alias(f"_y{r}") for r, c in enumerate(responses)]
    rows = rows.select(F.struct(*keys, "_lead").alias("_k"), *[F.col(c).cast("double").alias(c) for c in predictors], *values)
    crossed, ranges = _permuted(rows, predictors, [f"_y{r}" for r in range(len(responses))], nsim, seed, spans=True)
    p = len(predictors)
    own = F.concat(F.slice("cross", 1, p * p), F.slice("cross", F.col("_r") * p + p * p + 1, F.lit(p)))
    crossed = crossed.select("_k.*", "sim", "cross").join(shared, [*keys, "_lead"]).select(*keys, "resp", "sim", own.alias("cross"))
    ranges = ranges.select("_k.*", "Variable", "low", "high", "distinct").join(shared, [*keys, "_lead"])
    return crossed, ranges.select(*keys, "resp", "Variable", "low", "high", "distinct")


def permuted_responses(
    df: DataFrame,
    keys: Sequence[str],
    responses: Sequence[str],
    predictors: Sequence[str],
    nsim: int = K.PERMUTATIONS,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """``permuted_moments`` and ``predictor_ranges`` of many responses of the same rows, with ``resp`` as one more key.

    Responses known in the same rows of a cell are worked on together: their rows are numbered in the order of the
    predictors, then of these responses, and share the permutations, so the predictors travel once for all of them.
    """
    with temporary(response_rows(df, keys, responses, predictors)) as rows:
        return permuted_rows(rows, keys, responses, predictors, nsim, seed)


def _drops(row, names: list[str], how: str) -> list[tuple]:
    """Loss of fit per predictor of one model when that predictor is permuted, from moments alone."""
    p = len(names)
    s = _square(row.cov, p + 1)
    beta = np.asarray(row.beta, dtype=float)
    cross = np.asarray(row.cross, dtype=float).reshape(p + 1, p)
    sxx, sxy, syy = s[:p, :p], s[:p, p], s[p, p]
    fitted_y, fitted = beta @ sxy, beta @ sxx @ beta
    out = []
    for j in range(p):
        if not row.in_model[j]:
            continue
        rest = beta.copy()
        rest[j] = 0.0
        var = rest @ sxx @ rest + 2 * beta[j] * (rest @ cross[:p, j]) + beta[j] ** 2 * sxx[j, j]
        cov = rest @ sxy + beta[j] * cross[p, j]
        if how == "perm_rmse":
            full = math.sqrt(max(syy - 2 * fitted_y + fitted, 0.0))
            value = math.sqrt(max(syy - 2 * cov + var, 0.0)) - full
        elif how == "perm_r2":
            full = fitted_y**2 / (fitted * syy) if fitted > 0 and syy > 0 else math.nan
            value = full - (cov**2 / (var * syy) if var > 0 and syy > 0 else math.nan)
        else:  # perm_r2_residual: one minus residual over total variance
            value = (syy - 2 * cov + var - (syy - 2 * fitted_y + fitted)) / syy if syy > 0 else math.nan
        out.append((names[j], value))
    return out


def permutation_importance(
    fitted: DataFrame, permuted: DataFrame, keys: Sequence[str], predictors: Sequence[str], metric: str = "perm_r2"
) -> DataFrame:
    """Mean and spread over simulations of the loss of fit, per model and predictor.

    ``fitted`` comes from ``ols.models``. For a linear model the permuted predictions enter both metrics
    through covariances only, so no row is scored again. ``perm_r2`` uses the squared correlation.
    """
    keys, names = list(keys), list(predictors)
    joined = spread(fitted.join(permuted, keys), keys)
    schema = _schema(joined, keys, "Variable string, value double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            places = [batch.columns.get_loc(k) for k in keys]
            for row in batch.itertuples(index=False):
                key = tuple(row[i] for i in places)
                out += [key + r for r in _drops(row, names, metric)]
            yield pd.DataFrame(out, columns=[*keys, "Variable", "value"])

    values = joined.mapInPandas(run, schema)
    return values.groupBy("Variable", *keys).agg(
        F.avg("value").alias("Importance"), F.stddev_samp("value").alias("StDev")
    ).select(
        "Variable",
        "Importance",
        F.lit(None).cast("string").alias("Sign"),
        "StDev",
        F.lit(metric).alias("method"),
        *keys,
    )


def predictor_ranges(df: DataFrame, keys: Sequence[str], response: str, predictors: Sequence[str]) -> DataFrame:
    """Smallest, largest and number of distinct values of each predictor over the complete rows."""
    rows = complete_cases(df, [*keys, response, *predictors])
    long = rows.select(*keys, *predictors).unpivot(list(keys), list(predictors), "Variable", "x")
    return (
        long.groupBy(*keys, "Variable", "x").agg(F.lit(1).alias("_one"))
        .groupBy(*keys, "Variable")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("distinct"))
    )


def pdp_importance(coefs: DataFrame, ranges: DataFrame, keys: Sequence[str], points: int = K.PDP_POINTS) -> DataFrame:
    """Spread of the partial-dependence line over an even grid between the predictor's extremes."""
    m = F.least(F.col("distinct"), F.lit(points)).cast("double")
    step = F.try_divide(F.col("high") - F.col("low"), m - 1)
    spread = step * F.sqrt(m * (m + 1) / 12)
    slopes = coefs.filter((F.col("term") != INTERCEPT) & F.col("estimate").isNotNull())
    slopes = slopes.withColumnRenamed("term", "Variable")
    return slopes.join(ranges, [*keys, "Variable"]).select(
        "Variable",
        (F.abs("estimate") * spread).alias("Importance"),
        F.lit(None).cast("string").alias("Sign"),
        F.lit(None).cast("double").alias("StDev"),
        F.lit("pdp").alias("method"),
        *keys,
    )
