"""Random-intercept models per group, used to impute site values, and their predictions.

Per unit (site) Spark aggregates counts and sums, and units that the likelihood cannot tell apart are added up:
units of equal size in the Gaussian model, units of equal counts and total in the Poisson one. The fits then work on
sums over these rows, round by round: the REML criterion at a whole grid of variance ratios, or value, gradient and
Hessian of the Laplace likelihood. Every task adds up its rows of a group to one vector, the vectors of a group are added
up, and only their sum reaches a small solver; so a group may have any number of units. The state of a round is one
stored row per group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sensorframe.functions.nulls import round_to
from sensorframe.operators.reshape import compact_join, spread
from sensorframe.session import stored

Factors = Mapping[str, Sequence]

# Levels of one factor; each is a coefficient, so more are not a factor but a mistake.
MOST_LEVELS = 200


def _levels(df: DataFrame, group: str, unit: str, y: str, names: Sequence[str]) -> Factors:
    """The levels of each factor in the complete rows, sorted; one small aggregate."""
    rows = _complete(df, group, unit, y, names)
    found = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("level")) for n in names])).alias("f"))
    found = found.select("f.name", "f.level").distinct().limit(len(names) * MOST_LEVELS + 1).collect()
    out = {n: sorted(r["level"] for r in found if r["name"] == n) for n in names}
    if any(len(levels) > MOST_LEVELS for levels in out.values()):
        raise ValueError(f"a factor has more than {MOST_LEVELS} levels")
    return out


def _dummies(factors: Factors) -> list[Column]:
    """Intercept, then one indicator per level of each factor but its first."""
    out = [F.lit(1.0)]
    for name, levels in factors.items():
        out += [(F.col(name) == F.lit(level)).cast("double") for level in levels[1:]]
    return out


def _linear(beta: Column, seen: Column, factors: Factors) -> Column:
    """Fixed part of the prediction from the coefficients; null at a level that no row of the group has."""
    total = beta[0]
    i = place = 0
    for name, levels in factors.items():
        part = F.lit(None).cast("double")
        for k, level in enumerate(levels):
            slope = beta[i + k] if k else F.lit(0.0)
            part = F.when(F.col(name) == F.lit(level), F.when(seen[place + k], slope)).otherwise(part)
        total = total + part
        i, place = i + len(levels) - 1, place + len(levels)
    return total


def _complete(df: DataFrame, group: str, unit: str, y: str, factors) -> DataFrame:
    rows = df.select(group, unit, F.col(y).cast("double").alias("_y"), *factors).dropna()
    return rows.filter(~F.isnan("_y"))


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length as the rows of a table."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _keyed(names: list[str], keys: list[tuple], kinds: list[pa.DataType], vectors: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float64()))], [*names, "vector"])


def summed(df: DataFrame, keys: Sequence[str], add_up: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """One row per key: ``keys`` and ``vector``, the sum of what ``add_up`` makes of the rows of each key.

    ``add_up`` takes rows of one key and gives their vector. A task hands on one vector per key and batch, and these
    are added up one by one, so no key's rows ever come together.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", vector array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
                places.setdefault(key, []).append(i)
            vectors = [add_up(batch.take(pa.array(at))) for at in places.values()]
            yield _keyed(keys, list(places), [batch.schema.field(k).type for k in keys], vectors)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sums = None
        for batch in batches:
            kinds, done = [batch.schema.field(k).type for k in keys], []
            for key, vector in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("vector"), strict=True):
                vector = vector.values.to_numpy(zero_copy_only=False)
                if key == held:
                    sums = sums + vector
                else:
                    done += [] if held is None else [(held, sums)]
                    held, sums = key, vector
            yield _keyed(keys, [k for k, _ in done], kinds, [v for _, v in done])
        if held is not None:
            yield _keyed(keys, [held], kinds, [sums])

    return spread(df.mapInArrow(partial, schema), keys).sortWithinPartitions(*keys).mapInArrow(total, schema)


# --- Gaussian ---------------------------------------------------------------------------------------

# Logarithms of the variance ratio that are searched, and intervals of a grid; three rounds narrow it to a thousandth.
LOWEST, HIGHEST = -18.0, 12.0
INTERVALS, ROUNDS = 64, 3


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def _independent(xx: np.ndarray) -> list[int]:
    """Columns that the ones before them do not determine."""
    kept: list[int] = []
    for j in range(len(xx)):
        left = xx[j, j]
        if kept and left > 0:
            left -= xx[j, kept] @ np.linalg.solve(xx[np.ix_(kept, kept)], xx[kept, j])
        if left > 1e-10 * max(xx[j, j], 1.0):
            kept.append(j)
    return kept


def _upper(square: np.ndarray) -> np.ndarray:
    return square[np.triu_indices(len(square))]


def reml(totals: np.ndarray, weighted: np.ndarray, log_det: float, size: int, kept: list[int]) -> tuple[float, np.ndarray, float]:
    """REML criterion at one variance ratio from summed products, with the coefficients and residual variance there.

    ``totals`` has the products over rows (XX by its upper triangle, XY, YY) and their number, ``weighted`` the same
    products over unit sums, weighted at the ratio. A column not in ``kept`` gets a coefficient of zero.
    """
    n = size * (size + 1) // 2
    a = (_square(totals[:n], size) - _square(weighted[:n], size))[np.ix_(kept, kept)]
    c = (totals[n : n + size] - weighted[n : n + size])[kept]
    beta = np.zeros(size)
    beta[kept] = np.linalg.solve(a, c)
    dof = totals[n + size + 1] - len(kept)
    if dof <= 0:
        return math.nan, beta, math.nan
    sigma2 = max((totals[n + size] - weighted[n + size] - beta[kept] @ c) / dof, 1e-300)
    return dof * math.log(sigma2) + log_det + np.linalg.slogdet(a)[1], beta, sigma2


def _weigher(batch: pa.RecordBatch) -> np.ndarray:
    """Weighted products and log determinant of sizes of units at all ratios of their group."""
    ratios = _vectors(batch.column("ratios"))[0][:, None]
    n, units = (batch.column(c).to_numpy().astype(float) for c in ("size", "units"))
    weighted = (ratios / (1 + n * ratios)) @ _vectors(batch.column("products"))
    return np.column_stack([weighted, np.log1p(n * ratios) @ units]).ravel()


def _narrowed(logs: np.ndarray, criteria: np.ndarray, last: bool) -> np.ndarray:
    """The next grid, between the neighbours of the best place; after the last one the vertex of a parabola, and zero."""
    best = min(max(int(np.argmin(criteria)), 1), len(logs) - 2)
    if not last:
        return np.linspace(logs[best - 1], logs[best + 1], INTERVALS + 1)
    before, at, after = criteria[best - 1 : best + 2]
    bend = before - 2 * at + after
    shift = (before - after) / (2 * bend) if bend > 0 else float(np.argmin([before, at, after]) - 1)
    return np.array([logs[best] + np.clip(shift, -1, 1) * (logs[best + 1] - logs[best]), -math.inf])


def gaussian_fit(
    df: DataFrame, group: str, unit: str, y: str, factors: Factors | Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Fit per group and unit effects: (``group, beta, seen, ratio, sigma2, converged``) and (``group, unit, effect``).

    ``factors`` are whole-number columns; their levels come from the data unless given. ``seen`` tells for every level
    whether the group has rows of it. The REML criterion is summed up at a grid of variance ratios, which is narrowed
    around its best place round by round; a parabola through the last three places gives the ratio, unless zero is
    better. ``converged`` is false if the best ratio is at the upper end of the range.
    """
    if not isinstance(factors, Mapping):
        factors = _levels(df, group, unit, y, factors)
    rows = _complete(df, group, unit, y, factors)
    x = _dummies(factors)
    size, yv = len(x), F.col("_y")
    # Products over rows come from the counts and sums of each combination of levels.
    cells = rows.groupBy(group, *factors).agg(F.count(F.lit(1)).alias("n"), F.sum(yv).alias("y"), F.sum(yv * yv).alias("yy"))
    levels = [(name, level) for name, every in factors.items() for level in every]
    cells = cells.select(group, F.array(*x).alias("x"), F.array(*[(F.col(c) == F.lit(v)).cast("double") for c, v in levels]).alias("at"), "n", "y", "yy")

    def over_rows(batch: pa.RecordBatch) -> np.ndarray:
        at, n, sums = _vectors(batch.column("x")), batch.column("n").to_numpy(), batch.column("y").to_numpy()
        products = _upper(at.T @ (at * n[:, None])), at.T @ sums, [batch.column("yy").to_numpy().sum(), n.sum()]
        return np.concatenate([*products, n @ _vectors(batch.column("at"))])

    totals = stored(summed(cells, [group], over_rows).withColumnRenamed("vector", "totals"))
    units = rows.groupBy(group, unit).agg(
        F.count(F.lit(1)).alias("size"), F.array(*[F.sum(xi) for xi in x]).alias("s"), F.sum(yv).alias("v")
    )
    units = stored(units)
    s, v = F.col("s"), F.col("v")

    def over_units(batch: pa.RecordBatch) -> np.ndarray:
        sums, y = _vectors(batch.column("s")), batch.column("v").to_numpy()
        return np.concatenate([[len(y)], _upper(sums.T @ sums), sums.T @ y, [y @ y]])

    sizes = summed(units.select(group, "size", "s", "v"), [group, "size"], over_units)
    sizes = sizes.select(group, "size", F.col("vector")[0].alias("units"), F.slice("vector", 2, size * (size + 1) // 2 + size + 1).alias("products"))
    sizes = stored(sizes)
    kind, first = dict(df.dtypes)[group], np.linspace(LOWEST, HIGHEST, INTERVALS + 1)

    def look(turn: int):
        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    total, ratios = np.asarray(row["totals"]), np.asarray(row["ratios"])
                    sums = np.asarray(row["vector"]).reshape(len(ratios), -1)
                    kept = _independent(_square(total[: size * (size + 1) // 2], size))
                    found = [reml(total, w[:-1], w[-1], size, kept) for w in sums]
                    criteria = np.array([f[0] for f in found])
                    if turn <= ROUNDS:
                        logs = _narrowed(np.log(ratios), criteria, turn == ROUNDS)
                        out.append((row[group], np.exp(logs), None, None, None, None, None))
                        continue
                    # Of equal criteria, and where there are too few rows for one, a ratio of zero.
                    best = 0 if criteria[0] < criteria[1] else 1
                    seen = total[size * (size + 1) // 2 + size + 2 :] > 0
                    good = bool(ratios[best] < math.exp(HIGHEST - 1e-3))
                    out.append((row[group], None, found[best][1], seen, ratios[best], found[best][2], good))
                yield pd.DataFrame(out, columns=[group, "ratios", "beta", "seen", "ratio", "sigma2", "converged"])

        return solve

    schema = f"`{group}` {kind}, ratios array<double>, beta array<double>, seen array<boolean>, ratio double, sigma2 double, converged boolean"
    state = totals.select(group, F.array(*[F.lit(math.exp(v)) for v in first]).alias("ratios"))
    for turn in range(1, ROUNDS + 2):
        sums = summed(compact_join(sizes, state.select(group, "ratios"), [group]), [group], _weigher)
        at = compact_join(compact_join(sums, totals, [group]), state.select(group, "ratios"), [group])
        state = stored(at.mapInPandas(look(turn), schema))
    fit = state.drop("ratios")
    expected = sum((s[i] * F.col("beta")[i] for i in range(1, size)), s[0] * F.col("beta")[0])
    weight = F.col("ratio") / (1 + F.col("size") * F.col("ratio"))
    effects = units.join(fit, group).select(group, unit, (weight * (v - expected)).alias("effect"))
    return fit, effects


def impute_gaussian(
    df: DataFrame, targets: DataFrame, group: str, unit: str, y: str, factors: Sequence[str], digits: int = 2
) -> DataFrame:
    """Targets (``group, unit`` and the factors) with the rounded prediction as column ``y``, and ``converged``.

    Units without data get the group's fixed part alone; a target at a level that no row of its group has gets
    null. ``converged`` tells whether the group's fit did, and is null for a group without one.
    """
    # Levels, cells and units are each worked out from all rows, and what leads to these runs once.
    df = stored(df.select(group, unit, y, *factors))
    factors = _levels(df, group, unit, y, list(factors))
    fit, effects = gaussian_fit(df, group, unit, y, factors)
    joined = targets.join(effects, [group, unit], "left").join(fit.select(group, "beta", "seen", "converged"), group, "left")
    value = _linear(F.col("beta"), F.col("seen"), factors) + F.coalesce(F.col("effect"), F.lit(0.0))
    return joined.select(*targets.columns, round_to(value, digits).alias(y), "converged")


# --- Poisson ----------------------------------------------------------------------------------------

# Newton steps for the effect of a unit (from a close start), and for the parameters of a group.
INNER, OUTER = 100, 60
SMALLEST_LOG_SD = -12.0
# Coefficient of a level whose counts are all zero; its best value is minus infinity.
NOTHING = -30.0


def unit_modes(total: np.ndarray, rate: np.ndarray, variance: np.ndarray | float) -> np.ndarray:
    """Most likely effects of units: roots of ``total - rate * exp(u) - u / variance``, by Newton steps."""
    u = np.where(total > 0, np.log((total + 0.5) / (rate + 1e-12)), 0.0) * (variance / (variance + 1.0))
    for _ in range(INNER):
        e = rate * np.exp(u)
        step = np.clip((total - e - u / variance) / (e + 1.0 / variance), -2.0, 2.0)
        u = u + step
        if np.max(np.abs(step), initial=0.0) < 1e-13:
            break
    return u


def laplace_sums(batch: pa.RecordBatch) -> np.ndarray:
    """Value, gradient and Hessian of the Laplace likelihood, as sums over patterns of units of one group.

    The batch has ``n`` (rows per level), ``total``, ``units`` and the group's parameters ``beta`` and ``log_sd``. The
    derivatives are total ones: the mode of a unit moves with the parameters. Per level l, with the variance t,
    the expected count e of a unit and w = 1 / (1 + t e), the mode moves by -t e_l w and the count by e_l w.
    The part that is linear in ``beta`` is left to the caller. Sums for the variance are for its log standard deviation.
    The vector is: value, slope by level, Hessian by pair of levels (upper triangle, without the slope on its diagonal), by
    level and variance, slope and Hessian by variance.
    """
    total, m = (batch.column(c).to_numpy().astype(float) for c in ("total", "units"))
    t = math.exp(2 * batch.column("log_sd")[0].as_py())
    beta = _vectors(batch.column("beta"))[0]
    r = _vectors(batch.column("n")) * np.where(np.isnan(beta), 0.0, np.exp(beta))
    rate = r.sum(axis=1)
    u = unit_modes(total, rate, t)
    el = r * np.exp(u)[:, None]
    e = el.sum(axis=1)
    w = 1 / (1 + t * e)
    k = 1 + t * w * w / 2
    c = k * t * w + t * t * w**4
    # Derivatives by t: of the mode, the count, w, and the value.
    u_t, e_t, w_t = u * w / t, e * u * w / t, -w * w * e * (1 + u * w)
    g_t = u * u / (2 * t * t) - e * w * (1 + u * w) / 2
    h_t = u * u_t / t**2 - u * u / t**3 - (e_t * w * (1 + u * w) + e * w_t * (1 + u * w) + e * w * (u_t * w + u * w_t)) / 2
    cross = -(k * u * w / t + w * w / 2 + t * w * w_t)
    value = total * u - e - u * u / (2 * t) + np.log(w) / 2
    bend = _upper(el.T @ (el * (m * c)[:, None]))
    ends = [2 * t * m @ g_t, m @ (4 * t * t * h_t + 4 * t * g_t)]
    return np.concatenate([[m @ value], (m * k) @ el, bend, (2 * t * m * cross) @ el, ends])


def newton_step(row) -> dict:
    """The next place of a group from the sums at the last one (``beta``, ``log_sd``): accepted or halved back.

    A group is done when a step no longer moves or gains anything; it has converged then, unless halving found nothing
    higher on a slope. Levels without rows or without counts stay as they are.
    """
    size, sums_at = len(row.n), np.asarray(row.vector, float)
    pairs = size * (size + 1) // 2
    fitted, slope, bend, cross, (slope_sd, bend_sd) = np.split(sums_at, np.cumsum([1, size, pairs, size]))
    live = [i for i in range(size) if row.ys[i] > 0]
    here = np.array([*[row.beta[i] for i in live], row.log_sd])
    sums = np.asarray(row.ys, float)[live]
    value = float(fitted[0]) + float(here[:-1] @ sums)
    out = {"value": row.value, "scale": row.scale, "done": False, "converged": False}
    old = None if row.accepted is None else np.asarray(row.accepted, float)
    if old is not None and value < row.value:
        out["scale"] /= 2
        step = np.asarray(row.step, float)
        if out["scale"] < 1e-6:
            out |= {"done": True, "converged": bool(np.abs(row.gradient).max() < 1e-3 * (1 + abs(row.value)))}
        return out | {"accepted": old, "gradient": np.asarray(row.gradient, float), "step": step, "next": old + out["scale"] * step * (not out["done"])}
    gradient = np.append(sums - slope[live], slope_sd)
    hessian = np.zeros((len(live) + 1, len(live) + 1))
    hessian[:-1, :-1] = (_square(bend, size) - np.diag(slope))[np.ix_(live, live)]
    hessian[:-1, -1] = hessian[-1, :-1] = cross[live]
    hessian[-1, -1] = bend_sd
    free = np.ones(len(here), bool)
    free[-1] = here[-1] > SMALLEST_LOG_SD + 1e-9 or gradient[-1] > 0
    roots, vectors = np.linalg.eigh(hessian[np.ix_(free, free)])
    downhill = -np.maximum(np.abs(roots), 1e-6 * max(1.0, np.abs(roots).max()))
    step = np.zeros(len(here))
    step[free] = np.clip(-vectors @ ((vectors.T @ gradient[free]) / downhill), -2.0, 2.0)
    if gradient[-1] < 0 and here[-1] < -1 and abs(step[-1] + 0.5) < 0.1:
        # A variance that only shrinks falls by this step again and again: try none at once.
        step[-1] = SMALLEST_LOG_SD - here[-1]
    step[-1] = max(step[-1], SMALLEST_LOG_SD - here[-1])
    gained = math.inf if old is None else value - row.value
    still = np.abs(step).max() < 1e-8 or gained < 1e-13 * (1 + abs(value))
    out |= {"value": value, "scale": 1.0, "done": bool(still), "converged": bool(still)}
    return out | {"accepted": here, "gradient": gradient, "step": step, "next": here + step * (not still)}


_STATE = (
    "beta array<double>, log_sd double, value double, scale double, accepted array<double>, gradient array<double>, "
    "step array<double>, done boolean, converged boolean, n array<double>, ys array<double>"
)


def poisson_fit(df: DataFrame, group: str, unit: str, y: str, factor: str, levels: Sequence[int] | None = None):
    """Fit per group (``group, beta`` per level, ``log_sd, converged``) and unit effects (``group, unit, effect``).

    The Laplace likelihood is maximised by Newton steps, halved where they do not go up. Each round is one grouped
    sum over the patterns of the groups that still move; its state is a stored row per group. ``beta`` is null at a
    level without rows in the group, and ``NOTHING`` at one without counts. After ``OUTER`` rounds a group counts as not converged.
    """
    if levels is None:
        levels = _levels(df, group, unit, y, [factor])[factor]
    size = len(levels)
    rows = _complete(df, group, unit, y, {factor: levels})
    here = [F.col(factor) == F.lit(level) for level in levels]
    units = rows.groupBy(group, unit).agg(
        F.array(*[F.count_if(h).cast("double") for h in here]).alias("n"),
        F.array(*[F.sum(F.when(h, F.col("_y")).otherwise(0.0)) for h in here]).alias("ys"),
        F.sum("_y").alias("total"),
    )
    patterns = units.groupBy(group, "n", "total").agg(
        F.count(F.lit(1)).alias("units"), F.array(*[F.sum(F.col("ys")[i]) for i in range(size)]).alias("ys")
    )
    patterns = stored(patterns)
    sums = patterns.groupBy(group).agg(
        F.array(*[F.sum(F.col("units") * F.col("n")[i]) for i in range(size)]).alias("n"),
        F.array(*[F.sum(F.col("ys")[i]) for i in range(size)]).alias("ys"),
    )
    start = F.zip_with("ys", "n", lambda total, n: F.when(n > 0, F.when(total > 0, F.log(total / n)).otherwise(NOTHING)))
    types = dict(f.rsplit(" ", 1) for f in _STATE.split(", "))
    fresh = {"beta": start, "log_sd": F.lit(math.log(0.3)), "scale": F.lit(1.0), "done": F.lit(False), "converged": F.lit(False)}
    state = sums.select(group, *[fresh.get(c, F.col(c) if c in ("n", "ys") else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    kind = dict(df.dtypes)[group]

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, row in zip(batch[group], batch.drop(columns=[group]).itertuples(index=False), strict=True):
                new = newton_step(row)
                live = iter(new.pop("next"))
                beta = [next(live) if total > 0 else NOTHING if n > 0 else None for n, total in zip(row.n, row.ys, strict=True)]
                out.append({group: key, "beta": beta, "log_sd": next(live), "n": row.n, "ys": row.ys, **new})
            yield pd.DataFrame(out, columns=[group, *types])

    for _ in range(OUTER):
        moving = state.where(~F.col("done"))
        at = summed(compact_join(patterns.drop("ys"), moving.select(group, "beta", "log_sd"), [group]), [group], laplace_sums)
        moved = compact_join(moving, at, [group]).mapInPandas(move, f"`{group}` {kind}, {_STATE}")
        left = Observation()
        moved = moved.unionByName(state.where("done")).observe(left, F.count_if(~F.col("done")).alias("n"))
        state = stored(moved)
        if not left.get["n"]:
            break
    fit = state.select(group, "beta", "log_sd", "converged")
    joined = units.select(group, unit, "n", "total").join(fit, group)
    types = dict(joined.dtypes)

    def modes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beta = _vectors(batch.column("beta"))
            rate = (_vectors(batch.column("n")) * np.where(np.isnan(beta), 0.0, np.exp(beta))).sum(axis=1)
            variance = np.exp(2 * batch.column("log_sd").to_numpy())
            effect = unit_modes(batch.column("total").to_numpy().astype(float), rate, variance)
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column(unit), pa.array(effect)], [group, unit, "effect"])

    effects = joined.mapInArrow(modes, f"`{group}` {types[group]}, `{unit}` {types[unit]}, effect double")
    return fit, effects


def impute_poisson(
    df: DataFrame, targets: DataFrame, group: str, unit: str, y: str, factor: str
) -> DataFrame:
    """Targets (``group, unit, factor``) with the rounded expected count as column ``y``, and ``converged``.

    Null at a level that no row of the group has; ``converged`` is null for a group without a fit.
    """
    levels = _levels(df, group, unit, y, [factor])[factor]
    fit, effects = poisson_fit(df, group, unit, y, factor, levels)
    joined = targets.join(effects, [group, unit], "left").join(fit.select(group, "beta", "converged"), group, "left")
    level = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<long>"), F.col(factor).cast("long")).cast("int")
    value = F.exp(F.try_element_at("beta", F.nullif(level, F.lit(0))) + F.coalesce(F.col("effect"), F.lit(0.0)))
    return joined.select(*targets.columns, round_to(value).alias(y), "converged")
