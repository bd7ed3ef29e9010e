import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import importance, loess, mixed, ols, rank_corr
from sensorframe.operators.tails import f_upper, t_two_sided


def test_tails():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-7)
    assert f_upper(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert f_upper(3.0984, 3, 20) == pytest.approx(0.05, abs=1e-5)


def cells(spark, rng, n=80):
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [100, 0, 3]
    y = 2 + 0.5 * x[:, 0] - 3 * x[:, 2] + rng.normal(size=n)
    rows = [("a", *map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "k string, x1 double, x2 double, x3 double, y double")
    return df, x, y


def test_simple_line(spark):
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in ((1, 1), (2, 3), (3, 4))], "k string, x double, y double")
    m = ols.moments(df, ["k"], "y", ["x"])
    c = {r.term: r for r in ols.coefficients(m, ["k"], ["x"]).collect()}
    assert c["x"].estimate == pytest.approx(1.5)
    assert c["(Intercept)"].estimate == pytest.approx(-1 / 3)
    assert ols.fit_summaries(m, ["k"], ["x"]).first().r_squared == pytest.approx(0.9642857, abs=1e-7)


def dense(x, y):
    a = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rss = float(((y - a @ beta) ** 2).sum())
    s2 = rss / (len(y) - a.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * s2)
    return beta, se, rss


def test_matches_dense_least_squares(spark):
    df, x, y = cells(spark, np.random.default_rng(1))
    names = ["x1", "x2", "x3"]
    m = ols.moments(df.repartition(5), ["k"], "y", names)
    beta, se, rss = dense(x, y)
    got = ols.coefficients(m, ["k"], names).collect()
    assert [r.term for r in got] == ["(Intercept)", *names]
    assert [r.estimate for r in got] == pytest.approx(beta.tolist(), rel=1e-9)
    assert [r.std_error for r in got] == pytest.approx(se.tolist(), rel=1e-9)
    g = ols.fit_summaries(m, ["k"], names).first()
    n = len(y)
    assert g.deviance == pytest.approx(rss, rel=1e-10)
    assert g.r_squared == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), rel=1e-10)
    assert g.aic == pytest.approx(n * (math.log(2 * math.pi * rss / n) + 1) + 2 * 5)
    assert g.df_residual == n - 4


def test_dependent_predictor_is_left_empty(spark):
    df, x, y = cells(spark, np.random.default_rng(2))
    df = df.withColumn("x4", 2 * F.col("x1") - F.col("x2")).withColumn("x5", F.lit(1.0))
    names = ["x1", "x2", "x4", "x5", "x3"]
    c = {r.term: r for r in ols.coefficients(ols.moments(df, ["k"], "y", names), ["k"], names).collect()}
    assert c["x4"].estimate is None and c["x5"].estimate is None
    assert c["x3"].estimate == pytest.approx(dense(x, y)[0][3], rel=1e-6)


def test_stepwise_finds_the_best_subset(spark):
    df, x, y = cells(spark, np.random.default_rng(3))
    names = ["x1", "x2", "x3"]
    m = ols.moments(df, ["k"], "y", names)
    chosen = [r.term for r in ols.coefficients(m, ["k"], names, step=True).collect()][1:]
    n = len(y)
    best = min(
        ([i for i in range(3) if mask >> i & 1] for mask in range(8)),
        key=lambda s: n * math.log(dense(x[:, s], y)[2] / n) + 2 * (len(s) + 1),
    )
    assert chosen == [names[i] for i in best]


def test_eligibility_limits_the_model(spark):
    df, x, y = cells(spark, np.random.default_rng(4))
    names = ["x1", "x2", "x3"]
    mask = F.array(F.lit(True), F.lit(False), F.lit(True))
    c = ols.coefficients(ols.moments(df, ["k"], "y", names, mask), ["k"], names).collect()
    assert [r.term for r in c] == ["(Intercept)", "x1", "x3"]
    assert [r.estimate for r in c] == pytest.approx(dense(x[:, [0, 2]], y)[0].tolist(), rel=1e-9)


def test_permutation_importance(spark):
    df, x, y = cells(spark, np.random.default_rng(5), 300)
    names = ["x1", "x2", "x3"]
    fitted = ols.models(ols.moments(df, ["k"], "y", names), ["k"], names)
    runs = []
    for parts in (2, 7):
        p = importance.permuted_moments(df.repartition(parts), ["k"], "y", names, 200, seed=9)
        rmse = importance.permutation_importance(fitted, p, ["k"], names, "perm_rmse").collect()
        runs.append({r.Variable: r.Importance for r in rmse})
    assert runs[0] == pytest.approx(runs[1], rel=1e-9)
    # Mean squared error after shuffling one predictor is the old one plus 2 b^2 var(x) on average.
    beta, _, rss = dense(x, y)
    mse = rss / len(y)
    for i, name in enumerate(names):
        want = math.sqrt(mse + 2 * beta[i + 1] ** 2 * x[:, i].var()) - math.sqrt(mse)
        assert runs[0][name] == pytest.approx(want, abs=0.02)


def test_permuted_moments_are_a_permutation(spark):
    rows = [("a", float(i), float(i % 7)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    p = importance.permuted_moments(df, ["k"], "y", ["x"], 40)
    cross = np.array([r.cross for r in p.collect()])
    x = np.arange(700.0)
    # Covariance of x with its own shuffle varies around zero with sd var / sqrt(n - 1).
    z = cross[:, 0] / (x.var() / math.sqrt(699))
    assert abs(z.mean()) < 3 / math.sqrt(40) and 0.6 < z.std() < 1.5


def test_pdp_importance(spark):
    df = spark.createDataFrame([("a", i / 6, 2.0 * i / 6 + (i % 2)) for i in range(61)], "k string, x double, y double")
    coefs = ols.coefficients(ols.moments(df, ["k"], "y", ["x"]), ["k"], ["x"])
    ranges = importance.predictor_ranges(df, ["k"], "y", ["x"])
    got = importance.pdp_importance(coefs, ranges, ["k"]).first().Importance
    slope = [r.estimate for r in coefs.collect()][1]
    assert got == pytest.approx(abs(slope) * 2.9732137, rel=1e-7)


def dense_reml(y, x, ids, lam):
    z = (ids[:, None] == np.unique(ids)[None, :]).astype(float)
    v = np.eye(len(y)) + lam * z @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    res = y - x @ beta
    s2 = res @ vi @ res / (len(y) - x.shape[1])
    crit = (len(y) - x.shape[1]) * math.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return crit, beta, lam * z.T @ vi @ res


def test_gaussian_model_matches_dense_reml(spark):
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 12, 90)
    year, month = rng.integers(0, 2, 90), rng.integers(1, 4, 90)
    y = 20 + 3 * year + month + rng.normal(size=12)[ids] * 2 + rng.normal(size=90)
    rows = [("g", int(i), int(a), int(m), float(v)) for i, a, m, v in zip(ids, year, month, y)]
    df = spark.createDataFrame(rows, "g string, id int, year int, month int, y double")
    fit, effects = mixed.gaussian_fit(df, "g", "id", "y", {"year": [0, 1], "month": [1, 2, 3]})
    f = fit.first()
    x = np.column_stack([np.ones(90), year == 1, month == 2, month == 3]).astype(float)
    crit, beta, u = dense_reml(y, x, ids, f.ratio)
    assert f.beta == pytest.approx(beta.tolist(), rel=1e-8)
    assert crit <= min(dense_reml(y, x, ids, f.ratio * k)[0] for k in (0.5, 0.9, 1.1, 2)) + 1e-9
    got = {r.id: r.effect for r in effects.collect()}
    assert [got[i] for i in np.unique(ids)] == pytest.approx(u.tolist(), abs=1e-8)


def test_impute_gaussian_predicts_unseen_units(spark):
    rows = [("g", i, y, 10.0 + i + y + (i * y) % 3 * 0.1) for i in range(6) for y in (0, 1, 2)]
    df = spark.createDataFrame(rows, "g string, id int, year int, v double")
    targets = spark.createDataFrame([("g", 0, 1), ("g", 99, 1)], "g string, id int, year int")
    out = {r.id: r.v for r in mixed.impute_gaussian(df, targets, "g", "id", "v", ["year"]).collect()}
    assert out[0] < out[99] and out[99] == pytest.approx(13.5, abs=0.3)


def laplace_loglik(theta, n, total, units, sums):
    """Dense: the mode of every unit by bisection, then the Laplace likelihood."""
    beta, var = theta[:-1], math.exp(2 * theta[-1])
    rate = n @ np.exp(beta)
    low, high = np.full(len(rate), -40.0), np.full(len(rate), 40.0)
    for _ in range(200):
        u = (low + high) / 2
        up = total - rate * np.exp(u) - u / var > 0
        low, high = np.where(up, u, low), np.where(up, high, u)
    e = rate * np.exp(u)
    return float(units @ (total * u - e - u * u / (2 * var) - 0.5 * np.log1p(var * e)) + beta @ sums)


def test_laplace_sums_against_differences():
    """Gradient and Hessian of the grouped sums are those of the dense likelihood."""
    rng = np.random.default_rng(3)
    n = rng.integers(0, 4, (25, 3)).astype(float) + [1, 0, 0]
    total, units = rng.integers(0, 12, 25).astype(float), rng.integers(1, 5, 25).astype(float)
    theta = np.array([0.4, -0.3, 0.9, math.log(0.7)])
    lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    columns = {"n": lists(n), "total": pa.array(total), "units": pa.array(units), "beta": lists([theta[:-1]] * 25), "log_sd": pa.array([theta[-1]] * 25)}
    got = mixed.laplace_sums(pa.RecordBatch.from_pydict(columns))
    fitted, slope, bend, cross, (slope_sd, bend_sd) = np.split(got, [1, 4, 10, 13])
    f = lambda t: laplace_loglik(t, n, total, units, np.zeros(3))
    h, eye = 1e-4, np.eye(4) * 1e-4
    gradient = [(f(theta + e) - f(theta - e)) / (2 * h) for e in eye]
    hessian = np.array([[(f(theta + a + b) - f(theta + a - b) - f(theta - a + b) + f(theta - a - b)) / (4 * h * h) for a in eye] for b in eye])
    assert fitted[0] == pytest.approx(f(theta), rel=1e-10)
    assert [*(-slope), slope_sd] == pytest.approx(gradient, rel=1e-5)
    mine = np.zeros((4, 4))
    mine[:3, :3] = mixed._square(bend, 3) - np.diag(slope)
    mine[:3, 3] = mine[3, :3] = cross
    mine[3, 3] = bend_sd
    assert mine.ravel().tolist() == pytest.approx(hessian.ravel().tolist(), rel=1e-3, abs=1e-4)


def test_poisson_fits_of_all_kinds(spark):
    """Spread units, none, a level without rows, one without counts: the dense likelihood is nowhere higher."""
    rng = np.random.default_rng(5)
    rows = []
    for g, sd in (("wide", 1.0), ("none", 0.0), ("under", 0.0)):
        u = rng.normal(size=40) * sd
        for i in range(40):
            for k in range(3):
                if (g, k) == ("none", 2):
                    continue
                count = 5 if g == "under" else rng.poisson(math.exp(1 + 0.5 * k + u[i]))
                rows.append((g, i, k, 0.0 if (g, k) == ("wide", 1) else float(count)))
    df = spark.createDataFrame(rows, "g string, id int, year int, n double")
    fit = {r.g: r for r in mixed.poisson_fit(df, "g", "id", "n", "year")[0].collect()}
    assert all(r.converged for r in fit.values())
    assert fit["none"].beta[2] is None and fit["wide"].beta[1] < -5
    assert fit["under"].log_sd == mixed.SMALLEST_LOG_SD and math.exp(fit["wide"].log_sd) == pytest.approx(1, abs=0.3)
    for g, r in fit.items():
        live = [k for k in range(3) if r.beta[k] is not None and r.beta[k] > mixed.NOTHING]
        mine = [x for x in rows if x[0] == g]
        ys = np.zeros((40, 3))
        for _, i, k, c in mine:
            ys[i, k] = c
        data = (np.ones((40, len(live))), ys[:, live].sum(1), np.ones(40), ys[:, live].sum(0))
        theta = np.array([*[r.beta[k] for k in live], r.log_sd])
        top = laplace_loglik(theta, *data)
        for step in np.eye(len(theta)) * 0.02:
            for sign in (-1, 1):
                moved = theta + sign * step
                if moved[-1] >= mixed.SMALLEST_LOG_SD:
                    assert laplace_loglik(moved, *data) <= top + 1e-6


def test_fits_that_do_not_converge_say_so(spark, monkeypatch):
    rows = [("a", i, i % 2, float(i % 7 + i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id int, year int, v double")
    targets = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "g string, id int, year int")
    out = {r.g: (r.v, r.converged) for r in mixed.impute_poisson(df, targets, "g", "id", "v", "year").collect()}
    assert out["a"][1] and out["a"][0] is not None and out["b"] == (None, None)
    monkeypatch.setattr(mixed, "OUTER", 1)
    out = {r.g: r.converged for r in mixed.impute_poisson(df, targets, "g", "id", "v", "year").collect()}
    assert out["a"] is False
    # Units that differ without any noise: no ratio is large enough.
    exact = spark.createDataFrame([("a", i, k, 10.0 * i) for i in range(9) for k in range(4)], "g string, id int, year int, v double")
    out = {r.g: r.converged for r in mixed.impute_gaussian(exact, targets, "g", "id", "v", ["year"]).collect()}
    assert out == {"a": False, "b": None}


def test_level_that_only_other_groups_have_gives_null(spark):
    rows = [("a", i % 5, i % 2, float(i % 2 + i % 5)) for i in range(60)] + [("b", i % 5, 1 + i % 2, float(i % 5 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id int, year int, v double")
    targets = spark.createDataFrame([(g, 1, y) for g in "ab" for y in (0, 1, 2)], "g string, id int, year int")
    for out in (mixed.impute_gaussian(df, targets, "g", "id", "v", ["year"]), mixed.impute_poisson(df, targets, "g", "id", "v", "year")):
        assert {(r.g, r.year) for r in out.collect() if r.v is None} == {("a", 2), ("b", 0)}


def test_poisson_laplace_near_quadrature(spark):
    rng = np.random.default_rng(7)
    n_units, levels = 60, 4
    u = rng.normal(size=n_units) * 0.4
    beta = np.array([4.0, 4.2, 3.8, 4.1])
    counts = rng.poisson(np.exp(beta[None, :] + u[:, None]))
    rows = [("g", i, k, float(counts[i, k])) for i in range(n_units) for k in range(levels)]
    df = spark.createDataFrame(rows, "g string, id int, year int, n double")
    fit, effects = mixed.poisson_fit(df, "g", "id", "n", "year", list(range(levels)))
    f = fit.first()
    theta = np.array([*f.beta, f.log_sd])
    assert f.beta == pytest.approx(beta.tolist(), abs=0.2) and math.exp(f.log_sd) == pytest.approx(0.4, abs=0.12)

    def quadrature(t):
        nodes = np.linspace(-8, 8, 4001)
        sd = math.exp(t[-1])
        total = 0.0
        for y in counts:
            g = (y[:, None] * (t[:-1, None] + nodes * sd) - np.exp(t[:-1, None] + nodes * sd)).sum(0) - nodes**2 / 2
            top = g.max()
            total += top + math.log(np.exp(g - top).sum() * (nodes[1] - nodes[0]) / math.sqrt(2 * math.pi))
        return total

    ones = np.ones((n_units, levels))
    laplace = laplace_loglik(theta, ones, counts.sum(1).astype(float), np.ones(n_units), counts.sum(0).astype(float))
    assert laplace == pytest.approx(quadrature(theta), abs=0.05)
    for step in np.eye(levels + 1) * 0.05:
        for sign in (-1, 1):
            moved = theta + sign * step
            other = laplace_loglik(moved, ones, counts.sum(1).astype(float), np.ones(n_units), counts.sum(0).astype(float))
            assert other <= laplace + 1e-6
    assert effects.count() == n_units


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([("a", *map(float, v)) for v in ((1, 2), (2, 2), (2, 5), (4, 1))], "k string, x double, y double")
    rho = {(r.x, r.y): r.rho for r in rank_corr.spearman(df, ["k"], ["x", "y"]).collect()}
    assert rho[("x", "y")] == pytest.approx(-0.5) and rho[("x", "x")] == pytest.approx(1)
    assert len(rho) == 4


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(8)
    rows = [("ab"[i % 2], *map(float, rng.integers(0, 9, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    pdf = df.toPandas()
    for r in rank_corr.spearman(df, ["k"], ["x", "y", "z"]).collect():
        g = pdf[pdf.k == r.k]
        assert r.rho == pytest.approx(g[r.x].rank().corr(g[r.y].rank()), abs=1e-9) and r.n == 200


def test_loess_reproduces_a_parabola(spark):
    df = spark.createDataFrame([("a", float(x), 3.0 - x + 0.5 * x * x) for x in range(40)], "k string, x double, y double")
    for r in loess.loess(df, ["k"], "x", "y", 0.5, se=True).collect():
        assert r.fit == pytest.approx(3 - r.x + 0.5 * r.x**2, abs=1e-6)
        assert r.se < 0.05


def test_loess_standard_error_is_in_range(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([("a", float(x), float(v)) for x, v in enumerate(rng.normal(size=400))], "k string, x double, y double")
    se = [r.se for r in loess.loess(df, ["k"], "x", "y", 0.5, se=True).collect()]
    # Quadratic fit over 200 points with tricube weights: about 1.6 / sqrt(200) inside.
    assert 0.07 < np.median(se) < 0.16


def test_loess_gives_every_place(spark):
    # Ties narrow the width to nothing at most places; a span above 1 widens the largest distance.
    rows = [("tie", float(i // 50), float(i)) for i in range(100)] + [("ok", float(i), 2.0 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for span in (0.3, 1.0, 1.5):
        got = loess.loess(df, ["k"], "x", "y", span).collect()
        assert [sum(r.k == k for r in got) for k in ("tie", "ok")] == [80, 80]
        assert all(r.fit == pytest.approx(2 * r.x, abs=1e-6) for r in got if r.k == "ok")
        assert all(r.fit is None for r in got if r.k == "tie")


def test_unseen_level_gives_null(spark):
    rows = [("a", i % 5, i % 2, float(i % 2 + i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id int, year int, v double")
    targets = spark.createDataFrame([("a", 1, 0), ("a", 1, 7), ("a", 99, 1)], "g string, id int, year int")
    out = {(r.id, r.year): r.v for r in mixed.impute_gaussian(df, targets, "g", "id", "v", ["year"]).collect()}
    assert out[1, 7] is None and out[1, 0] is not None and out[99, 1] is not None
    out = {(r.id, r.year): r.v for r in mixed.impute_poisson(df, targets, "g", "id", "v", "year").collect()}
    assert out[1, 7] is None and out[1, 0] is not None and out[99, 1] is not None


def test_repeated_rows_are_shuffled_one_by_one(spark):
    rows = [("a", float(i % 2), float(i % 2)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    cross = [r.cross[0] for r in importance.permuted_moments(df, ["k"], "y", ["x"]).collect()]
    assert len(cross) == 10 and all(abs(c) < 0.02 for c in cross)


def walked(i, n, sim, seed=1):
    """The bijection in plain Python."""
    side, out = math.isqrt(n - 1) + 1, i
    while out >= n or out is i:
        left, right = divmod(out, side)
        for turn in range(importance.ROUNDS):
            y = (right * importance.FACTOR + sim * importance.STEP + turn * importance.LEAP + seed) % importance.PRIME
            left, right = right, (left + (y * y + y * (turn + 1)) % importance.PRIME) % side
        out = left * side + right
        if out < n:
            return out


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 5000])
def test_partners_are_a_bijection(spark, n):
    rows = spark.range(n).select("id", F.explode(F.array(*[F.lit(s).cast("long") for s in (1, 2, 10)])).alias("sim"))
    rows = importance.with_partner(rows.withColumn("n", F.lit(n).cast("long")), "id", "n", "sim", "to").collect()
    for sim in (1, 2, 10):
        got = {r.id: r.to for r in rows if r.sim == sim}
        assert sorted(got.values()) == list(range(n))
        assert n < 100 or sum(i == j for i, j in got.items()) < 10
        assert all(got[i] == walked(i, n, sim) for i in list(range(n))[:200])


def test_tails_keep_their_digits_in_large_cells():
    for df in (1e10, 1e12):
        assert t_two_sided(2.0, df) == pytest.approx(math.erfc(math.sqrt(2)), rel=1e-8)


def test_imputation_reads_its_rows_once(spark):
    """What leads to the rows runs once; levels, cells, unit sums and effects start from stored tables."""
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    df = spark.createDataFrame([("g", i, y, 10.0 + i + y + (i * y) % 3 * 0.1) for i in range(6) for y in (0, 1, 2)], "g string, id int, year int, v double")
    targets = spark.createDataFrame([("g", 0, 1)], "g string, id int, year int")
    assert len(mixed.impute_gaussian(df.mapInPandas(seen, df.schema), targets, "g", "id", "v", ["year"]).collect()) == 1
    assert runs.value == 18
