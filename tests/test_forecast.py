import math
import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from hourloom.functions import lasso
from hourloom.functions import numeric as num
from hourloom.operators import forecast as fc
from hourloom.operators import inference as inf
from hourloom.operators import metrics as mt
from hourloom.operators import models as mo
from hourloom.operators import relations as rel


def test_rolling_quantiles_use_only_earlier_known_days(spark):
    rng = random.Random(5)
    rows = [(h, date(2024, 1, 1) + timedelta(days=i), None if rng.random() < 0.25 else rng.random() * 10, None if rng.random() < 0.1 else rng.random() * 10) for h in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "hour int, day date, y double, point double")
    got = {(r.hour, r.day): r.q for r in fc.rolling_residual_quantiles(df, ["hour"], "day", "y", "point", "q", 12, 6).collect()}
    for hour in (0, 1):
        seen = []
        for h, d, y, p in [r for r in rows if r[0] == hour]:
            q = got[(h, d)]
            if len(seen) < 6:
                assert q is None
            elif p is not None:
                assert np.allclose(q, p + np.quantile(seen[-12:], num.QUANTILE_GRID))
            if y is not None and p is not None:
                seen.append(y - p)


def test_dm_statistic_matches_direct_sum_across_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.convolve(rng.normal(size=400), np.ones(5))[:400] + 0.2
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "k string, i int, d double")
    r = inf.dm_test(df, ["k"], ["i"], "d", block=37).first()
    lag = min(23, int(math.floor(400 ** (1 / 3))))
    c = x - x.mean()
    v = c @ c / 400 + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / 400 for k in range(1, lag + 1))
    stat = x.mean() / math.sqrt(v / 400)
    assert r.lag == lag and abs(r.dm_stat - stat) < 1e-9 and abs(r.p_value - math.erfc(abs(stat) / math.sqrt(2))) < 1e-6
    short = inf.dm_test(df.where("i < 5"), ["k"], ["i"], "d").first()
    assert short.n == 5 and short.dm_stat is None and short.lag is None


def test_bootstrap_matches_its_definition(spark):
    import hashlib

    vals = [0.5, -1.0, 0.25, 2.0, -0.75]
    df = spark.createDataFrame([("s", f"e{i}", v) for i, v in enumerate(vals)], "s string, e string, v double")
    r = inf.block_bootstrap(df, ["s"], "e", "v", draws=300, seed=9).first()
    u = lambda d, i: int(hashlib.md5(f"9|{d}|{i}".encode()).hexdigest()[:13], 16) / 2**52
    means = [np.mean([vals[int(u(d, i) * 5)] for i in range(5)]) for d in range(300)]
    assert r.n_events == 5 and abs(r.estimate - np.mean(vals)) < 1e-12
    assert abs(r.ci_low - np.quantile(means, 0.025)) < 1e-12 and abs(r.p_below_zero - np.mean(np.array(means) < 0)) < 1e-12


def test_erfc_accuracy(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", num.erfc(F.col("x")).alias("e")).collect():
        assert abs(r.e - math.erfc(r.x)) < 1e-14


def test_mae_ignores_non_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, float("inf")), (float("nan"), 1.0), (None, 1.0), (3.0, 3.5)], "y double, p double")
    assert df.agg(mt.mae(F.col("y"), F.col("p")).alias("m")).first().m == 0.75


def test_lasso_path_is_optimal_and_finds_the_signal():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 120))
    y = x[:, :3] @ np.array([2.0, -1.5, 1.0]) + rng.normal(size=80) * 0.3
    w, b, failed, *_ = lasso.fit(x, y[:, None])
    assert not failed[0] and {0, 1, 2} <= set(np.flatnonzero(w[:, 0]))
    xc, yc = x - x.mean(0), y - y.mean()
    g, c = xc.T @ xc / 80, xc.T @ yc / 80
    variance = lasso.noise_variance(g, c[:, None], np.array([yc @ yc]), 80)
    path, alpha, ended, *_ = lasso.aic_path(g, c, float(yc @ yc), 80, float(variance[0]))
    settled, still = lasso.descend(g, c, alpha, tol=1e-10)
    assert ended and still and np.abs(path - settled).max() < 1e-6


def test_many_models_blocks_do_not_change_the_fit(spark):
    rng = np.random.default_rng(8)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    xs = rng.normal(size=(40, 6))
    vec = spark.createDataFrame([("p", d, [f"f{j}" for j in range(6)], [float(v) for v in x]) for d, x in zip(days, xs)], "panel string, day date, names array<string>, x array<double>")
    y = [[float(3 * x[0] - x[1] + 0.01 * h + rng.normal() * 0.1) if not (h == 2 and i == 5) else None for h in range(24)] for i, x in enumerate(xs)]
    tgt = spark.createDataFrame([("p", d, v) for d, v in zip(days, y)], "panel string, day date, y array<double>")
    refits = spark.createDataFrame([("p", d) for d in days[30:]], "panel string, day date")
    fits = [sorted((r.refit_day, r.hour, round(r.intercept, 9), [(t.feature, round(t.coef, 9)) for t in r.terms], r.n_rows)
                   for r in mo.fit_many_lasso(vec, tgt, refits, ["panel"], 30, block_days=b).collect()) for b in (1, 7)]
    assert fits[0] == fits[1] and len(fits[0]) == 240
    assert all("f0" in [t[0] for t in f[3]] for f in fits[0])
    assert {f[4] for f in fits[0] if f[1] == 2} == {29, 30} and {f[4] for f in fits[0] if f[1] != 2} == {30}


def test_what_if_equals_full_prediction(spark):
    terms = spark.createDataFrame([(date(2024, 1, 1), 0, "gen_d_h05", 0.4, 10.0, 2.0), (date(2024, 1, 1), 0, "gen_dminus1d_h05", 0.3, 10.0, 2.0)], "day date, hour int, feature string, coef double, x_median double, x_mad double")
    heads = spark.createDataFrame([(date(2024, 1, 1), 0, 0.1, 50.0, 5.0)], "day date, hour int, intercept double, y_median double, y_mad double")
    base = spark.createDataFrame([(date(2024, 1, 1), "gen_d_h05", 12.0), (date(2024, 1, 1), "gen_dminus1d_h05", 9.0)], "day date, feature string, value double")
    over = spark.createDataFrame([("s", date(2024, 1, 1), "gen", 5, 2.0)], "scenario string, day date, series string, hour int, value double")
    fast = mo.level(mo.what_if_scores(mo.linear_scores(base, terms, heads, []), over, base, terms, [], ["scenario"])).first().point
    changed = base.withColumn("value", F.when(F.col("feature") == "gen_d_h05", 2.0).otherwise(F.col("value")))
    assert abs(fast - mo.predict_linear(changed, terms, heads, []).first().point) < 1e-12


def test_duplicate_right_key_fails(spark):
    import pytest

    left = spark.createDataFrame([(1, "a")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(Exception, match="key is not unique"):
        rel.join_many_to_one_checked(left, right, ["k"]).collect()
    assert rel.join_many_to_one_checked(left, right.where("w = 'x'"), ["k"]).count() == 1


def test_certificates_tell_right_from_wrong_models():
    """Each choice is stationary and no worse than its neighbours; other penalties, coefficients and models are not."""
    r = np.random.default_rng(11)
    for n, p in ((40, 6), (14, 60), (60, 30)):
        x = r.normal(size=(n, p))
        x[:, 1] = x[:, 0] + 0.05 * r.normal(size=n)  # near copies make columns leave the path
        y = x[:, [0, 2, 3]] @ np.array([[1.0, 0.3], [-0.5, 0.0], [0.2, 0.9]]) + r.normal(size=(n, 2))
        got = lasso.fit(x, y)
        assert not got.failed.any() and not got.runaway.any()
        xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
        for k in range(2):
            assert got.violation[k] < 1e-8
            assert not got.aic[k] > got.aic_before[k] and not got.aic[k] > got.aic_after[k]
            assert lasso.violation(xc, yc[:, k], got.coef[:, k], got.penalty[k] * 1.1) > 1e-3
            assert lasso.violation(xc, yc[:, k], got.coef[:, k] * 0.9, got.penalty[k]) > 1e-3
            settled, _ = lasso.descend(xc.T @ xc / n, xc.T @ yc[:, k] / n, got.penalty[k], tol=1e-12)
            assert np.abs(settled - got.coef[:, k]).max() < 1e-5


def test_runaway_paths_are_counted(monkeypatch):
    r = np.random.default_rng(12)
    x = r.normal(size=(50, 4))
    y = 0.02 * x[:, :1] + 1e-3 * r.normal(size=(50, 1))
    monkeypatch.setattr(lasso, "MAX_COEF", 1e-3)
    got = lasso.fit(x, y)
    assert got.runaway.tolist() == [True] and got.failed.tolist() == [True] and (got.coef == 0).all() and np.isnan(got.violation[0])


def test_day_diagnostics_and_rollup(spark):
    rows = [(d, h, int(h == 3), int(h == 4 and d == 2), int(h > 20), 5 * d, d, d == 1, float(10 * d + h)) for d in (1, 2, 3) for h in range(24)]
    models = spark.createDataFrame(rows, "refit_day int, hour int, n_degenerate int, n_failed int, n_runaway int, n_ffill int, n_bfill int, ridge_variance boolean, max_abs_coef double")
    days = mo.day_diagnostics(models, [])
    got = mt.model_diagnostics_rollup(days, spark.createDataFrame([(1,), (2,), (9,)], "refit_day int"), ["refit_day"],
                                           ["n_degenerate_hours", "n_failed_hours", "n_runaway_hours", "n_ffill", "n_bfill", "n_ridge"], "max_abs_coef").first()
    assert got.asDict() == {"n_models": 2, "n_degenerate_hours": 2, "n_failed_hours": 1, "n_runaway_hours": 6, "n_ffill": 15, "n_bfill": 3, "n_ridge": 1, "max_abs_coef": 43.0}


def test_bootstrap_draws_are_the_same_either_way(spark):
    """Values in the tasks or met by a join; groups of different sizes, a tie, missing values, no grouping at all."""
    r = random.Random(4)
    rows = [(g, f"e{i}", None if i == 3 else r.choice([-1.0, 0.5, r.random()])) for g, n in (("a", 7), ("b", 40), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, e string, x double")
    for by in (["g"], []):
        one = df if by else df.withColumn("e", F.concat("g", "e"))
        here, joined = (sorted(inf.block_bootstrap(one, by, "e", "x", draws=120, local_values=n).select(
            *by, "n_events", *[F.round(c, 9).alias(c) for c in ("estimate", "ci_low", "ci_high", "p_below_zero")]).collect(), key=str) for n in (1000, 0))
        assert here == joined and len(here) == (3 if by else 1)
    assert inf.block_bootstrap(df.limit(0), ["g"], "e", "x", draws=10).collect() == []
