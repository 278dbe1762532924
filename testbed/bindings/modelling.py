"""Features, models, what-if conditions and scenario paths."""

from pyspark.sql import functions as F

from hourloom.functions import numeric as num
from hourloom.operators import features as ft
from hourloom.operators import metrics as mt
from hourloom.operators import models as mo
from hourloom.operators import relations as rel
from hourloom.operators import timeline as tl
from hourloom.session import cut_lineage
from testbed import views as V
from testbed.registry import d, query, r
from testbed.views import TARGET, TZ, sql

L = V.LOCAL.format
EXOG, SLOW = ["click", "error", "signup"], "view"
WINDOW = 14


def profile(spark, folder):
    return tl.actuals_local_key(V.filled(spark, folder), ["series"], "ts", TZ, ["value"])


def features(spark, folder, override=None):
    p = profile(spark, folder)
    return ft.feature_matrix(p, [], "series", "value", TARGET, EXOG, SLOW, p.select("day").distinct(), override=override)


HH = "'h' || lpad(CAST(hour AS VARCHAR), 2, '0')"
DAYS = "SELECT DISTINCT day FROM pf"
FM = f"""SELECT f.day, feature, value FROM (
    SELECT day + CAST(lag AS INTEGER) AS day, 'price_lag' || lag || 'd_' || {HH} AS feature, value FROM pf, (SELECT unnest([1, 2, 3, 7]) AS lag) WHERE series = '{TARGET}'
    UNION ALL SELECT day + CAST(lag AS INTEGER), series || '_' || CASE WHEN lag = 0 THEN 'd' ELSE 'dminus' || lag || 'd' END || '_' || {HH}, value FROM pf, (SELECT unnest([0, 1, 7]) AS lag) WHERE series IN ('click', 'error', 'signup')
    UNION ALL SELECT day + 7, '{SLOW}_mean_dminus7d', avg(value) FROM pf WHERE series = '{SLOW}' GROUP BY day) f JOIN days ON days.day = f.day
    UNION ALL SELECT day, 'is_public_holiday', 0.0 FROM days
    UNION ALL SELECT day, 'weekday_' || k, CASE WHEN isodow(day) = k + 1 THEN 1.0 ELSE 0.0 END FROM days, (SELECT unnest(range(0, 7)) AS k)
    UNION ALL SELECT day, 'fourier_sin_' || k, sin(k * 2 * pi() * dayofyear(day) / 365.25) FROM days, (SELECT unnest([1, 2]) AS k)
    UNION ALL SELECT day, 'fourier_cos_' || k, cos(k * 2 * pi() * dayofyear(day) / 365.25) FROM days, (SELECT unnest([1, 2]) AS k)"""


@query("feature_matrix", sql(f"SELECT {d('day')} AS day, feature, {r('value')} AS value FROM fm", "pf", days=DAYS, fm=FM))
def feature_matrix(spark, folder):
    return features(spark, folder)


CW = f"SELECT x.day AS delivery, fm.day, feature, value FROM fm, days x WHERE x.day > fm.day AND x.day <= fm.day + {WINDOW}"


@query("calibration_window", sql(f"SELECT {d('delivery')} AS delivery, {d('day')} AS day, count(*) AS n, count(value) AS n_known, {r('sum(value)')} AS total FROM cw GROUP BY 1, 2", "pf", days=DAYS, fm=FM, cw=CW))
def calibration_window(spark, folder):
    f = features(spark, folder)
    cw = ft.calibration_window(f, [], f.select("day").distinct(), WINDOW)
    return cw.groupBy("delivery", "day").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.sum("value").alias("total"))


@query("robust_asinh_scale", sql(f"""SELECT {d('delivery')} AS delivery, feature, {r('any_value(med)')} AS median, {r('any_value(mad)')} AS mad, {r('avg(z)')} AS mean_z, {r('max(abs(sinh(z) * m1 + med - value))')} AS back_error FROM (
    SELECT *, asinh((value - med) / m1) AS z FROM (SELECT *, CASE WHEN mad < 1e-8 THEN 1.0 ELSE mad END AS m1 FROM (SELECT *, median(abs(value - med)) OVER (PARTITION BY delivery, feature) AS mad FROM (
      SELECT *, median(value) OVER (PARTITION BY delivery, feature) AS med FROM cw)))) GROUP BY 1, 2""", "pf", days=DAYS, fm=FM, cw=CW), digits={"back_error": 5})
def robust_asinh_scale(spark, folder):
    f = features(spark, folder)
    cw = ft.calibration_window(f, [], f.select("day").distinct(), WINDOW)
    keys = ["delivery", "feature"]
    rows = cw.join(ft.robust_stats(cw, keys, "value"), keys)
    z = num.robust_scale(F.col("value"), F.col("median"), F.col("mad"))
    rows = rows.withColumn("z", z).withColumn("back", num.robust_unscale(F.col("z"), F.col("median"), F.col("mad")))
    return rows.groupBy(*keys).agg(F.first("median").alias("median"), F.first("mad").alias("mad"), F.avg("z").alias("mean_z"),
                                   F.max(F.abs(F.col("back") - F.col("value"))).alias("back_error"))


# ---- a projection that both engines can compute: coefficients hashed from the feature names
def hashed_models(f):
    """Terms and heads for every day and hour; three in ten features get a coefficient."""
    names = f.select("feature").distinct()
    terms = rel.cross_join_expand(names, "hour", 24)
    u = num.uniform(F.col("feature"), F.col("hour"))
    terms = terms.where(u < 0.3).select("hour", "feature", ((u - 0.15) / 10).alias("coef"), F.lit(50.0).alias("x_median"), F.lit(30.0).alias("x_mad"))
    days = f.select("day").distinct()
    by_day = terms.groupBy("hour").agg(F.collect_list(F.struct("feature", "coef", "x_median", "x_mad")).alias("terms"))
    grid = rel.cross_join_expand(days, "hour", 24)
    heads = grid.select("day", "hour", ((num.uniform(F.lit("head"), F.col("hour")) - 0.5) / 10).alias("intercept"), F.lit(60.0).alias("y_median"), F.lit(25.0).alias("y_mad"))
    models = heads.join(by_day, "hour")
    return mo.model_terms(models, []), mo.model_heads(models, [])


U = lambda key: f"(('0x' || substr(md5({key}), 1, 13))::UBIGINT / pow(2, 52))"
MODELS = dict(
    days=DAYS, fm=FM,
    cf=f"""SELECT feature, hour, (u - 0.15) / 10 AS coef FROM (SELECT feature, k.hour, {U("concat_ws('|', feature, k.hour)")} AS u FROM (SELECT DISTINCT feature FROM fm), (SELECT unnest(range(0, 24)) AS hour) k) WHERE u < 0.3""",
    hd=f"""SELECT day, hour, ({U("concat_ws('|', 'head', hour)")} - 0.5) / 10 AS intercept FROM days, (SELECT unnest(range(0, 24)) AS hour)""",
    sc="""SELECT hd.day, hd.hour, any_value(hd.intercept) + coalesce(sum(cf.coef * asinh((coalesce(fm.value, 50.0) - 50.0) / 30.0)), 0) AS score FROM hd JOIN cf ON cf.hour = hd.hour
        LEFT JOIN fm ON fm.day = hd.day AND fm.feature = cf.feature GROUP BY 1, 2""",
)
LEVEL = lambda s: f"(sinh({s}) * 25.0 + 60.0)"


@query("predict_linear", sql(f"SELECT {d('day')} AS day, hour, {r(LEVEL('score'))} AS point FROM sc", "pf", **MODELS))
def predict_linear(spark, folder):
    f = features(spark, folder)
    return mo.predict_linear(f, *hashed_models(f), [])


def persistence(spark, folder, series):
    """Value at the forecast origin, held for 24 hours: (series, day, hour, value)."""
    days = profile(spark, folder).where(F.col("series").isin(*series)).select("series", "day").distinct()
    gate = ft.asof_gate_value(V.hourly(spark, folder).where(F.col("series").isin(*series)), ["series"], "ts", "value", days, TZ)
    return rel.cross_join_expand(gate.select("series", "day", "value"), "hour", 24)


GATE = f"""SELECT g.series, g.day, x.value FROM (SELECT DISTINCT series, day, timezone('UTC', timezone('{TZ}', day - INTERVAL 12 HOUR)) AS gate FROM pf WHERE series IN ('error', 'signup')) g
    ASOF LEFT JOIN (SELECT * FROM h WHERE value IS NOT NULL) x ON x.series = g.series AND x.ts <= g.gate"""


@query("driver_override", sql(f"""SELECT {d('fm.day')} AS day, feature, {r("CASE WHEN feature LIKE 'error_d_h%' THEN coalesce(gt.value, fm.value) ELSE fm.value END")} AS value FROM fm LEFT JOIN gt ON gt.day = fm.day AND gt.series = 'error'""", "pf", days=DAYS, fm=FM, gt=GATE))
def driver_override(spark, folder):
    return features(spark, folder, override=persistence(spark, folder, ["error"]))


BLOCK = 3
# the calibration cells of every refit day, recomputed: days of the window with a target row, names of all days sent to the block
FITTED = dict(
    days=DAYS, fm=FM,
    yy=f"SELECT day, hour, value FROM slots WHERE series = '{TARGET}'",
    rf=f"SELECT day AS refit, CAST(floor((day - DATE '1970-01-01') / {BLOCK}) AS BIGINT) AS blk FROM (SELECT DISTINCT day FROM yy) WHERE day - (SELECT min(day) FROM yy) >= {WINDOW}",
    td="SELECT DISTINCT yy.day FROM yy JOIN days ON days.day = yy.day",
    wd=f"SELECT rf.refit, td.day FROM rf JOIN td ON td.day < rf.refit AND td.day >= rf.refit - {WINDOW}",
    nm=f"""SELECT DISTINCT rf.refit, fm.feature FROM rf JOIN td ON td.day - DATE '1970-01-01' BETWEEN {BLOCK} * rf.blk - {WINDOW} AND {BLOCK} * rf.blk + {BLOCK - 2} JOIN fm ON fm.day = td.day""",
    cl="SELECT nm.refit, nm.feature, wd.day, fm.value FROM nm JOIN wd ON wd.refit = nm.refit LEFT JOIN fm ON fm.day = wd.day AND fm.feature = nm.feature",
    gp="""SELECT refit, count(DISTINCT feature) AS n_features, count(*) FILTER (WHERE value IS NULL AND day > known) AS n_ffill, count(*) FILTER (WHERE value IS NULL AND day < known) AS n_bfill
        FROM (SELECT *, min(CASE WHEN value IS NOT NULL THEN day END) OVER (PARTITION BY refit, feature) AS known FROM cl) GROUP BY 1""",
    ym="SELECT refit, hour, day, value, median(value) OVER (PARTITION BY refit, hour) AS med FROM wd JOIN yy USING (day)",
    ms="""SELECT ym.refit, ym.hour, coalesce(any_value(med), 0.0) AS y_median, coalesce(median(abs(value - med)), 1.0) AS y_mad, count(value) AS n_rows, any_value(n_features) AS n_features, any_value(n_ffill) AS n_ffill, any_value(n_bfill) AS n_bfill
        FROM ym JOIN gp ON gp.refit = ym.refit GROUP BY 1, 2""",
)


@query("fit_many_lasso", sql(f"""SELECT {d('refit')} AS refit_day, hour, {r('y_median')} AS y_median, {r('y_mad')} AS y_mad, n_features, n_rows, n_ffill, n_bfill, CAST(n_rows < 10 AS INTEGER) AS n_degenerate,
    0 AS n_failed, CAST(n_rows <= n_features + 1 AS INTEGER) AS ridge_variance, 1 AS certified FROM ms""", "pf", "slots", **FITTED))
def fit_many_lasso(spark, folder):
    return fitted(spark, folder).withColumn("certified", mo.certified()).select(
        "refit_day", "hour", "y_median", "y_mad", "n_features", "n_rows", "n_ffill", "n_bfill", "n_degenerate", "n_failed", "ridge_variance", "certified")


def fitted(spark, folder, f=None):
    f = features(spark, folder) if f is None else f
    p = ft.day_hour_profile(V.hourly(spark, folder).where(F.col("series") == TARGET), ["series"], "ts", "value", TZ)
    y = p.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("hour", "value"))).alias("c")).select("day", F.col("c.value").alias("y"))
    first = p.agg(F.min("day").alias("d")).select("d").scalar()
    refits = p.select("day").distinct().where(F.datediff("day", first) >= WINDOW)
    return mo.fit_many_lasso(ft.feature_vectors(f, []), y, refits, [], WINDOW, block_days=BLOCK)


@query("fit_and_predict", sql(f"""SELECT {d('refit')} AS day, hour, n_rows, 1 AS predicted, CASE WHEN n_rows >= 10 AND n_ffill + n_bfill = 0 THEN 0.0 END AS mean_residual FROM ms""", "pf", "slots", **FITTED))
def fit_and_predict(spark, folder):
    """Forecasts, and the mean scaled residual that the same projection leaves over the calibration days: none, as a lasso with intercept has none.

    A filled cell counts as the median in a projection, so windows with gaps are left out of that sum.
    """
    f = cut_lineage(features(spark, folder))
    models = cut_lineage(fitted(spark, folder, f).withColumnRenamed("refit_day", "day"))
    terms, heads = mo.model_terms(models, []), mo.model_heads(models, [])
    point = mo.predict_linear(f, terms, heads, [])
    days = models.where("n_ffill + n_bfill = 0 AND n_degenerate = 0").select("day").distinct()
    cells = ft.calibration_window(f, [], days, WINDOW).select(F.col("day").alias("sample"), F.col("delivery").alias("day"), "feature", "value")
    samples = cells.select("sample", "day").distinct()
    scores = mo.linear_scores(cells, terms.join(samples, "day"), heads.join(samples, "day"), ["sample"])
    y = ft.day_hour_profile(V.hourly(spark, folder).where(F.col("series") == TARGET), ["series"], "ts", "value", TZ).select(F.col("day").alias("sample"), "hour", "value")
    left = scores.join(y, ["sample", "hour"]).groupBy("day", "hour").agg(
        F.avg(num.robust_scale(F.col("value"), F.col("y_median"), F.col("y_mad")) - F.col("score")).alias("mean_residual"))
    return models.select("day", "hour", "n_rows", "n_degenerate").join(point, ["day", "hour"], "left").join(left, ["day", "hour"], "left").select(
        "day", "hour", "n_rows", num.is_finite(F.col("point")).alias("predicted"), F.when(F.col("n_degenerate") == 0, F.col("mean_residual")).alias("mean_residual"))


@query("model_diagnostics_rollup", sql("""SELECT count(DISTINCT refit) AS n_models, count(*) FILTER (WHERE n_rows < 10) AS n_degenerate_hours, 0 AS n_failed_hours, 0 AS n_runaway_hours,
    (SELECT sum(n_ffill) FROM gp WHERE day(refit) % 3 <> 1) AS n_ffill, (SELECT sum(n_bfill) FROM gp WHERE day(refit) % 3 <> 1) AS n_bfill, count(DISTINCT CASE WHEN n_rows <= n_features + 1 THEN refit END) AS n_ridge, 1 AS bounded
    FROM ms WHERE day(refit) % 3 <> 1""", "pf", "slots", **FITTED))
def model_diagnostics_rollup(spark, folder):
    """Over the models of two days in three, as a phase of an evaluation has them."""
    days = mo.day_diagnostics(fitted(spark, folder), [])
    phase = profile(spark, folder).select(F.col("day").alias("refit_day")).where(F.dayofmonth("refit_day") % 3 != 1)
    sums = ["n_degenerate_hours", "n_failed_hours", "n_runaway_hours", "n_ffill", "n_bfill", "n_ridge"]
    return mt.model_diagnostics_rollup(days, phase, ["refit_day"], sums, "max_abs_coef").withColumn("bounded", F.col("max_abs_coef") <= 1e3).drop("max_abs_coef")


# -------------------------------------------------- event-day conditions
def event_day_inputs(spark, folder):
    """Event-days inside the profile, with their driver's persistence path and a synthetic effect."""
    e = V.curated(spark, folder)
    days = profile(spark, folder).select("day").distinct()
    ed = cut_lineage(tl.event_days(e, "start", "end", TZ).join(F.broadcast(days), "day", "left_semi"))
    pers = mo.local_table(persistence(spark, folder, ["error", "signup"]).withColumnRenamed("series", "driver"))
    base = ed.select("event_id", "day", "driver").join(pers, ["driver", "day"])
    seed = F.floor(F.unix_seconds("start") / 3600)
    eff = ed.select(
        "event_id", "day", "driver", (F.col("kind") == "generation").alias("falls"), F.when(seed % 6 == 2, "none").otherwise("reduce").alias("direction"),
        ((seed % 10) / 10).alias("p_active"), (seed % 20).cast("double").alias("start_mean"), F.when(seed % 3 == 0, 0.0).otherwise(1.5).alias("start_sd"),
        (seed % 20 + 4).cast("double").alias("end_mean"), F.lit(2.0).alias("end_sd"), (F.col("reduction") * 0.5).alias("p10"), F.col("reduction").alias("p50"),
        (F.col("reduction") * F.when(seed % 5 == 0, 0.5).otherwise(1.5)).alias("p90"), F.col("reduction").alias("size"),
        ((F.unix_seconds("end") - F.unix_seconds("start")) / 3600).alias("width_hours"), (seed % 4 != 0).alias("documented"))
    # equal quantiles make the size a constant
    eff = eff.withColumn("p50", F.when(F.col("p90") == F.col("p10"), F.col("p10")).otherwise(F.col("p50")))
    return base, eff


EDAY = dict(
    gt=GATE,
    ed=f"""SELECT * FROM (SELECT *, CAST(epoch(start) / 3600 AS BIGINT) AS sd, unnest(generate_series(CAST(CAST({L('start')} AS DATE) AS TIMESTAMP), CAST(CAST({L('"end"')} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS day FROM e)
        WHERE day IN (SELECT day FROM days)""",
    bs="SELECT ed.event_id, ed.day, ed.driver, k.hour, gt.value FROM ed JOIN gt ON gt.series = ed.driver AND gt.day = ed.day, (SELECT unnest(range(0, 24)) AS hour) k",
    ef="""SELECT event_id, day, driver, kind = 'generation' AS falls, CASE WHEN sd % 6 = 2 THEN 'none' ELSE 'reduce' END AS direction, (sd % 10) / 10 AS p_active, sd % 20 AS sm, CASE WHEN sd % 3 = 0 THEN 0.0 ELSE 1.5 END AS ss,
        sd % 20 + 4 AS em, 2.0 AS es, reduction * 0.5 AS p10, CASE WHEN sd % 5 = 0 THEN reduction * 0.5 ELSE reduction END AS p50, reduction * CASE WHEN sd % 5 = 0 THEN 0.5 ELSE 1.5 END AS p90, reduction AS size,
        epoch("end" - start) / 3600 AS width, sd % 4 <> 0 AS documented FROM ed""",
)


def _n(a, c):
    return f"sqrt(-2.0 * ln(greatest({a}, 1e-300))) * cos(6.283185307179586 * {c})"


def _u(tag):
    return U(f"concat_ws('|', 42, event_id, {d('day')}, path, '{tag}')")


PATHS = dict(
    dr=f"""SELECT ef.*, k.path, {_u('active')} AS ua, {_u('size')} AS us, least(greatest(CASE WHEN ss = 0 THEN sm ELSE sm + ss * {_n(_u('s1'), _u('s2'))} END, 0), 24) AS x,
        least(greatest(em + es * {_n(_u('e1'), _u('e2'))}, 0), 24) AS y FROM ef, (SELECT unnest(range(0, 5)) AS path) k""",
    pt="""SELECT dr.event_id, dr.day, dr.path, bs.hour, dr.driver, bs.value + CASE WHEN direction <> 'none' AND ua <= p_active AND bs.hour >= floor(least(x, y)) AND bs.hour < ceil(greatest(x, y)) THEN
        CASE WHEN falls THEN -1 ELSE 1 END * CASE WHEN p10 = p90 THEN p10 WHEN us < (p50 - p10) / (p90 - p10) THEN p10 + sqrt(us * (p90 - p10) * (p50 - p10)) ELSE p90 - sqrt((1 - us) * (p90 - p10) * (p90 - p50)) END
        ELSE 0 END AS value FROM dr JOIN bs ON bs.event_id = dr.event_id AND bs.day = dr.day""",
)


@query("effect_to_paths", sql(f"SELECT event_id, {d('day')} AS day, path, hour, {r('value')} AS value FROM pt", "e", "pf", days=DAYS, **EDAY, **PATHS))
def effect_to_paths(spark, folder):
    base, eff = event_day_inputs(spark, folder)
    return mo.effect_to_paths(base.drop("driver"), eff, ["event_id", "day"], 5, 42)


def whatif(rows, keys, extra=""):
    """SQL of scores under an override table `rows (keys, day, driver, hour, value)`."""
    k = ", ".join(f"o.{x}" for x in keys)
    return f"""SELECT {k}, o.day, cf.hour, sum(cf.coef * (asinh((coalesce(o.value, fm.value, 50.0) - 50.0) / 30.0) - asinh((coalesce(fm.value, 50.0) - 50.0) / 30.0))) AS dl
        FROM {rows} o JOIN cf ON cf.feature = o.driver || '_d_h' || lpad(CAST(o.hour AS VARCHAR), 2, '0') LEFT JOIN fm ON fm.day = o.day AND fm.feature = cf.feature GROUP BY {k}, o.day, cf.hour"""


COND = dict(
    wb=whatif("bs", ["event_id"]), wp=whatif("pt", ["event_id", "path"]),
    ctx=f"""SELECT p.event_id, p.day, sc.hour, avg({LEVEL('sc.score + coalesce(wp.dl, 0)')}) AS point FROM (SELECT DISTINCT event_id, day, path FROM pt) p JOIN sc ON sc.day = p.day
        LEFT JOIN wp ON wp.event_id = p.event_id AND wp.day = p.day AND wp.path = p.path AND wp.hour = sc.hour GROUP BY 1, 2, 3""",
    cn=f"""SELECT ef.event_id, ef.day, sc.hour, {LEVEL('sc.score + coalesce(wb.dl, 0)')} AS base, {LEVEL('sc.score')} AS oracle, CASE WHEN documented THEN coalesce(ctx.point, {LEVEL('sc.score + coalesce(wb.dl, 0)')}) ELSE {LEVEL('sc.score + coalesce(wb.dl, 0)')} END AS context
        FROM ef JOIN sc ON sc.day = ef.day LEFT JOIN wb ON wb.event_id = ef.event_id AND wb.day = ef.day AND wb.hour = sc.hour LEFT JOIN ctx ON ctx.event_id = ef.event_id AND ctx.day = ef.day AND ctx.hour = sc.hour""",
)
FULL = {**MODELS, **EDAY, **PATHS, **COND}
K = ["event_id", "day"]


def scenario_setup(spark, folder):
    # read many times below, so written once
    f = cut_lineage(features(spark, folder))
    terms, heads = hashed_models(f)
    terms = cut_lineage(terms)
    base, eff = event_day_inputs(spark, folder)
    drv = eff.select("event_id", "day", "driver", "documented")
    return f, terms, cut_lineage(mo.linear_scores(f, terms, heads, [])), base, eff, drv


def with_conditions(f, terms, scores, base, eff, drv):
    moved = mo.path_scores(scores, base.drop("driver"), eff, drv.withColumnRenamed("driver", "series"), f, terms, K, 5, 42, along=["documented"])
    return mo.path_conditions(moved, 5, F.col("documented"), K)


@query("conditions_union", sql(f"""SELECT event_id, {d('day')} AS day, hour, unnest(['no_context', 'context', 'oracle']) AS condition, unnest([{r('base')}, {r('context')}, {r('oracle')}]) AS point FROM cn""", "e", "pf", **FULL))
def conditions_union(spark, folder):
    return with_conditions(*scenario_setup(spark, folder))


DRAWS = 200
RB = dict(
    bp="""SELECT ef.event_id, ef.day, ef.driver, s.start_hour, bs.hour, bs.value + CASE WHEN (bs.hour - s.start_hour + 24) % 24 < least(greatest(ceil(width), 1), 24) THEN CASE WHEN falls THEN -size ELSE size END ELSE 0 END AS value
        FROM ef JOIN bs ON bs.event_id = ef.event_id AND bs.day = ef.day, (SELECT unnest(range(0, 24)) AS start_hour) s""",
    wr=whatif("bp", ["event_id", "start_hour"]),
    pl=f"""SELECT p.event_id, p.day, p.start_hour, sc.hour, {LEVEL('sc.score + coalesce(wr.dl, 0)')} AS point FROM (SELECT DISTINCT event_id, day, start_hour FROM bp) p JOIN sc ON sc.day = p.day
        LEFT JOIN wr ON wr.event_id = p.event_id AND wr.day = p.day AND wr.start_hour = p.start_hour AND wr.hour = sc.hour""",
    tr=f"SELECT cn.*, s.value AS y FROM cn JOIN slots s ON s.series = '{TARGET}' AND s.day = cn.day AND s.hour = cn.hour WHERE s.value IS NOT NULL",
    pk=f"""SELECT event_id, day, draw, CAST(floor({U(f"concat_ws('|', 7, event_id, {d('day')}, draw)")} * 24) AS INTEGER) AS start_hour FROM (SELECT DISTINCT event_id, day FROM ef), (SELECT unnest(range(0, {DRAWS})) AS draw)""",
    wt="SELECT event_id, day, start_hour, count(*) AS w FROM pk GROUP BY 1, 2, 3",
    ps="SELECT wt.event_id, wt.day, wt.start_hour, w, avg(abs(pl.point - tr.y)) AS mae FROM wt JOIN pl USING (event_id, day, start_hour) JOIN tr USING (event_id, day, hour) GROUP BY 1, 2, 3, 4",
    ow="SELECT event_id, day, count(*) AS n_hours, avg(abs(base - y)) AS baseline_mae, avg(abs(context - y)) AS context_mae, max(abs(context - base)) AS max_context_shift FROM tr GROUP BY 1, 2",
    me=f"SELECT event_id, day, avg(abs(m - y)) AS random_mean_mae FROM (SELECT wt.event_id, wt.day, tr.hour, tr.y, sum(pl.point * w) / {DRAWS} AS m FROM wt JOIN pl USING (event_id, day, start_hour) JOIN tr USING (event_id, day, hour) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2",
    sp="""SELECT pk.event_id, pk.day, avg(mae) AS random_single_mean, quantile_cont(mae, 0.05) AS random_p05, quantile_cont(mae, 0.5) AS random_p50, quantile_cont(mae, 0.95) AS random_p95,
        avg(CAST(mae < context_mae AS INTEGER)) AS p_random_beats_context FROM pk JOIN ps USING (event_id, day, start_hour) JOIN ow USING (event_id, day) GROUP BY 1, 2""",
)


@query("random_block_control", sql(f"""SELECT event_id, {d('day')} AS day, n_hours, {', '.join(f'{r(c)} AS {c}' for c in ('baseline_mae', 'context_mae', 'max_context_shift', 'random_mean_mae', 'random_single_mean', 'random_p05', 'random_p50', 'random_p95', 'p_random_beats_context'))}
    FROM ow LEFT JOIN me USING (event_id, day) LEFT JOIN sp USING (event_id, day)""", "e", "pf", "slots", **FULL, **RB))
def random_block_control(spark, folder):
    f, terms, scores, base, eff, drv = scenario_setup(spark, folder)
    cond = with_conditions(f, terms, scores, base, eff, drv)
    wide = cond.groupBy("event_id", "day", "hour").pivot("condition", ["no_context", "context"]).agg(F.min("point")).withColumnRenamed("no_context", "baseline")
    y = ft.day_hour_profile(V.hourly(spark, folder).where(F.col("series") == TARGET), ["series"], "ts", "value", TZ).select("day", "hour", F.col("value").alias("y"))
    placed = mo.block_scores(scores, base.drop("driver"), eff, drv.withColumnRenamed("driver", "series"), f, terms, K)
    points = mo.block_points(placed, K)
    return mo.random_block_control(points, wide.join(y, ["day", "hour"]), K, DRAWS, 7)
