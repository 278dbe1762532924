"""The event-hour panel and its diagnostics."""

from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import audit as au
from hourloom.operators import features as ft
from hourloom.operators import inference as inf
from hourloom.operators import metrics as mt
from hourloom.operators import models as mo
from hourloom.operators import relations as rel
from hourloom.operators import timeline as tl
from hourloom.session import cut_lineage
from testbed import views as V
from testbed.bindings import modelling as M
from testbed.registry import b, d, query, r, t
from testbed.views import TARGET, TZ, sql

L = V.LOCAL.format


# ---------------------------------------------------------------- Spark side
def drivers(spark, folder):
    """Realised driver profiles (driver, day, hour, value) from the filled hourly table."""
    f = V.filled(spark, folder).where(F.col("series").isin("error", "signup"))
    return tl.actuals_local_key(f, ["series"], "ts", TZ, ["value"]).withColumnRenamed("series", "driver")


def gates(spark, folder, events):
    days = tl.event_days(events, "start", "end", TZ).select(F.col("driver").alias("series"), "day").distinct()
    return ft.asof_gate_value(V.hourly(spark, folder), ["series"], "ts", "value", days, TZ).select(F.col("series").alias("driver"), "day", "value")


def forecast_inputs(spark, folder):
    """Features with both drivers as known at the origin, and the models of the days on which the target has at least the mean number of hours."""
    known = cut_lineage(M.features(spark, folder, override=M.persistence(spark, folder, ["error", "signup"])))
    terms, heads = M.hashed_models(known)
    target = ft.day_hour_profile(V.hourly(spark, folder).where(F.col("series") == TARGET), ["series"], "ts", "value", TZ)
    hours = target.groupBy("day").agg(F.count("value").alias("n"))
    whole = hours.where(F.col("n") >= hours.agg(F.avg("n").alias("n")).select("n").scalar()).select("day")
    return known, cut_lineage(terms), heads.join(whole, "day", "left_semi"), target


def parts(spark, folder):
    """Events, realised drivers, gates, actuals with the stored forecast, and the forecasts of all scenarios.

    The stored forecast is that of `predict_linear`, off by 0.01 on every fifth day of a month.
    """
    e = cut_lineage(V.curated(spark, folder))  # read many times below, so written once
    drv, gate = drivers(spark, folder), gates(spark, folder, e)
    known, terms, heads, target = forecast_inputs(spark, folder)
    record = mo.predict_linear(known, terms, heads, []).select(
        "day", "hour", (F.col("point") + F.when(F.dayofmonth("day") % 5 == 0, 0.01).otherwise(0.0)).alias("stored"))
    actual = target.select("day", "hour", F.col("value").alias("y")).join(record, ["day", "hour"], "left")
    fc = au.scenario_forecasts(tl.event_days(e, "start", "end", TZ), drv, gate, known, terms, heads)
    return e, drv, gate, actual, cut_lineage(fc)


def panel(spark, folder):
    return au.event_hour_panel(*parts(spark, folder), TZ)


def sensitive(spark, folder):
    e, drv, gate, actual, fc = parts(spark, folder)
    return au.with_sensitivity(au.event_hour_panel(e, drv, gate, actual, fc, TZ), fc)


# ------------------------------------------------------------------ SQL side
P = dict(
    ed=f"""SELECT *, unnest(generate_series(CAST(CAST({L('start')} AS DATE) AS TIMESTAMP), CAST(CAST({L('"end"')} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS day FROM e""",
    eh=f"""SELECT ed.*, hour, timezone('UTC', timezone('{TZ}', day + CAST(hour AS INTEGER) * INTERVAL 1 HOUR)) AS h0 FROM ed, (SELECT unnest(range(0, 24)) AS hour)""",
    gt=f"""SELECT g.driver, g.day, x.value FROM (SELECT driver, day, timezone('UTC', timezone('{TZ}', day - INTERVAL 12 HOUR)) AS gate FROM (SELECT DISTINCT driver, day FROM ed)) g
        ASOF LEFT JOIN (SELECT * FROM h WHERE value IS NOT NULL) x ON x.series = g.driver AND x.ts <= g.gate""",
    md=f"SELECT day FROM (SELECT day, count(value) AS n FROM slots WHERE series = '{TARGET}' GROUP BY day) QUALIFY n >= avg(n) OVER ()",
    days=M.DAYS, fm=M.FM, gk=M.GATE,
    kn="""SELECT fm.day, feature, CASE WHEN feature LIKE 'error_d_h%' THEN coalesce(a.value, fm.value) WHEN feature LIKE 'signup_d_h%' THEN coalesce(b.value, fm.value) ELSE fm.value END AS value
        FROM fm LEFT JOIN gk a ON a.day = fm.day AND a.series = 'error' LEFT JOIN gk b ON b.day = fm.day AND b.series = 'signup'""",
    cf=M.MODELS["cf"], hd=M.MODELS["hd"] + " WHERE day IN (SELECT day FROM md)", sc=M.MODELS["sc"].replace("fm", "kn"),
    dk="SELECT DISTINCT driver, kind, day FROM ed WHERE day IN (SELECT day FROM md)",
    ov="""SELECT 'oracle' AS scenario, dk.driver, dk.kind, dk.day, pf.hour, pf.value FROM dk JOIN pf ON pf.series = dk.driver AND pf.day = dk.day
        UNION ALL SELECT 'perturbed', dk.driver, dk.kind, dk.day, k.hour, gt.value + CASE WHEN dk.kind = 'generation' THEN -100.0 ELSE 100.0 END
        FROM dk LEFT JOIN gt ON gt.driver = dk.driver AND gt.day = dk.day, (SELECT unnest(range(0, 24)) AS hour) k""",
    wi=M.whatif("ov", ["scenario", "driver", "kind"]).replace("fm", "kn"),
    fc=f"""SELECT dk.driver, dk.kind, dk.day, sc.hour, {M.LEVEL('sc.score')} AS baseline, {M.LEVEL('sc.score + coalesce(a.dl, 0)')} AS oracle, {M.LEVEL('sc.score + coalesce(b.dl, 0)')} AS perturbed FROM dk JOIN sc ON sc.day = dk.day
        LEFT JOIN wi a ON a.scenario = 'oracle' AND a.driver = dk.driver AND a.kind = dk.kind AND a.day = dk.day AND a.hour = sc.hour
        LEFT JOIN wi b ON b.scenario = 'perturbed' AND b.driver = dk.driver AND b.kind = dk.kind AND b.day = dk.day AND b.hour = sc.hour""",
    pn=f"""SELECT eh.*, greatest(epoch(least(h0 + INTERVAL 1 HOUR, eh."end") - greatest(h0, eh.start)) / 3600.0, 0) AS overlap_hours,
        dr.value AS driver_realised, gt.value AS driver_persistence, dr.value - gt.value AS driver_delta, y.value AS y,
        CASE WHEN y.day IS NOT NULL THEN fc.baseline + CASE WHEN day(eh.day) % 5 = 0 THEN 0.01 ELSE 0.0 END END AS stored, fc.baseline, fc.oracle, fc.perturbed
        FROM eh JOIN md ON md.day = eh.day LEFT JOIN pf dr ON dr.series = eh.driver AND dr.day = eh.day AND dr.hour = eh.hour LEFT JOIN gt ON gt.driver = eh.driver AND gt.day = eh.day
        LEFT JOIN slots y ON y.series = '{TARGET}' AND y.day = eh.day AND y.hour = eh.hour LEFT JOIN fc ON fc.driver = eh.driver AND fc.kind = eh.kind AND fc.day = eh.day AND fc.hour = eh.hour""",
    ps="""SELECT *, oracle - baseline AS price_delta, perturbed - baseline AS sens, overlap_hours > 0 AS affected, coalesce(abs(driver_delta) > 1e-10, false) AS differs,
        coalesce(abs(perturbed - baseline) >= 0.10, false) AS high, abs(baseline - y) AS be, abs(oracle - y) AS oe FROM pn""",
)
BASE = ("e", "pf", "slots")
KIND = """SELECT 'generation_affected' AS stratum, * FROM ps WHERE affected AND kind = 'generation'
    UNION ALL SELECT 'generation_affected_driver_differs', * FROM ps WHERE affected AND kind = 'generation' AND differs
    UNION ALL SELECT 'generation_affected_driver_differs_high_sensitivity', * FROM ps WHERE affected AND kind = 'generation' AND differs AND high
    UNION ALL SELECT 'transmission_affected', * FROM ps WHERE affected AND kind = 'transmission'
    UNION ALL SELECT 'transmission_affected_driver_differs', * FROM ps WHERE affected AND kind = 'transmission' AND differs
    UNION ALL SELECT 'all_affected', * FROM ps WHERE affected"""


@query("event_hour_panel", sql(f"""SELECT event_id, kind, driver, reduction, {t('start')} AS start, {t('"end"')} AS "end", {d('day')} AS day, hour, {t('h0')} AS hour_start, {r('overlap_hours')} AS overlap_hours,
    {b('overlap_hours > 0')} AS affected, {r('driver_realised')} AS driver_realised, {r('driver_persistence')} AS driver_persistence, {r('y')} AS y, {r('stored')} AS stored, {r('baseline')} AS baseline,
    {r('oracle')} AS oracle, {r('driver_delta')} AS driver_delta, {r('price_delta')} AS price_delta FROM ps""", *BASE, **P))
def event_hour_panel(spark, folder):
    return panel(spark, folder)


# Faults put into the audited inputs, so that every check has something to find: gates of every seventh day (day of month 3, 10, 17, 24, 31) one too high,
# hour 5 of the realised "signup" two too high on days of month 4, 8, 12 and so on, "error_d_h07" unknown on days of month 6, 12, 18 and so on,
# and the reductions that are divisible by 5 put in with the wrong sign. A wrong gate also shifts the size of what was put in.
_FAULT = dict(
    gate="dayofmonth(day) % 7 = 3", profile="driver = 'signup' AND hour = 5 AND dayofmonth(day) % 4 = 0",
    feature="feature = 'error_d_h07' AND dayofmonth(day) % 6 = 0", sign="CAST(reduction AS BIGINT) % 5 = 0",
)
_AUDIT = dict(
    dd="""SELECT ed.event_id, ed.kind, ed.driver, ed.day, ed.reduction, md.day IS NOT NULL AS cov, coalesce(dayofmonth(ed.day) % 7 = 3 AND gt.value IS NOT NULL, false) AS bad_gate,
        ed.driver = 'signup' AND dayofmonth(ed.day) % 4 = 0 AND pr.value IS NOT NULL AS bad_profile, ed.driver = 'error' AND dayofmonth(ed.day) % 6 = 0 AS bad_feature,
        coalesce((CAST(reduction AS BIGINT) % 5 = 0 OR dayofmonth(ed.day) % 7 = 3) AND gt.value IS NOT NULL, false) AS bad_sign
        FROM ed LEFT JOIN md ON md.day = ed.day LEFT JOIN gt ON gt.driver = ed.driver AND gt.day = ed.day LEFT JOIN pf pr ON pr.series = ed.driver AND pr.day = ed.day AND pr.hour = 5""",
    ck="""SELECT 'model_coverage' AS "check", event_id, day, cov AS ok, 'no model for this day' AS detail FROM dd
        UNION ALL SELECT 'feature_wiring', event_id, day, NOT bad_feature, 'missing features: error_d_h07' FROM dd WHERE cov
        UNION ALL SELECT 'baseline_persistence', event_id, day, NOT bad_gate, 'baseline driver differs from the value known at the forecast origin' FROM dd WHERE cov
        UNION ALL SELECT 'oracle_path', event_id, day, NOT bad_profile, 'oracle driver differs from the realised profile' FROM dd WHERE cov
        UNION ALL SELECT kind || '_sign', event_id, day, NOT bad_sign, 'driver injection has wrong sign or size' FROM dd WHERE cov
        UNION ALL SELECT 'event_interval_alignment', event_id, day, true, '' FROM dd, range(24) WHERE cov""",
)


def audited(spark, folder):
    """The panel with faults, against the same gate values, profiles and paths by other routes."""
    e, drv, gate, actual, fc = parts(spark, folder)
    days = tl.event_days(e, "start", "end", TZ)
    # the filled table at the gate's hour, its last value after its end; and the table's 24-slot profile
    hours = V.filled(spark, folder).select(F.col("series").alias("driver"), F.col("ts").alias("gate"), F.col("value").alias("gate_expected"))
    last = hours.groupBy("driver").agg(F.max_by("gate_expected", "gate").alias("final"), F.max("gate").alias("final_at"))
    asked = days.select("driver", "day").distinct().withColumn("gate", cal.gate_time(F.col("day"), TZ))
    expected_gate = asked.join(hours, ["driver", "gate"], "left").join(last, "driver").select(
        "driver", "day", F.when(F.col("gate") > F.col("final_at"), F.col("final")).otherwise(F.col("gate_expected")).alias("gate_expected"))
    slots = ft.day_hour_profile(V.filled(spark, folder), ["series"], "ts", "value", TZ)
    expected_profile = slots.select(F.col("series").alias("driver"), "day", "hour", F.col("value").alias("profile_expected"))
    names = M.features(spark, folder).select("day", "feature").where(f"NOT ({_FAULT['feature']})")
    # a path hangs on the driver, the day and what was declared: events that share them share the path, so paths grow with the calendar
    path = ["driver", "day", "falls", "size"]
    put_in = days.withColumns({"falls": (F.col("kind") == "generation") != F.expr(_FAULT["sign"]), "size": F.col("reduction")})
    declared = put_in.select(*path, F.lit(24.0).alias("width_hours")).distinct()
    base = rel.cross_join_expand(declared.join(expected_gate, ["driver", "day"]).select(*path, F.col("gate_expected").alias("value")), "hour", 24)
    paths = mo.block_paths(base, declared, path).where("start_hour = 0").select(*path, "hour", "value")
    injected = put_in.join(mo.local_table(paths), path).select("event_id", "day", "hour", "value")
    faulty = au.event_hour_panel(
        e, drv.withColumn("value", F.col("value") + F.when(F.expr(_FAULT["profile"]), 2.0).otherwise(0.0)),
        gate.withColumn("value", F.col("value") + F.when(F.expr(_FAULT["gate"]), 1.0).otherwise(0.0)), actual, fc, TZ)
    return au.audit_results(days, faulty, expected_gate, expected_profile, names, injected)


@query("audit_invariants", sql("""SELECT "check", count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM ck GROUP BY 1""", *BASE, **P, **_AUDIT))
def audit_invariants(spark, folder):
    return au.audit_invariants(audited(spark, folder))


@query("audit_failures", sql(f"""SELECT "check", event_id, {d('day')} AS day, CAST(NULL AS INTEGER) AS hour, detail FROM ck WHERE NOT ok""", *BASE, **P, **_AUDIT))
def audit_failures(spark, folder):
    return au.audit_failures(audited(spark, folder))


@query("panel_summary", sql(f"""SELECT count(DISTINCT event_id) AS n_events, count(DISTINCT (event_id, day)) AS n_event_days, count(*) AS n_event_hours, count(*) FILTER (WHERE affected) AS n_affected,
    count(*) FILTER (WHERE y IS NULL) AS n_nonfinite_actual, count(stored) AS n_comparable, count(*) FILTER (WHERE stored IS NOT NULL AND day(day) % 5 = 0) AS n_differs, {r('max(abs(stored - baseline))')} AS max_abs_diff FROM ps""", *BASE, **P))
def panel_summary(spark, folder):
    return au.panel_summary(panel(spark, folder))


@query("missing_partner_report", sql(f"""SELECT 'model_coverage' AS "check", event_id, {d('day')} AS day, 'no model for this day' AS detail FROM ed
    WHERE ed.day NOT IN (SELECT day FROM slots WHERE series = '{TARGET}' GROUP BY day HAVING count(value) = 24)""", *BASE, **P))
def missing_partner_report(spark, folder):
    days = tl.event_days(V.curated(spark, folder), "start", "end", TZ).select("event_id", "day")
    models = ft.day_hour_profile(V.hourly(spark, folder).where(F.col("series") == TARGET), ["series"], "ts", "value", TZ)
    models = models.groupBy("day").agg(F.count("value").alias("n")).where("n = 24").select("day")  # a model needs all hours
    return rel.missing_partner_report(days, models, ["day"], "model_coverage", "no model for this day")


_MN = dict(
    ak="SELECT DISTINCT driver, day FROM ed",
    mn="""SELECT ak.driver, ak.day, s.hour, median(s.value) AS normal FROM ak, slots s WHERE s.series = ak.driver AND s.value IS NOT NULL AND s.day IN (ak.day - 7, ak.day - 14, ak.day - 21, ak.day - 28)
        AND s.day NOT IN (SELECT day FROM busy) GROUP BY 1, 2, 3""",
    mc="""SELECT ak.driver, ak.day, count(DISTINCT s.day) AS n_controls FROM ak, slots s WHERE s.series = ak.driver AND s.value IS NOT NULL AND s.day IN (ak.day - 7, ak.day - 14, ak.day - 21, ak.day - 28)
        AND s.day NOT IN (SELECT day FROM busy) GROUP BY 1, 2""",
)
_BUSY = "SELECT DISTINCT day FROM ak"


def normal_days(spark, folder):
    """Every day of every event, with its driver."""
    days = tl.event_days(V.curated(spark, folder), "start", "end", TZ)
    return days.select(F.col("driver").alias("series"), "day").distinct()


@query("matched_normal_profile", sql(f"""SELECT ak.driver AS series, {d('ak.day')} AS day, k.hour, {r('mn.normal')} AS normal, coalesce(mc.n_controls, 0) AS n_controls FROM ak CROSS JOIN (SELECT unnest(range(0, 24)) AS hour) k
    LEFT JOIN mn ON mn.driver = ak.driver AND mn.day = ak.day AND mn.hour = k.hour LEFT JOIN mc ON mc.driver = ak.driver AND mc.day = ak.day""",
    *BASE, ed=P["ed"], ak=_MN["ak"], busy=_BUSY, mn=_MN["mn"], mc=_MN["mc"]))
def matched_normal_profile(spark, folder):
    p = ft.day_hour_profile(V.hourly(spark, folder), ["series"], "ts", "value", TZ)
    return au.matched_normal_profile(p, normal_days(spark, folder), ["series"], "value")


@query("absorption", sql(f"""SELECT event_id, {d('day')} AS day, kind, driver, reduction, n_control_days, n_valid, {r('mvn')} AS median_vs_normal, {r('mvp')} AS median_vs_persistence, {r('svn')} AS share_vs_normal,
    {r('svp')} AS share_vs_persistence, {r('mvn / reduction')} AS visible_share_of_declared, CASE WHEN n_valid = 0 THEN 'no_valid_affected_hours'
    WHEN svn >= 0.75 AND mvn >= 0.1 * reduction THEN 'visible_vs_normal' ELSE 'weak_or_not_visible_vs_normal' END AS classification FROM (
    SELECT event_id, day, kind, driver, reduction, max(n_controls) AS n_control_days, count(*) FILTER (WHERE ok) AS n_valid, median(vn) AS mvn, median(vp) AS mvp,
      avg(CAST(vn > 0 AS INTEGER)) AS svn, avg(CASE WHEN ok THEN coalesce(CAST(vp > 0 AS INTEGER), 0) END) AS svp FROM (
      SELECT *, CASE WHEN ok THEN sg * (driver_realised - normal) END AS vn, CASE WHEN ok THEN sg * (driver_realised - driver_persistence) END AS vp FROM (
        SELECT ps.*, mn.normal, CASE WHEN mk.driver IS NOT NULL THEN coalesce(mc.n_controls, 0) END AS n_controls, CASE WHEN kind = 'generation' THEN -1.0 ELSE 1.0 END AS sg,
          affected AND driver_realised IS NOT NULL AND mn.normal IS NOT NULL AS ok FROM ps LEFT JOIN ak mk ON mk.driver = ps.driver AND mk.day = ps.day
          LEFT JOIN mn ON mn.driver = mk.driver AND mn.day = mk.day AND mn.hour = ps.hour LEFT JOIN mc ON mc.driver = mk.driver AND mc.day = mk.day)) GROUP BY 1, 2, 3, 4, 5)""",
    *BASE, **P, ak=_MN["ak"], busy=_BUSY, mn=_MN["mn"], mc=_MN["mc"]))
def absorption(spark, folder):
    p = ft.day_hour_profile(V.hourly(spark, folder), ["series"], "ts", "value", TZ)
    normal = au.matched_normal_profile(p, normal_days(spark, folder), ["series"], "value").withColumnRenamed("series", "driver")
    return au.absorption(panel(spark, folder), normal)


@query("sensitivity_100mw", sql(f"""SELECT stratum, count(*) AS n_hours, {r('median(sens)')} AS median_change, {r('avg(sens)')} AS mean_change, {r('avg(CAST(sens > 0 AS INTEGER))')} AS share_positive,
    {r('avg(CAST(high AS INTEGER))')} AS share_high FROM (SELECT 'all' AS stratum, * FROM ps UNION ALL SELECT 'affected', * FROM ps WHERE affected) WHERE sens IS NOT NULL GROUP BY 1""", *BASE, **P))
def sensitivity_100mw(spark, folder):
    return au.sensitivity_summary(sensitive(spark, folder))


_NEST = """SELECT 'all_scored_event_hours' AS stratum, * FROM ps UNION ALL SELECT 'realised_affected_hours', * FROM ps WHERE affected
    UNION ALL SELECT 'affected_hours_driver_differs', * FROM ps WHERE affected AND differs UNION ALL SELECT 'affected_high_sensitivity_hours', * FROM ps WHERE affected AND high
    UNION ALL SELECT 'affected_driver_differs_and_high_sensitivity', * FROM ps WHERE affected AND differs AND high"""


@query("masked_scores", sql(f"""SELECT stratum, count(*) AS n_obs, {r('avg(be)')} AS mae_baseline, {r('avg(oe)')} AS mae_oracle, {r('avg(oe) - avg(be)')} AS oracle_minus_baseline, count(*) FILTER (WHERE oe < be) AS oracle_better,
    count(*) FILTER (WHERE be < oe) AS baseline_better, count(*) FILTER (WHERE be = oe) AS ties FROM st WHERE y IS NOT NULL GROUP BY 1""", *BASE, **P, st=_NEST))
def masked_scores(spark, folder):
    return au.masked_scores(sensitive(spark, folder))


@query("oracle_ceiling", sql(f"""SELECT stratum, count(DISTINCT event_id) AS n_events, count(*) AS n_hours, {r('avg(be)')} AS baseline_mae, {r('avg(oe)')} AS oracle_mae, {r('avg(be - oe)')} AS gain, {r('100 * avg(be - oe) / avg(be)')} AS gain_pct,
    count(*) FILTER (WHERE be - oe > 0) AS wins, count(*) FILTER (WHERE be - oe < 0) AS loses, count(*) FILTER (WHERE be - oe = 0) AS ties, {r('avg(CAST(be - oe > 0 AS INTEGER))')} AS win_rate,
    {r('avg(abs(price_delta))')} AS mean_shift, {r('max(abs(price_delta))')} AS max_shift, {r('median(abs(price_delta))')} AS median_shift, {r('quantile_cont(abs(price_delta), 0.95)')} AS p95_shift,
    {r('avg(be - oe) FILTER (WHERE be > oe)')} AS mean_gain_won, {r('median(be - oe) FILTER (WHERE be > oe)')} AS median_gain_won
    FROM st WHERE y IS NOT NULL AND baseline IS NOT NULL AND oracle IS NOT NULL AND stratum LIKE 'generation%' GROUP BY 1""", *BASE, **P, st=KIND))
def oracle_ceiling(spark, folder):
    return au.oracle_ceiling(sensitive(spark, folder))


_DEC = """SELECT event_id, day, kind, driver, count(y) AS n_scored, count(*) FILTER (WHERE hit) AS n_affected, avg(be) FILTER (WHERE y IS NOT NULL) AS baseline_mae_all, avg(oe) FILTER (WHERE y IS NOT NULL) AS oracle_mae_all,
    avg(oe - be) FILTER (WHERE y IS NOT NULL) AS delta_all, avg(be) FILTER (WHERE hit) AS baseline_mae, avg(oe) FILTER (WHERE hit) AS oracle_mae, avg(oe - be) FILTER (WHERE hit) AS delta,
    avg(y - baseline) FILTER (WHERE hit) AS residual, avg(price_delta) FILTER (WHERE hit) AS shift, avg(coalesce(CAST(sens > 0 AS INTEGER), 0)) FILTER (WHERE hit) AS share_positive,
    median(abs(sens)) FILTER (WHERE hit) AS median_sensitivity, avg(vv) FILTER (WHERE hit) AS mean_view, avg(cc) FILTER (WHERE hit) AS mean_click
    FROM (SELECT ps.*, y IS NOT NULL AND affected AS hit, v.value AS vv, c.value AS cc FROM ps LEFT JOIN slots v ON v.series = 'view' AND v.day = ps.day AND v.hour = ps.hour
      LEFT JOIN slots c ON c.series = 'click' AND c.day = ps.day AND c.hour = ps.hour) GROUP BY 1, 2, 3, 4"""
_DCOLS = ["baseline_mae_all", "oracle_mae_all", "delta_all", "baseline_mae", "oracle_mae", "delta", "residual", "shift", "share_positive", "median_sensitivity", "mean_view", "mean_click"]
_RCOLS = ["baseline_mae", "oracle_mae", "delta", "residual", "shift", "share_positive", "median_sensitivity"]


def decomposed(spark, folder):
    p = ft.day_hour_profile(V.hourly(spark, folder), ["series"], "ts", "value", TZ).where(F.col("series").isin("view", "click"))
    context = mt.pivot_condition(p, ["day", "hour"], "series", "value", ["view", "click"])
    return au.decompose_event_day(sensitive(spark, folder), context, ["view", "click"])


@query("decompose_event_day", sql(f"""SELECT event_id, {d('day')} AS day, kind, driver, n_scored, n_affected, {', '.join(f'{r(c)} AS {c}' for c in _DCOLS)} FROM dec""", *BASE, **P, dec=_DEC))
def decompose_event_day(spark, folder):
    return decomposed(spark, folder)


@query("decompose_by_kind", sql(f"""SELECT kind, driver, count(*) AS n_event_days, sum(n_affected) AS n_affected, {', '.join(f'{r(f"avg({c})")} AS {c}' for c in _RCOLS)} FROM dec GROUP BY 1, 2""", *BASE, **P, dec=_DEC))
def decompose_by_kind(spark, folder):
    return au.decompose_rollup(decomposed(spark, folder), ["kind", "driver"])


DRAWS = 10_000
_BB = dict(
    st=KIND,
    pe="""SELECT stratum, event_id, avg(oe) - avg(be) AS diff, row_number() OVER (PARTITION BY stratum ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS n
        FROM st WHERE y IS NOT NULL AND baseline IS NOT NULL AND oracle IS NOT NULL GROUP BY 1, 2""",
    pk=f"""SELECT a.stratum, k.draw, CAST(floor(('0x' || substr(md5(concat_ws('|', 20260914, k.draw, a.i)), 1, 13))::UBIGINT / pow(2, 52) * a.n) AS BIGINT) AS i
        FROM pe a, (SELECT unnest(range(0, {DRAWS})) AS draw) k""",
    dr="SELECT pk.stratum, pk.draw, avg(z.diff) AS m FROM pk JOIN pe z ON z.stratum = pk.stratum AND z.i = pk.i GROUP BY 1, 2",
)


@query("block_bootstrap", sql(f"""SELECT p.stratum, p.n_events, {r('p.estimate')} AS estimate, {r('quantile_cont(m, 0.025)')} AS ci_low, {r('quantile_cont(m, 0.975)')} AS ci_high, {r('avg(CAST(m < 0 AS INTEGER))')} AS p_below_zero
    FROM dr JOIN (SELECT stratum, count(*) AS n_events, avg(diff) AS estimate FROM pe GROUP BY 1) p ON p.stratum = dr.stratum GROUP BY 1, 2, p.estimate""", *BASE, **P, **_BB))
def block_bootstrap(spark, folder):
    rows = mt.explode_strata(sensitive(spark, folder), au.kind_masks())
    per_event = inf.event_differences(rows, ["stratum"], "event_id", "y", "oracle", "baseline")
    return inf.block_bootstrap(per_event, ["stratum"], "event_id", "diff", draws=DRAWS)
