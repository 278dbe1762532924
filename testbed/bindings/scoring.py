"""Profiles, lags, walk-forward rows and scores."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourloom.operators import features as ft
from hourloom.operators import forecast as fc
from hourloom.operators import inference as inf
from hourloom.operators import intervals as iv
from hourloom.operators import metrics as mt
from hourloom.operators import relations as rel
from hourloom.operators import running
from hourloom.operators import timeline as tl
from hourloom.functions import numeric as num
from hourloom.session import cut_lineage
from hourloom.sources import sinks as sk
from hourloom.streaming import quantiles as sq
from testbed import views as V
from testbed.registry import b, d, query, r, t
from testbed.views import TZ, sql

S = ["series"]
L = V.LOCAL.format
LAST, BURN = 10, 5
TAUS = "[" + ", ".join(str(x) for x in num.QUANTILE_GRID) + "]"


def profile(spark, folder):
    return ft.day_hour_profile(V.hourly(spark, folder), S, "ts", "value", TZ)


@query("metric_mae_rmae", sql(f"""SELECT series, count(*) AS n_obs, {r('avg(abs(y - naive))')} AS mae_model, {r('avg(abs(y - w))')} AS mae_week,
    {r('avg(abs(y - naive)) / nullif(avg(abs(y - w)), 0)')} AS rmae_vs_week FROM (
    SELECT a.series, a.value AS y, b.value AS naive, c.value AS w FROM pf a LEFT JOIN pf b ON b.series = a.series AND b.day = a.day - 1 AND b.hour = a.hour
    LEFT JOIN pf c ON c.series = a.series AND c.day = a.day - 7 AND c.hour = a.hour) GROUP BY 1""", "pf"))
def metric_mae_rmae(spark, folder):
    local = tl.actuals_local_key(V.filled(spark, folder), S, "ts", TZ, ["value"])
    lagged = ft.lag_day_join(local, S, "value", [1, 7]).withColumnRenamed("lag7", "week")
    return mt.mae_rmae(lagged, S, "value", "lag1", ["week"])


@query("day_hour_profile", sql(f"SELECT series, {d('day')} AS day, hour, {r('value')} AS value FROM slots", "slots"))
def day_hour_profile(spark, folder):
    return profile(spark, folder)


@query("lag_day_join", sql(f"""SELECT a.series, {d('a.day')} AS day, a.hour, {r('a.value')} AS value, {', '.join(f"{r(f'l{k}.value')} AS lag{k}" for k in (1, 2, 3, 7))} FROM slots a
    {' '.join(f'LEFT JOIN slots l{k} ON l{k}.series = a.series AND l{k}.day = a.day - {k} AND l{k}.hour = a.hour' for k in (1, 2, 3, 7))}""", "slots"))
def lag_day_join(spark, folder):
    return ft.lag_day_join(profile(spark, folder), S, "value", [1, 2, 3, 7])


_NV = """SELECT a.series, a.day, a.hour, a.value AS y, CASE WHEN isodow(a.day) IN (1, 6, 7) THEN w.value ELSE l.value END AS naive, l.value AS naive_lag24,
    (l.value + m.value) / 2 AS point FROM slots a LEFT JOIN slots l ON l.series = a.series AND l.day = a.day - 1 AND l.hour = a.hour
    LEFT JOIN slots m ON m.series = a.series AND m.day = a.day - 2 AND m.hour = a.hour LEFT JOIN slots w ON w.series = a.series AND w.day = a.day - 7 AND w.hour = a.hour"""


@query("naive_weekday_aware", sql(f"SELECT series, {d('day')} AS day, hour, {r('y')} AS value, {r('naive')} AS naive, {r('naive_lag24')} AS naive_lag24 FROM nv", "slots", nv=_NV))
def naive_weekday_aware(spark, folder):
    return ft.naive_weekday_aware(profile(spark, folder), S, "value")


@query("asof_gate_value", sql(f"""SELECT g.series, {d('g.day')} AS day, {t('g.gate')} AS gate, {r('x.value')} AS value FROM (
    SELECT series, day, timezone('UTC', timezone('{TZ}', day - INTERVAL 12 HOUR)) AS gate FROM (SELECT DISTINCT series, day FROM p)) g
    ASOF LEFT JOIN (SELECT * FROM h WHERE value IS NOT NULL) x ON x.series = g.series AND x.ts <= g.gate""", "p"))
def asof_gate_value(spark, folder):
    h = V.hourly(spark, folder)
    return ft.asof_gate_value(h, S, "ts", "value", profile(spark, folder).select("series", "day").distinct(), TZ)


def rolled(res, name):
    return f"""CASE WHEN c_{name} >= {BURN} THEN list_transform(quantile_cont({res}, {TAUS}) OVER (PARTITION BY series, hour ORDER BY c_{name}
        RANGE BETWEEN {LAST} PRECEDING AND 1 PRECEDING), lambda x: x + {name}) END"""


_WF = dict(
    nv=_NV,
    cn="""SELECT *, count(y - point) OVER w AS c_point, count(y - naive) OVER w AS c_naive FROM nv
        WINDOW w AS (PARTITION BY series, hour ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    wf=f"""SELECT *, timezone('UTC', timezone('{TZ}', day + CAST(hour AS INTEGER) * INTERVAL 1 HOUR)) AS ts, {rolled('y - point', 'point')} AS q, {rolled('y - naive', 'naive')} AS naive_q,
        min(day) OVER (PARTITION BY series, blk) AS refit_day FROM (SELECT *, CAST(floor((dense_rank() OVER (PARTITION BY series ORDER BY day) - 1) / 3) AS BIGINT) AS blk FROM cn)""",
)


def forecasts(spark, folder):
    p = profile(spark, folder)
    point = ft.lag_day_join(p, S, "value", [1, 2]).select("series", "day", "hour", ((F.col("lag1") + F.col("lag2")) / 2).alias("point"))
    return fc.walk_forward(p, S, "value", point, p.select("series", "day"), TZ, every=3, last=LAST, burn_in=BURN)


@query("rolling_residual_quantiles", sql(f"""SELECT series, {d('day')} AS day, hour, {', '.join(f"{r(f'q[{i}]')} AS q{i}" for i in range(1, 20))} FROM wf""", "slots", **_WF))
def rolling_residual_quantiles(spark, folder):
    p = ft.lag_day_join(profile(spark, folder), S, "value", [1, 2]).withColumn("point", (F.col("lag1") + F.col("lag2")) / 2)
    out = fc.rolling_residual_quantiles(p, ["series", "hour"], "day", "value", "point", "q", LAST, BURN)
    return out.select("series", "day", "hour", *[F.try_element_at("q", F.lit(i)).alias(f"q{i}") for i in range(1, 20)])


@query("rolling_quantiles_stream", sql(f"""SELECT series, {d('day')} AS day, hour, {', '.join(f"{r(f'q[{i}]')} AS q{i}" for i in range(1, 20))} FROM wf""", "slots", **_WF))
def rolling_quantiles_stream(spark, folder):
    """The same rows as a stream of five batches, of which each has neighbouring days out of order; a far day at the end makes all days final."""
    p = ft.lag_day_join(profile(spark, folder), S, "value", [1, 2]).withColumn("point", (F.col("lag1") + F.col("lag2")) / 2)
    rows = cut_lineage(p.select("series", F.col("hour").cast("int").alias("hour"), "day", F.col("value").alias("y"), "point"))
    path = sk.scratch_folder(spark)
    number = F.dense_rank().over(Window.orderBy("day")) - 1  # days of one series' table
    days = rows.select("day").distinct().withColumn("batch", F.floor((number - F.when(number % 7 == 6, 2).otherwise(0)) / 7)).orderBy("day").collect()
    batches = sorted({x.batch for x in days})
    end = spark.createDataFrame([("end", -1, max(x.day for x in days).replace(year=2100), None, None)], rows.schema)
    for b_ in batches:
        rows.where(F.col("day").isin([x.day for x in days if x.batch == b_])).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for _ in range(2):  # the watermark of a batch counts in the next one
        end.coalesce(1).write.mode("append").parquet(f"{path}/in")
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = sq.rolling_residual_quantiles(feed, ["series", "hour"], "day", "y", "point", "8 days", LAST, BURN)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").where("hour >= 0").select(
        "series", "day", "hour", *[F.try_element_at("q", F.lit(i)).alias(f"q{i}") for i in range(1, 20)])


@query("refit_carry_forward", sql(f"SELECT DISTINCT series, {d('day')} AS day, {d('refit_day')} AS refit_day FROM wf", "slots", **_WF))
def refit_carry_forward(spark, folder):
    return fc.refit_carry_forward(profile(spark, folder).select("series", "day").distinct(), S, "day", 3)


@query("walk_forward_backtest", sql(f"""SELECT series, {d('day')} AS day, hour, {t('ts')} AS ts, {d('refit_day')} AS refit_day, {r('y')} AS y, {r('point')} AS point, {r('naive')} AS naive,
    {r('naive_lag24')} AS naive_lag24, {', '.join(f"{r(f'{c}[{k}]')} AS {c}{5 * k:02d}" for c in ('q', 'naive_q') for k in range(1, 20))} FROM wf""", "slots", **_WF))
def walk_forward_backtest(spark, folder):
    at = lambda c, i, n: F.try_element_at(c, F.lit(i)).alias(n)
    return forecasts(spark, folder).select("series", "day", "hour", "ts", "refit_day", "y", "point", "naive", "naive_lag24",
                                           *[at(c, k, f"{c}{5 * k:02d}") for c in ("q", "naive_q") for k in range(1, 20)])


LOSS = lambda q: f"2 * list_sum(list_transform(range(1, 20), lambda i: greatest({TAUS}[i] * (y - {q}[i]), ({TAUS}[i] - 1) * (y - {q}[i])))) / 19"
_RD = f"SELECT *, (y IS NOT NULL AND point IS NOT NULL AND q[1] IS NOT NULL) AS rdy, {LOSS('q')} AS lm, {LOSS('naive_q')} AS ln FROM wf"
SUMMARY = f"""count(*) AS n_obs, {r('avg(abs(y - point))')} AS mae_model, {r('avg(abs(y - naive))')} AS mae_naive, {r('avg(abs(y - naive_lag24))')} AS mae_naive_lag24,
    {r('avg(abs(y - point)) / nullif(avg(abs(y - naive)), 0)')} AS rmae_vs_naive, {r('avg(abs(y - point)) / nullif(avg(abs(y - naive_lag24)), 0)')} AS rmae_vs_naive_lag24,
    count(*) FILTER (WHERE point IS NULL) AS n_obs_nonfinite_point, count(*) FILTER (WHERE rdy) AS n_obs_scoreable_crps,
    count(*) FILTER (WHERE rdy AND lm IS NULL) AS n_crps_model_nan_rows, count(*) FILTER (WHERE rdy AND naive_q[1] IS NULL) AS n_crps_naive_nan_rows,
    {r('avg(lm) FILTER (WHERE rdy)')} AS crps_model, {r('avg(ln) FILTER (WHERE rdy AND naive_q[1] IS NOT NULL)')} AS crps_naive,
    {r('avg(CAST(y BETWEEN q[1] AND q[19] AS INTEGER)) FILTER (WHERE rdy)')} AS coverage90_model,
    {r('avg(CAST(y BETWEEN naive_q[1] AND naive_q[19] AS INTEGER)) FILTER (WHERE rdy AND naive_q[1] IS NOT NULL)')} AS coverage90_naive"""


@query("metric_pinball_crps", sql(f"""SELECT series, hour, count(lm) AS n, count(*) - count(lm) AS n_null, {r('avg(lm)')} AS crps FROM rd GROUP BY 1, 2""", "slots", **_WF, rd=_RD))
def metric_pinball_crps(spark, folder):
    loss = num.pinball_mean(F.col("y"), F.col("q"))
    f = forecasts(spark, folder).withColumn("loss", loss)
    return f.groupBy("series", "hour").agg(F.count("loss").alias("n"), F.count_if(F.col("loss").isNull()).alias("n_null"), F.avg("loss").alias("crps"))


@query("metric_coverage", sql(f"""SELECT series, {r('avg(CAST(y BETWEEN q[1] AND q[19] AS INTEGER)) FILTER (WHERE y IS NOT NULL AND q IS NOT NULL)')} AS coverage90 FROM wf GROUP BY 1""", "slots", **_WF))
def metric_coverage(spark, folder):
    at = lambda i: F.try_element_at("q", F.lit(i))
    return forecasts(spark, folder).groupBy("series").agg(mt.coverage(F.col("y"), at(1), at(19)).alias("coverage90"))


@query("summary_period", sql(f"SELECT series, {SUMMARY} FROM rd GROUP BY 1", "slots", **_WF, rd=_RD))
def summary_period(spark, folder):
    return mt.summary_period(forecasts(spark, folder), S)


_SEASON = "CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m IN (3, 4, 5) THEN 'spring' WHEN m IN (6, 7, 8) THEN 'summer' WHEN m IS NOT NULL THEN 'autumn' END"
_GS = f"""SELECT *, CAST(year({L('ts')}) AS VARCHAR) AS yr, {_SEASON.replace('m ', f"month({L('ts')}) ")} AS sn,
    CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.start <= rd.ts AND rd.ts <= e."end") THEN 'inside' ELSE 'outside' END AS ins FROM rd"""


@query("summary_grouping_sets", sql(f"""SELECT 'overall' AS cut, 'all' AS label, {SUMMARY} FROM gs UNION ALL SELECT 'year', yr, {SUMMARY} FROM gs GROUP BY yr
    UNION ALL SELECT 'season', sn, {SUMMARY} FROM gs GROUP BY sn UNION ALL SELECT 'inside', ins, {SUMMARY} FROM gs GROUP BY ins""", "slots", "e", **_WF, rd=_RD, gs=_GS))
def summary_grouping_sets(spark, folder):
    e = V.curated(spark, folder)
    f = iv.point_in_any_interval(forecasts(spark, folder), e, [], "ts", "start", "end", "inside_event")
    return mt.summary_grouping_sets(f, "ts", TZ, "inside_event")


@query("select_by_min_metric", sql(f"""SELECT lag, {r('mae')} AS mae FROM (SELECT k.lag, avg(abs(a.value - b.value)) AS mae FROM slots a, (SELECT unnest([1, 2, 3, 7]) AS lag) k, slots b
    WHERE b.series = a.series AND b.day = a.day - CAST(k.lag AS INTEGER) AND b.hour = a.hour GROUP BY 1) ORDER BY mae, lag LIMIT 1""", "slots"))
def select_by_min_metric(spark, folder):
    p = profile(spark, folder)
    truth = p.withColumnRenamed("value", "y")
    scored = ft.shifted(p, S, "value", [1, 2, 3, 7]).join(truth, ["series", "day", "hour"])
    return mt.select_by_min_metric(scored.groupBy("lag").agg(mt.mae(F.col("y"), F.col("value")).alias("mae")), "mae", "lag")


@query("metric_rmse_bias", sql(f"""SELECT condition, count(*) AS n_obs, {r('avg(abs(point - y))')} AS mae, {r('sqrt(avg((point - y) * (point - y)))')} AS rmse, {r('avg(point - y)')} AS bias
    FROM c WHERE y IS NOT NULL GROUP BY 1""", "c"))
def metric_rmse_bias(spark, folder):
    return mt.rmse_bias(V.conditions(spark, folder), ["condition"], "y", "point")


@query("pivot_condition", sql(f"""SELECT event_id, {d('day')} AS day, hour, {r('no_context')} AS no_context, {r('context')} AS context, {r('oracle')} AS oracle FROM cw""", "cw"))
def pivot_condition(spark, folder):
    return mt.pivot_condition(V.conditions(spark, folder), ["event_id", "day", "hour"], "condition", "point", ["no_context", "context", "oracle"])


_FULL = "cw WHERE y IS NOT NULL AND no_context IS NOT NULL AND context IS NOT NULL AND oracle IS NOT NULL"


@query("paired_wins", sql(f"""SELECT event_id, count(*) AS n_hours, {', '.join(f'''{r(f"avg(abs({c} - y)) - avg(abs(no_context - y))")} AS {c}_minus_no_context_mae,
    count(*) FILTER (WHERE abs({c} - y) < abs(no_context - y)) AS {c}_wins, count(*) FILTER (WHERE abs({c} - y) > abs(no_context - y)) AS {c}_loses,
    count(*) FILTER (WHERE abs({c} - y) = abs(no_context - y)) AS {c}_ties''' for c in ('context', 'oracle'))} FROM {_FULL} GROUP BY 1""", "cw"))
def paired_wins(spark, folder):
    return mt.paired_wins(V.wide_conditions(spark, folder), ["event_id"], "y", "no_context", ["context", "oracle"])


@query("by_group_delta_table", sql(f"""SELECT event_id, {', '.join(f"{r(f'avg(abs({c} - y))')} AS mae_{c}" for c in ('no_context', 'context', 'oracle'))},
    {', '.join(f"{r(f'avg(abs({c} - y)) - avg(abs(no_context - y))')} AS {c}_minus_no_context_mae" for c in ('context', 'oracle'))} FROM cw WHERE y IS NOT NULL GROUP BY 1""", "cw"))
def by_group_delta_table(spark, folder):
    return mt.by_group_delta_table(V.conditions(spark, folder), "event_id", "y", "point", "condition", "no_context", ["context", "oracle"])


@query("join_many_to_one_checked", sql(f"SELECT c.event_id, {d('c.day')} AS day, c.hour, condition, {r('point')} AS point, {r('s.value')} AS actual FROM c LEFT JOIN slots s ON s.series = c.event_id AND s.day = c.day AND s.hour = c.hour", "c", "slots"))
def join_many_to_one_checked(spark, folder):
    actual = profile(spark, folder).select(F.col("series").alias("event_id"), "day", "hour", F.col("value").alias("actual"))
    return rel.join_many_to_one_checked(V.conditions(spark, folder).drop("y"), actual, ["event_id", "day", "hour"])


@query("join_one_to_one_checked", sql(f"""SELECT event_id, {d('day')} AS day, hour, {r('context')} AS point, {r('no_context')} AS no_context, {r('context - no_context')} AS delta FROM cw""", "cw"))
def join_one_to_one_checked(spark, folder):
    c = V.conditions(spark, folder)
    left = c.where("condition = 'context'").select("event_id", "day", "hour", "point")
    right = c.where("condition = 'no_context'").select("event_id", "day", "hour", F.col("point").alias("no_context"))
    j = rel.join_one_to_one_checked(left, right, ["event_id", "day", "hour"])
    return j.withColumn("delta", F.col("point") - F.col("no_context"))


@query("forecast_shift_rollup", sql(f"""SELECT count(*) AS n_days, {r('median(a)')} AS median_context, {r('median(o)')} AS median_oracle, count(*) FILTER (WHERE o < 1e-10) AS n_oracle_same FROM (
    SELECT event_id, day, max(abs(context - no_context)) AS a, max(abs(oracle - no_context)) AS o FROM cw GROUP BY 1, 2)""", "cw"))
def forecast_shift_rollup(spark, folder):
    days = mt.forecast_shift_rollup(V.wide_conditions(spark, folder), ["event_id", "day"], "no_context", {"context": "max_context", "oracle": "max_oracle"})
    one = days.withColumn("all", F.lit(1))
    sums = one.groupBy("all").agg(F.count(F.lit(1)).alias("n_days"), F.count_if("max_oracle_none").alias("n_oracle_same"))
    return (sums.join(inf.medians(one, ["all"], "max_context", "median_context"), "all")
            .join(inf.medians(one, ["all"], "max_oracle", "median_oracle"), "all").drop("all"))


@query("quantiles_exact", sql(f"""SELECT series, p, {r('q')} AS q FROM (SELECT series, unnest([0.05, 0.5, 0.95, 0.99])::DOUBLE AS p, unnest(quantile_cont(value, [0.05, 0.5, 0.95, 0.99])) AS q FROM s GROUP BY 1)""", "s"))
def quantiles_exact(spark, folder):
    return running.exact_quantiles(V.raw_series(spark, folder), S, "value", [0.05, 0.5, 0.95, 0.99])


@query("corr_pair", sql(f"""SELECT x.series, count(*) AS n, {r('corr(x.value, y.value)')} AS r FROM slots x JOIN slots y ON y.series = x.series AND y.day = x.day - 1 AND y.hour = x.hour
    WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1""", "slots"))
def corr_pair(spark, folder):
    p = profile(spark, folder).select("series", F.struct("day", "hour").alias("slot"), "value")
    right = profile(spark, folder).select("series", F.struct(F.date_add("day", 1).alias("day"), "hour").alias("slot"), F.col("value").alias("before"))
    return mt.corr_pair(p, right, S, "slot", "value", "before")


@query("driver_validation", sql(f"""SELECT x.series, count(*) FILTER (WHERE x.value IS NOT NULL AND l.value IS NOT NULL) AS n_overlap, {r('corr(x.value, l.value)')} AS r, {r('any_value(p99)')} AS p99,
    {r('count(*) FILTER (WHERE x.value < p99 AND 100 - l.value > 0) / nullif(count(*) FILTER (WHERE x.value < p99), 0)')} AS share_active
    FROM slots x LEFT JOIN slots l ON l.series = x.series AND l.day = x.day - 1 AND l.hour = x.hour
    JOIN (SELECT series, quantile_cont(value, 0.99) AS p99 FROM slots GROUP BY 1) k ON k.series = x.series GROUP BY 1""", "slots"))
def driver_validation(spark, folder):
    p = profile(spark, folder).select("series", F.struct("day", "hour").alias("slot"), "value")
    drv = profile(spark, folder).select("series", F.struct(F.date_add("day", 1).alias("day"), "hour").alias("slot"),
                                        F.col("value").alias("avail"), (F.lit(100.0) - F.col("value")).alias("lost"))
    return mt.driver_validation(p, drv, S, "slot", "value", "avail", "lost")


@query("json_array_column", sql(f"""SELECT event_id, {d('day')} AS day, hour, condition, len(pts) AS n, {r('list_avg(pts)')} AS mean FROM (SELECT event_id, day, hour, condition,
    CASE WHEN condition = 'context' AND point IS NOT NULL THEN [point, point + 1, point * 2] ELSE [] END AS pts FROM c)""", "c"))
def json_array_column(spark, folder):
    from hourloom.operators import documents as dc

    c = V.conditions(spark, folder)
    p = F.col("point")
    text = F.when((F.col("condition") == "context") & p.isNotNull(), dc.to_json_array(F.array(p, p + 1, p * 2)))
    pts = dc.from_json_array(text)
    return c.withColumn("pts", pts).select("event_id", "day", "hour", "condition", F.size("pts").alias("n"),
                                           (F.aggregate("pts", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("pts"), F.lit(0))).alias("mean"))


def loss_rows(spark, folder):
    w = V.wide_conditions(spark, folder)
    base = F.abs(F.col("no_context") - F.col("y"))
    pairs = F.array(*[F.struct(F.lit(c).alias("comparison"), (F.abs(F.col(c) - F.col("y")) - base).alias("diff")) for c in ("context", "oracle")])
    return w.select("event_id", "day", "hour", F.inline(pairs))


_DM = dict(
    ld="""SELECT event_id, day, hour, 'context' AS comparison, abs(context - y) - abs(no_context - y) AS diff FROM cw UNION ALL
        SELECT event_id, day, hour, 'oracle', abs(oracle - y) - abs(no_context - y) FROM cw""",
    dx="SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY event_id, day, hour) AS rn, diff - avg(diff) OVER (PARTITION BY comparison) AS c FROM ld WHERE diff IS NOT NULL",
    ds="SELECT comparison, count(*) AS n, avg(diff) AS m, CAST(least(23, floor(pow(count(*), 1.0 / 3))) AS INTEGER) AS lag, sum(c * c) / count(*) AS g0 FROM dx GROUP BY 1",
    dg="""SELECT a.comparison, sum(2 * (1 - (a.rn - z.rn) / (ds.lag + 1)) * a.c * z.c / ds.n) AS g FROM dx a JOIN ds ON ds.comparison = a.comparison
        JOIN dx z ON z.comparison = a.comparison AND z.rn BETWEEN a.rn - ds.lag AND a.rn - 1 GROUP BY 1""",
)


# the two-sided p-value as twice the normal density's integral, by Simpson's rule over a table of 4,001 points
_TAIL = dict(
    st="SELECT ds.comparison, n, m, m / sqrt((g0 + g) / n) AS z, lag FROM ds JOIN dg ON dg.comparison = ds.comparison",
    tail="""SELECT comparison, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs(z) + k * 0.003, 2) / 2)) * 0.003 / 3 * 2 / sqrt(2 * pi()) AS p
        FROM st, (SELECT unnest(range(0, 4001)) AS k) GROUP BY 1""",
)


@query("dm_test_hac", sql(f"""SELECT st.comparison, n, {r('m')} AS mean_loss_diff, {r('z')} AS dm_stat, {r('p')} AS p_value, lag FROM st JOIN tail ON tail.comparison = st.comparison""", "cw", **_DM, **_TAIL))
def dm_test_hac(spark, folder):
    return inf.dm_test(loss_rows(spark, folder), ["comparison"], ["event_id", "day", "hour"], "diff", block=512)


@query("usage_cost_rollup", f"""SELECT lang, count(*) AS n_calls, count(*) FILTER (WHERE doc_id % 3 = 0) AS cache_hits, sum(n_chars) AS prompt_tokens, sum(length(source)) AS completion_tokens,
    {r('sum(n_chars) * 0.4 / 1e6 + sum(length(source)) * 1.6 / 1e6')} AS cost FROM documents GROUP BY 1""")
def usage_cost_rollup(spark, folder):
    docs = V.table(spark, folder, "documents").withColumn("out", F.length("source")).withColumn("hit", F.col("doc_id") % 3 == 0)
    return mt.usage_cost_rollup(docs, ["lang"], "n_chars", "out", "hit", 0.4, 1.6)
