"""Spines, dedups, resampling, fills, coverage."""

from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.functions import numeric as num
from hourloom.functions import text as tx
from hourloom.operators import features as ft
from hourloom.operators import timeline as tl
from testbed import views as V
from testbed.registry import b, d, query, r, t
from testbed.views import TZ, sql

S = ["series"]
L = V.LOCAL.format


@query("hour_spine", f"""WITH k AS (SELECT o_orderstatus AS k, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1),
  h AS (SELECT k, unnest(generate_series(timezone('UTC', timezone('{TZ}', a)),
        timezone('UTC', timezone('{TZ}', z)) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM k)
  SELECT k, {d(L('ts'))} AS local_day, count(*) AS n_hours, {t('min(ts)')} AS first_ts, {t('max(ts)')} AS last_ts
  FROM h GROUP BY 1, 2""")
def hour_spine(spark, folder):
    o = V.table(spark, folder, "orders")
    bounds = o.groupBy(F.col("o_orderstatus").alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    h = tl.hour_spine(bounds, "a", "z", TZ)
    return h.groupBy("k", cal.local_day(F.col("ts"), TZ).alias("local_day")).agg(
        F.count(F.lit(1)).alias("n_hours"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("day_spine", f"""WITH k AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders GROUP BY 1),
  x AS (SELECT o_custkey, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS day FROM k)
  SELECT o_custkey, year(day) AS y, count(*) AS n, {d('min(day)')} AS first_day, {d('max(day)')} AS last_day FROM x GROUP BY 1, 2""")
def day_spine(spark, folder):
    o = V.table(spark, folder, "orders")
    k = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    x = tl.day_spine(k, "a", "z")
    return x.groupBy("o_custkey", F.year("day").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("event_days", sql(f"""SELECT event_id, {d('day')} AS day FROM (SELECT event_id, unnest(generate_series(
    CAST(CAST({L('start')} AS DATE) AS TIMESTAMP), CAST(CAST({L('"end"')} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM e)""", "e"))
def event_days(spark, folder):
    return tl.event_days(V.curated(spark, folder), "start", "end", TZ).select("event_id", "day")


_WALL = "(o_orderdate + CAST(o_orderkey % 24 AS INTEGER) * INTERVAL 1 HOUR)"
_INST = f"timezone('UTC', timezone('{TZ}', {_WALL}))"


@query("hour_label", f"""SELECT o_orderkey, {t(f'''CASE
    WHEN {L(f"({_INST} - INTERVAL 1 HOUR)")} = {_WALL} THEN {_INST} - INTERVAL 1 HOUR
    WHEN {L(_INST)} = {_WALL} THEN {_INST} END''')} AS at FROM orders""")
def hour_label(spark, folder):
    o = V.table(spark, folder, "orders")
    return o.select("o_orderkey", cal.hour_label(F.to_date("o_orderdate"), F.pmod("o_orderkey", F.lit(24)), TZ).alias("at"))


@query("gate_time", f"""SELECT o_orderkey, {t(f"timezone('UTC', timezone('{TZ}', o_orderdate - INTERVAL 12 HOUR))")} AS gate FROM orders""")
def gate_time(spark, folder):
    o = V.table(spark, folder, "orders")
    return o.select("o_orderkey", cal.gate_time(F.to_date("o_orderdate"), TZ).alias("gate"))


@query("fourier_calendar", f"""WITH hol AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_quantity = 50),
  x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT {d('x.day')} AS day, {', '.join(f"CASE WHEN isodow(x.day) = {i + 1} THEN 1.0 ELSE 0.0 END::DOUBLE AS weekday_{i}" for i in range(7))},
  CASE WHEN hol.day IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS is_public_holiday,
  {', '.join(f"{r(f'{fn}({k} * 2 * pi() * dayofyear(x.day) / 365.25)')} AS fourier_{fn}_{k}" for k in (1, 2) for fn in ('sin', 'cos'))}
  FROM x LEFT JOIN hol ON hol.day = x.day""")
def fourier_calendar(spark, folder):
    days = V.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    hol = V.table(spark, folder, "lineitem").where("l_quantity = 50").select(F.to_date("l_shipdate").alias("day"))
    return ft.calendar_features(days, hol)


@query("dedup_index_first", sql(f"""SELECT series, {t('ts')} AS ts, value, event_id FROM (SELECT series, date_trunc('hour', ts) AS ts, value, event_id,
    row_number() OVER (PARTITION BY series, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM s) WHERE rn = 1""", "s"))
def dedup_index_first(spark, folder):
    s = V.raw_series(spark, folder).withColumn("ts", F.date_trunc("hour", "ts"))
    return tl.dedup_index_first(s, ["series", "ts"], ["event_id"])


@query("dedup_full_row", f"""SELECT l_orderkey, l_linenumber, l_returnflag, {t('min(l_shipdate)')} AS l_shipdate FROM lineitem GROUP BY 1, 2, 3""")
def dedup_full_row(spark, folder):
    li = V.table(spark, folder, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    return tl.dedup_full_row(li, ["l_shipdate"], ["l_shipdate"])


@query("resample_mean", sql(f"SELECT series, {t('ts')} AS ts, {r('value')} AS value FROM h", "h"))
def resample_mean(spark, folder):
    return V.hourly(spark, folder)


@query("resample_ffill", sql(f"""SELECT series, {t('ts')} AS ts, {r('v')} AS value FROM (SELECT series, ts, k,
    last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
    FROM (SELECT series, ts, value, 0 AS k FROM wk UNION ALL SELECT series, ts, NULL, 1 FROM spine)) WHERE k = 1""", "spine",
    wk="SELECT series, date_trunc('week', ts) AS ts, max(value) AS value FROM s GROUP BY 1, 2"))
def resample_ffill(spark, folder):
    weekly = V.raw_series(spark, folder).groupBy("series", F.date_trunc("week", "ts").alias("ts")).agg(F.max("value").alias("value"))
    return tl.resample_ffill(weekly, S, "ts", "value", V.spine(spark, folder))


@query("ffill_columns", sql(f"SELECT series, {t('ts')} AS ts, {r('value')} AS value FROM hf", "hf"))
def ffill_columns(spark, folder):
    return V.filled(spark, folder)


@query("bfill_edge", sql(f"""SELECT series, {t('ts')} AS ts, {r('coalesce(value, f, bk)')} AS value,
    CASE WHEN value IS NOT NULL THEN 'none' WHEN f IS NOT NULL THEN 'forward' WHEN bk IS NOT NULL THEN 'backward' END AS value_fill FROM (
    SELECT series, ts, value,
      last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
      first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bk FROM h)""", "h"))
def bfill_edge(spark, folder):
    return tl.bfill_edge(V.hourly(spark, folder), S, "ts", ["value"])


@query("zero_fill_before_first", sql(f"""SELECT series, {t('ts')} AS ts, {r("CASE WHEN value IS NULL AND ts < f THEN 0.0 ELSE value END")} AS value,
    {b('coalesce(value IS NULL AND ts < f, false)')} AS filled FROM (SELECT *, min(ts) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY series) AS f FROM hi)""", "h",
    hi="SELECT series, ts, CASE WHEN value > 20 THEN value END AS value FROM h"))
def zero_fill_before_first(spark, folder):
    h = V.hourly(spark, folder).withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return tl.zero_fill_before_first(h, S, "ts", "value")


@query("align_on_spine", sql(f"""SELECT {t('ts')} AS ts, {', '.join(r(f"max(value) FILTER (WHERE series = '{s}')") + f' AS "{s}"' for s in V.SERIES)} FROM h GROUP BY ts""", "h"))
def align_on_spine(spark, folder):
    one = V.spine(spark, folder).select("ts").distinct()
    return tl.align_on_spine(one, tl.hourly_mean(V.raw_series(spark, folder), S, "ts", "value"), "ts", "series", "value", V.SERIES)


@query("null_counts", sql("""SELECT a.series, 'value' AS "column", count(*) FILTER (WHERE a.value IS NULL) AS nulls_before,
    count(*) FILTER (WHERE f.value IS NULL) AS nulls_after FROM h a JOIN hf f ON f.series = a.series AND f.ts = a.ts GROUP BY 1""", "h", "hf"))
def null_counts(spark, folder):
    return tl.null_counts(V.hourly(spark, folder), V.filled(spark, folder), S, ["value"])


_COVER = """SELECT h.series, count(*) AS n_expected, count(value) AS n_present, count(*) - count(value) AS n_null,
    min(ts) FILTER (WHERE value IS NOT NULL) AS first_valid, max(ts) FILTER (WHERE value IS NOT NULL) AS last_valid,
    coalesce(any_value(l.len), 0) AS longest_run, any_value(l.a) AS longest_start, any_value(l.z) AS longest_end
    FROM h LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY len DESC, a) AS k FROM (
      SELECT series, isl, count(*) AS len, min(ts) AS a, max(ts) AS z FROM (
        SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts)
          - sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts) AS isl FROM h) WHERE value IS NULL GROUP BY 1, 2)) WHERE k = 1) l
    ON l.series = h.series GROUP BY h.series"""


@query("coverage_report", sql(f"""SELECT series, n_expected, n_present, n_null, longest_run, {t('first_valid')} AS first_valid, {t('last_valid')} AS last_valid,
    {t('longest_start')} AS longest_start, {t('longest_end')} AS longest_end FROM cov""", "h", cov=_COVER))
def coverage_report(spark, folder):
    return tl.coverage_report(V.hourly(spark, folder), S, "ts", "value")


_SW = dict(
    hc="SELECT series, date_trunc('hour', ts) AS h, count(*) AS n FROM s GROUP BY 1, 2",
    sw="""SELECT *, coalesce(h >= sh, false) AS aft, CASE WHEN coalesce(h >= sh, false) THEN n <> 4 ELSE n <> 1 END AS bad
        FROM (SELECT *, min(h) FILTER (WHERE n > 1) OVER (PARTITION BY series) AS sh FROM hc)""",
)


@query("resolution_switch", sql(f"""SELECT a.series, {t('any_value(sh)')} AS switch_hour, count(*) FILTER (WHERE aft) AS n_after,
    count(*) FILTER (WHERE aft AND bad) AS n_bad_after, count(*) FILTER (WHERE NOT aft AND bad) AS n_bad_before,
    (SELECT string_agg({t('h')}, ';' ORDER BY h) FROM ex WHERE ex.series = a.series AND ex.aft) AS examples_after,
    coalesce((SELECT string_agg({t('h')}, ';' ORDER BY h) FROM ex WHERE ex.series = a.series AND NOT ex.aft), '') AS examples_before
    FROM sw a GROUP BY a.series""", "s", **_SW,
    ex="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, aft ORDER BY h) AS k FROM sw WHERE bad) WHERE k <= 5"))
def resolution_switch(spark, folder):
    return tl.resolution_switch(V.raw_series(spark, folder), S, "ts")


@query("series_report", sql(f"""SELECT c.series, n_raw, n_negative, min_value, max_value, n_expected, n_present, n_null, longest_run,
    {t('first_valid')} AS first_valid, {t('last_valid')} AS last_valid, {t('longest_start')} AS longest_start, {t('longest_end')} AS longest_end,
    {t('sh')} AS switch_hour, n_after, n_bad_after, n_bad_before FROM cov c
    JOIN (SELECT series, count(*) AS n_raw, count(*) FILTER (WHERE value < 0) AS n_negative, min(value) AS min_value, max(value) AS max_value FROM s GROUP BY 1) x ON x.series = c.series
    JOIN (SELECT series, any_value(sh) AS sh, count(*) FILTER (WHERE aft) AS n_after, count(*) FILTER (WHERE aft AND bad) AS n_bad_after,
      count(*) FILTER (WHERE NOT aft AND bad) AS n_bad_before FROM sw GROUP BY 1) y ON y.series = c.series""", "h", cov=_COVER, **_SW))
def series_report(spark, folder):
    return tl.series_report(V.raw_series(spark, folder), V.hourly(spark, folder), S, "ts", "value")


@query("infer_freq", sql("""SELECT series, count(*) + 1 AS n_points, count(DISTINCT step) AS n_steps, min(step) AS min_step_us, max(step) AS max_step_us,
    CASE WHEN count(DISTINCT step) = 1 THEN max(step) END AS freq_us FROM (SELECT series, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series ORDER BY ts) AS step
    FROM (SELECT series, ts FROM s UNION ALL SELECT 'grid-' || series, ts FROM spine)) WHERE step IS NOT NULL GROUP BY 1""", "s", "spine"))
def infer_freq(spark, folder):
    grid = V.spine(spark, folder).select(F.concat(F.lit("grid-"), "series").alias("series"), "ts")
    return tl.infer_freq(V.raw_series(spark, folder).select("series", "ts").unionByName(grid), S, "ts")


@query("spacing_steps", sql(f"""SELECT series, step AS step_us, count(*) AS n, {t('min(before)')} AS first_at FROM (SELECT series, lag(ts) OVER w AS before, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step
    FROM (SELECT series, ts FROM s UNION ALL SELECT 'grid-' || series, ts FROM spine) WINDOW w AS (PARTITION BY series ORDER BY ts)) WHERE step IS NOT NULL GROUP BY 1, 2""", "s", "spine"))
def spacing_steps(spark, folder):
    grid = V.spine(spark, folder).select(F.concat(F.lit("grid-"), "series").alias("series"), "ts")
    return tl.spacing_steps(V.raw_series(spark, folder).select("series", "ts").unionByName(grid), S, "ts")


@query("range_sanity", sql(f"""SELECT series, count(*) FILTER (WHERE value < 0) AS n_negative, count(*) FILTER (WHERE NOT value BETWEEN 5 AND 200) AS n_out_of_range,
    count(*) FILTER (WHERE value IS NULL) AS n_null, {r('min(value)')} AS min_value, {r('max(value)')} AS max_value,
    {t('(SELECT ts FROM h k WHERE k.series = h.series AND value IS NOT NULL ORDER BY value, ts LIMIT 1)')} AS min_at,
    {r("min(value) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00')")} AS window_min FROM h GROUP BY series""", "h"))
def range_sanity(spark, folder):
    window = (F.lit("2024-01-10 12:00:00").cast("timestamp"), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return tl.range_sanity(V.hourly(spark, folder), S, "ts", "value", 5, 200, window)


@query("actuals_local_key", sql(f"SELECT series, {d('day')} AS day, hour, {r('value')} AS value FROM p", "p"))
def actuals_local_key(spark, folder):
    return tl.actuals_local_key(V.hourly(spark, folder), S, "ts", TZ, ["value"])


@query("filter_finite", sql(f"""SELECT series, count(*) AS n, {r('avg(v)')} AS mean FROM (SELECT series, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE
    WHEN event_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS v FROM s) WHERE isfinite(v) GROUP BY 1""", "s"))
def filter_finite(spark, folder):
    s = V.raw_series(spark, folder)
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf")).otherwise(F.col("value"))
    return s.withColumn("v", v).where(num.is_finite(F.col("v"))).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))


@query("coerce_numeric", """SELECT event_id, TRY_CAST(regexp_extract(props, ':\\s*([^}]*)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
    TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/e' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events""")
def coerce_numeric(spark, folder):
    e = V.table(spark, folder, "events")
    text = F.when(F.col("event_id") % 3 == 0, "n/e").otherwise(F.col("value").cast("string"))
    return e.select("event_id", F.regexp_extract("props", r":\s*([^}]*)", 1).try_cast("double").alias("k"),
                    F.col("event_type").try_cast("double").alias("bad"), text.try_cast("double").alias("v"))


@query("normalise_mixed_offsets", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE
    {t("o_orderdate + CAST(o_orderkey % 24 AS INTEGER) * INTERVAL 1 HOUR - CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 2 ELSE 1 END * INTERVAL 1 HOUR")} END AS at FROM orders""")
def normalise_mixed_offsets(spark, folder):
    from hourloom.sources.readers import parse_offset_timestamp

    o = V.table(spark, folder, "orders")
    text = F.concat(F.date_format(F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.pmod("o_orderkey", F.lit(24)) * 3600), "yyyy-MM-dd HH:mm:ss"),
                    F.when(F.month("o_orderdate").between(4, 9), "+02:00").otherwise("+01:00"))
    text = F.when(F.col("o_orderkey") % 13 == 0, "not a time").otherwise(text)
    return o.select("o_orderkey", parse_offset_timestamp(text).alias("at"))


@query("redact_secrets", """SELECT doc_id, md5(regexp_replace(x, '(securityToken=)[^&\\s]+', '\\1***REDACTED***', 'gi')) AS h FROM (
    SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' https://h/api?SecurityToken=ab' || doc_id || '&d=1' ELSE ' securitytoken=' || doc_id END AS x FROM documents)""")
def redact_secrets(spark, folder):
    docs = V.table(spark, folder, "documents")
    i = F.col("doc_id").cast("string")
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" https://h/api?SecurityToken=ab"), i, F.lit("&d=1"))).otherwise(F.concat(F.lit(" securitytoken="), i))
    return docs.select("doc_id", F.md5(tx.redact_token(F.concat("text", tail))).alias("h"))
