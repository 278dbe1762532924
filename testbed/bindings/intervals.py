"""Interval operators."""

from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import intervals as iv
from hourloom.operators import relations as rel
from hourloom.operators import timeline as tl
from testbed import views as V
from testbed.registry import b, d, query, r, t
from testbed.views import TZ, sql

U = ["unit"]
L = V.LOCAL.format

# hours from the first start to the last end of all intervals, per group
SPINE = lambda g: f"""SELECT k.{g}, x.ts FROM (SELECT DISTINCT {g} FROM i) k, (SELECT unnest(generate_series(min(start), max("end"), INTERVAL 1 HOUR)) AS ts FROM i) x"""
DAYS = lambda g: f"""SELECT k.{g}, x.ts FROM (SELECT DISTINCT {g} FROM i) k, (SELECT unnest(generate_series(min(start), max("end"), INTERVAL 1 HOUR)) AS ts FROM i) x"""


def interval_spine(i, group, step="1 hour"):
    span = i.agg(F.min("start").alias("a"), F.max("end").alias("b"))
    k = i.select(group).distinct().withColumn("a", span.select("a").scalar()).withColumn("b", span.select("b").scalar())
    return k.select(group, F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("ts"))


def interval_grid(i, group):
    """The hours of `interval_spine`, not written out."""
    span = i.agg(F.min("start").alias("a"), F.max("end").alias("b"))
    return iv.Grid(i.select(group).distinct(), span.select("a").scalar(), span.select("b").scalar())


def shift_feed(i):
    """Feed O starts and ends inside an hour, so that instants off the hour are covered too."""
    minutes = F.when(F.col("feed") == "O", F.lit(37)).otherwise(F.lit(0))
    add = lambda c: F.timestamp_seconds(F.unix_seconds(c) + minutes * 60)
    return i.withColumn("start", add("start")).withColumn("end", add("end"))


SHIFTED = """SELECT * REPLACE (start + CASE WHEN feed = 'O' THEN 37 ELSE 0 END * INTERVAL 1 MINUTE AS start,
    "end" + CASE WHEN feed = 'O' THEN 37 ELSE 0 END * INTERVAL 1 MINUTE AS "end") FROM i"""


@query("derive_reduction", sql(f"""SELECT row_id, greatest(50.0 - avail, 0.0) AS reduction, epoch("end" - start) / 86400.0 AS duration_days FROM i""", "i"))
def derive_reduction(spark, folder):
    i = V.intervals(spark, folder)
    return iv.derive_reduction(i, "nominal", "avail", "start", "end").select("row_id", "reduction", "duration_days")


@query("filter_candidates_gen", sql(f"""SELECT row_id, {t('start')} AS start FROM i WHERE kind = 'N' AND l_quantity >= 30 AND l_quantity BETWEEN 1 AND 45""", "i"))
def filter_candidates_gen(spark, folder):
    i = iv.derive_reduction(V.intervals(spark, folder), "nominal", "avail", "start", "end")
    i = i.withColumn("docstatus", F.when(F.col("kind") != "N", F.col("kind")))
    return iv.filter_candidates_gen(i, min_reduction=30.0, days=(1, 45)).select("row_id", "start")


@query("filter_candidates_tx", sql(f"""SELECT row_id, {t('start')} AS start FROM i WHERE feed = 'O' AND kind IN ('A', 'R') AND unit % 2 = 1 AND epoch("end" - start) >= 86400""", "i"))
def filter_candidates_tx(spark, folder):
    i = iv.derive_reduction(V.intervals(spark, folder), "nominal", "avail", "start", "end")
    i = i.withColumn("kept", F.col("feed") == "O").withColumn("business", F.when(F.col("unit") % 2 == 1, "Unplanned outage").otherwise("Planned maintenance"))
    return iv.filter_candidates_tx(i, "kept", "kind", ["A", "R"], "business", "Unplanned outage").select("row_id", "start")


@query("classify_season", sql(f"""SELECT row_id, CASE WHEN month({L('start')}) IN (12, 1, 2) THEN 'winter' WHEN month({L('start')}) IN (3, 4, 5) THEN 'spring'
    WHEN month({L('start')}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, {b(f"month({L('start')}) IN (4, 5, 6)")} AS flood FROM i""", "i"))
def classify_season(spark, folder):
    m = F.month(cal.wall(F.col("start"), TZ))
    return V.intervals(spark, folder).select("row_id", cal.season(m).alias("season"), cal.spring_flood(m).alias("flood"))


@query("exclude_status", sql("SELECT feed, docstatus, count(*) AS n FROM v WHERE docstatus IS DISTINCT FROM 'Cancelled' GROUP BY 1, 2", "v"))
def exclude_status(spark, folder):
    return iv.exclude_status(V.revisions(spark, folder)).groupBy("feed", "docstatus").agg(F.count(F.lit(1)).alias("n"))


@query("latest_revision", sql(f"""SELECT mrid, revision, docstatus, {t('period')} AS period, unit, feed, qty FROM (
    SELECT *, max(revision) OVER (PARTITION BY mrid) AS top FROM v) WHERE revision = top AND docstatus IS DISTINCT FROM 'Cancelled'""", "v"))
def latest_revision(spark, folder):
    return iv.latest_revision(V.revisions(spark, folder))


@query("agg_revision_multiplicity", sql("""SELECT feed, sum(n) AS n_rows, count(*) AS n_distinct, max(n) AS max_rows, count(*) FILTER (WHERE n > 1) AS n_multi
    FROM (SELECT feed, mrid, count(*) AS n FROM v GROUP BY 1, 2) GROUP BY 1""", "v"))
def agg_revision_multiplicity(spark, folder):
    return iv.agg_revision_multiplicity(V.revisions(spark, folder), ["feed"])


@query("composite_key_flag", sql("""SELECT v.mrid, v.revision, v.unit, v.qty, CAST(v.period AS VARCHAR)[1:10] AS period, CAST(k.mrid IS NOT NULL AS INTEGER) AS kept FROM v LEFT JOIN (
    SELECT DISTINCT mrid, revision FROM (SELECT *, max(revision) OVER (PARTITION BY mrid) AS top FROM v)
    WHERE revision = top AND docstatus IS DISTINCT FROM 'Cancelled') k ON k.mrid = v.mrid AND k.revision = v.revision""", "v"))
def composite_key_flag(spark, folder):
    v = V.revisions(spark, folder)
    return iv.composite_key_flag(v, iv.latest_revision(v), ["mrid", "revision"]).select("mrid", "revision", "unit", "qty", F.to_date("period").alias("period"), "kept")


@query("interval_anti_join", sql(f"""SELECT row_id FROM j o WHERE feed = 'O' AND NOT EXISTS (SELECT 1 FROM j f WHERE f.feed = 'F' AND f.unit = o.unit
    AND f.start < o."end" AND o.start < f."end")""", "i", sh=SHIFTED, j="SELECT * FROM sh"))
def interval_anti_join(spark, folder):
    i = shift_feed(V.intervals(spark, folder)).select("row_id", "unit", "start", "end", "feed")
    return iv.interval_anti_join(i.where("feed = 'O'"), i.where("feed = 'F'"), ["unit"], "start", "end").select("row_id")


@query("point_in_any_interval", sql(f"""SELECT series, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e WHERE e.start <= q.ts AND q.ts <= e."end" AND true)) AS n_inside
    FROM (SELECT series, ts FROM s UNION ALL SELECT 'grid', ts FROM spine UNION ALL SELECT 'none', NULL) q GROUP BY 1""", "s", "spine", "e"))
def point_in_any_interval(spark, folder):
    s = V.raw_series(spark, folder).select("series", "ts")
    grid = V.spine(spark, folder).select(F.lit("grid").alias("series"), "ts")
    none = spark.range(1).select(F.lit("none").alias("series"), F.lit(None).cast("timestamp").alias("ts"))
    e = V.curated(spark, folder)
    out = iv.point_in_any_interval(s.unionByName(grid).unionByName(none), e, [], "ts", "start", "end")
    return out.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside"))


@query("hour_interval_overlap", sql(f"""SELECT event_id, {d('day')} AS day, hour, {b('o > 0')} AS affected, {r('o')} AS overlap_hours FROM (
    SELECT event_id, day, hour, greatest(epoch(least(h0 + INTERVAL 1 HOUR, "end") - greatest(h0, start)) / 3600.0, 0) AS o FROM (
      SELECT *, timezone('UTC', timezone('{TZ}', day + CAST(hour AS INTEGER) * INTERVAL 1 HOUR)) AS h0 FROM (
        SELECT event_id, start, "end", unnest(generate_series(CAST(CAST({L('start')} AS DATE) AS TIMESTAMP), CAST(CAST({L('"end"')} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM e),
      (SELECT unnest(range(0, 24)) AS hour)))""", "e"))
def hour_interval_overlap(spark, folder):
    e = tl.event_days(V.curated(spark, folder), "start", "end", TZ)
    return rel.hour_interval_overlap(rel.cross_join_expand(e, "hour", 24), "day", "hour", "start", "end", TZ).select("event_id", "day", "hour", "affected", "overlap_hours")


@query("sweep_line_sum", sql(f"""SELECT kind, {t('ts')} AS ts, sum(coalesce(x, 0)) OVER (PARTITION BY kind ORDER BY ts RANGE UNBOUNDED PRECEDING) AS total FROM (
    SELECT kind, ts, sum(x) AS x, max(k) AS k FROM (SELECT kind, date_trunc('hour', start + INTERVAL 3599 SECOND) AS ts, l_quantity AS x, 0 AS k FROM sh
      UNION ALL SELECT kind, date_trunc('hour', "end" + INTERVAL 3599 SECOND), -l_quantity, 0 FROM sh UNION ALL SELECT kind, ts, 0, 1 FROM sp) GROUP BY 1, 2)
    QUALIFY k = 1""", "i", sh=SHIFTED, sp=SPINE("kind")))
def sweep_line_sum(spark, folder):
    i = V.intervals(spark, folder)
    red = iv.derive_reduction(shift_feed(i), "nominal", "avail", "start", "end")
    return iv.sweep_line_sum(red, ["kind"], "start", "end", "reduction", interval_spine(i, "kind"))


_MINACT = f"""SELECT p.unit, p.ts, min(a.avail) AS min_active FROM sp p LEFT JOIN sh a ON a.unit = p.unit AND a.start <= p.ts AND p.ts < a."end" GROUP BY 1, 2"""


# every hour of a day in six bits (60: nothing active), eight hours a number, so that all hours are compared one by one
_CODE = "CAST(coalesce(min_active, 60) AS BIGINT)"


@query("min_active_value", sql(f"SELECT unit, {d('ts')} AS day, count(*) AS n, " + ", ".join(
    f"sum({_CODE} << CAST(6 * (hour(ts) % 8) AS BIGINT)) FILTER (WHERE hour(ts) // 8 = {k})::BIGINT AS h{8 * k:02d}" for k in range(3)) + " FROM ma GROUP BY 1, 2", "i", sh=SHIFTED, sp=DAYS("unit"), ma=_MINACT))
def min_active_value(spark, folder):
    i = V.intervals(spark, folder)
    low = iv.min_active_value(shift_feed(i), ["unit"], "start", "end", "avail", interval_grid(i, "unit"))
    code = F.expr("shiftleft(CAST(coalesce(min_active, 60) AS BIGINT), CAST(6 * (hour(ts) % 8) AS INT))")
    return low.groupBy("unit", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.floor(F.hour("ts") / 8) == k, code)).alias(f"h{8 * k:02d}") for k in range(3)])


_NOM = "SELECT unit, max(avail) AS nominal FROM i GROUP BY 1"
_DRV = "SELECT ma.unit, ts, nominal, greatest(nominal - coalesce(min_active, nominal), 0) AS unavailable FROM ma JOIN nom ON nom.unit = ma.unit"


@query("capacity_driver", sql(f"SELECT unit, {d('ts')} AS day, nominal, sum(unavailable) AS total, max(unavailable) AS peak FROM drv GROUP BY 1, 2, 3", "i", sh=SHIFTED, sp=DAYS("unit"), ma=_MINACT, nom=_NOM, drv=_DRV))
def capacity_driver(spark, folder):
    i = V.intervals(spark, folder)
    drv = iv.capacity_driver(shift_feed(i), ["unit"], "start", "end", "avail", interval_grid(i, "unit"))
    return drv.groupBy("unit", F.to_date("ts").alias("day"), "nominal").agg(F.sum("unavailable").alias("total"), F.max("unavailable").alias("peak"))


@query("argmax_duration_check", sql(f"""SELECT l.unit, {t('l.start')} AS start, {t('l."end"')} AS "end", l.avail, count(*) AS n_hours,
    count(*) FILTER (WHERE abs(d.unavailable - (d.nominal - l.avail)) <= 1e-6) AS n_match
    FROM (SELECT * FROM sh ORDER BY "end" - start DESC, row_id LIMIT 1) l JOIN drv d ON d.unit = l.unit AND d.ts >= l.start AND d.ts < l."end" GROUP BY 1, 2, 3, 4""",
    "i", sh=SHIFTED, sp=DAYS("unit"), ma=_MINACT, nom=_NOM, drv=_DRV))
def argmax_duration_check(spark, folder):
    i = V.intervals(spark, folder)
    sh = shift_feed(i)
    drv = iv.capacity_driver(sh, ["unit"], "start", "end", "avail", interval_grid(i, "unit"))
    return iv.argmax_duration_check(sh, drv, ["unit"], "start", "end", "avail", ["row_id"])


@query("agg_sum_columns", sql(f"""SELECT {b('unit % 2')} AS side, {t('ts')} AS ts, sum(unavailable) AS total FROM drv GROUP BY 1, 2""",
    "i", sh=SHIFTED, sp=DAYS("unit"), ma=_MINACT, nom=_NOM, drv=_DRV))
def agg_sum_columns(spark, folder):
    i = V.intervals(spark, folder)
    drv = iv.capacity_driver(shift_feed(i), ["unit"], "start", "end", "avail", interval_grid(i, "unit"))
    return rel.sum_by_side(drv, F.pmod("unit", F.lit(2)).cast("int"), "ts", "unavailable")


@query("available_capacity", sql(f"""SELECT {t('sw.ts')} AS ts, inst.year, {r('inst.installed', 2)} AS installed, total, {r('inst.installed - total', 2)} AS available FROM (
      SELECT ts, sum(coalesce(x, 0)) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS total, k FROM (SELECT ts, sum(x) AS x, max(k) AS k FROM (
        SELECT start AS ts, l_quantity AS x, 0 AS k FROM i UNION ALL SELECT "end", -l_quantity, 0 FROM i UNION ALL SELECT DISTINCT ts, 0, 1 FROM sp) GROUP BY 1)) sw
    LEFT JOIN inst ON inst.year = year({L('sw.ts')}) WHERE sw.k = 1""", "i", sp=DAYS("kind"),
    inst="SELECT year(o_orderdate) AS year, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0 AS installed FROM orders GROUP BY 1"), digits={"installed": 2, "available": 2})
def available_capacity(spark, folder):
    i = iv.derive_reduction(V.intervals(spark, folder), "nominal", "avail", "start", "end")
    one = interval_spine(i, "kind", "1 hour").select("ts").distinct()
    total = iv.sweep_line_sum(i, [], "start", "end", "reduction", one)
    inst = V.registry(spark, folder).groupBy("year").agg((F.sum(F.round(F.col("mw") * 100).cast("bigint")) / 100).alias("installed"))
    return iv.available_capacity(inst, "year", total, "ts", "total", TZ)


@query("agg_registry_by_year", sql(f"""SELECT year, count(*) FILTER (WHERE mw >= 100000) AS n_kept, count(*) FILTER (WHERE mw < 100000) AS n_dropped,
    {r('sum(mw) FILTER (WHERE mw >= 100000)', 1)} AS installed FROM g GROUP BY 1""", "g"), digits={"installed": 1})
def agg_registry_by_year(spark, folder):
    return rel.registry_by_year(V.registry(spark, folder), "year", "mw", 100000.0)


@query("agg_first_per_year", sql(f"""SELECT year, {r('total', 2)} AS total, n_rows, {b('n_rows > 1')} AS duplicated FROM (SELECT year(o_orderdate) AS year,
    row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY year(o_orderdate)) AS n_rows,
    coalesce(o_totalprice, 0) + coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0) AS total FROM orders) WHERE rn = 1"""), digits={"total": 2})
def agg_first_per_year(spark, folder):
    o = V.table(spark, folder, "orders").withColumn("extra", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return rel.first_per_year(o, F.year("o_orderdate"), ["o_totalprice", "extra"], ["o_orderdate", "o_orderkey"])


@query("key_reconciliation", sql(f"""SELECT unit, year, n, sum(n) OVER () AS n_missing FROM (SELECT unit, year({L('start')}) AS year, count(*) AS n FROM i
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unit, year FROM g WHERE mw >= 100000) k WHERE k.unit = i.unit AND k.year = year({L('i.start')})) GROUP BY 1, 2)
    ORDER BY year, unit LIMIT 20""", "i", "g"))
def key_reconciliation(spark, folder):
    i = V.intervals(spark, folder).select("unit", F.year(cal.wall(F.col("start"), TZ)).alias("year"))
    return rel.key_reconciliation(i, V.registry(spark, folder).where("mw >= 100000"), ["unit", "year"], 20, order=["year", "unit"])


def feed_ids(spark, folder):
    """Order ids of the rows of both feeds, and those of orders, without which a row is no interval."""
    li = V.table(spark, folder, "lineitem")
    return li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), "l_orderkey", V.table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"))


@query("id_set_compare", sql("""SELECT count(*) FILTER (WHERE a.u IS NOT NULL AND b.u IS NULL) AS n_only_left, count(*) FILTER (WHERE a.u IS NULL) AS n_only_right,
    count(*) FILTER (WHERE a.u IS NOT NULL AND b.u IS NOT NULL) AS n_both FROM (SELECT DISTINCT l_orderkey AS u FROM i WHERE feed = 'F') a
    FULL JOIN (SELECT DISTINCT l_orderkey AS u FROM i WHERE feed = 'O') b ON a.u = b.u""", "i"))
def id_set_compare(spark, folder):
    return rel.id_set_compare(*feed_ids(spark, folder))


@query("set_intersect_except", sql("""SELECT 'both' AS side, u FROM (SELECT l_orderkey AS u FROM i WHERE feed = 'F' INTERSECT SELECT l_orderkey FROM i WHERE feed = 'O')
    UNION ALL SELECT 'left', u FROM (SELECT l_orderkey AS u FROM i WHERE feed = 'F' EXCEPT SELECT l_orderkey FROM i WHERE feed = 'O')
    UNION ALL SELECT 'right', u FROM (SELECT l_orderkey AS u FROM i WHERE feed = 'O' EXCEPT SELECT l_orderkey FROM i WHERE feed = 'F')""", "i"))
def set_intersect_except(spark, folder):
    left, right, key, among = feed_ids(spark, folder)
    return rel.set_sides(left, right, key, out="u", among=among)


@query("union_tagged", sql(f"""SELECT source, count(*) AS n, count(DISTINCT unit) AS n_units, {t('min(start)')} AS first_start, sum(extra) AS extra FROM (
    SELECT 'F' AS source, unit, start, NULL::DOUBLE AS extra FROM i WHERE feed = 'F' UNION ALL SELECT 'O', unit, start, l_quantity FROM i WHERE feed = 'O') GROUP BY 1""", "i"))
def union_tagged(spark, folder):
    i = V.intervals(spark, folder)
    feeds = {"F": i.where("feed = 'F'").select("unit", "start"), "O": i.where("feed = 'O'").select("unit", "start", F.col("l_quantity").alias("extra"))}
    return rel.union_tagged(feeds, "source").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("n_units"), F.min("start").alias("first_start"), F.sum("extra").alias("extra"))


@query("union_drifting_schema", """SELECT l_returnflag, count(*) AS n, count(disc) AS n_disc, count(tax) AS n_tax FROM (
    SELECT l_returnflag, l_discount AS disc, NULL AS tax FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_returnflag, NULL, l_tax FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1""")
def union_drifting_schema(spark, folder):
    from hourloom.sources.readers import union_drifting_schema as stack

    li = V.table(spark, folder, "lineitem")
    both = stack([li.where("l_linestatus = 'F'").select("l_returnflag", F.col("l_discount").alias("disc")),
                  li.where("l_linestatus = 'O'").select("l_returnflag", F.col("l_tax").alias("tax"))])
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count("disc").alias("n_disc"), F.count("tax").alias("n_tax"))


@query("lookup_enum", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS label FROM orders""")
def lookup_enum(spark, folder):
    pairs = [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"), ("1-URGENT", "second text, not the first")]
    table = spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(pairs)], "value string, text string, ord int")
    o = V.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return rel.lookup_enum(o, "o_orderpriority", table, "value", "text", "ord", "label").select("o_orderkey", "label")


@query("lookup_year_map", sql(f"""SELECT row_id, k.installed FROM i LEFT JOIN (SELECT year, floor(max(mw)) AS installed FROM g GROUP BY 1) k ON k.year = year({L('start')})""", "i", "g"))
def lookup_year_map(spark, folder):
    k = V.registry(spark, folder).groupBy("year").agg(F.floor(F.max("mw")).cast("double").alias("installed"))
    i = V.intervals(spark, folder).withColumn("year", F.year(cal.wall(F.col("start"), TZ)))
    return i.join(F.broadcast(k), "year", "left").select("row_id", "installed")  # a row a year; years are too few to be shuffled by


@query("positional_ids", sql("""SELECT row_id, kind, kind || lpad(CAST(rn AS VARCHAR), CAST(greatest(3, length(CAST(rn AS VARCHAR))) AS INTEGER), '0') AS event_id FROM (
    SELECT row_id, kind, row_number() OVER (PARTITION BY kind ORDER BY start, row_id) AS rn FROM i)""", "i"))
def positional_ids(spark, folder):
    return rel.positional_ids(V.intervals(spark, folder), "kind", ["start", "row_id"], "event_id").select("row_id", "kind", "event_id")


@query("sample_head", sql("SELECT kind, string_agg(CAST(unit AS VARCHAR), ';' ORDER BY unit) AS head FROM (SELECT kind, unit, row_number() OVER (PARTITION BY kind ORDER BY unit) AS k FROM (SELECT DISTINCT kind, unit FROM i)) WHERE k <= 20 GROUP BY 1", "i"))
def sample_head(spark, folder):
    return rel.sample_head(V.intervals(spark, folder), ["kind"], "unit", 20, "head")


@query("ordered_report", sql("""SELECT unit, kind, total, n, rank() OVER (ORDER BY total, unit, kind) AS position FROM (SELECT unit, kind, sum(l_quantity) AS total, count(*) AS n FROM i GROUP BY 1, 2)""", "i"))
def ordered_report(spark, folder):
    g = V.intervals(spark, folder).groupBy("unit", "kind").agg(F.sum("l_quantity").alias("total"), F.count(F.lit(1)).alias("n"))
    return rel.ordered_report(g, ["total", "unit", "kind"])


@query("value_counts", sql("SELECT docstatus, count(*) AS n FROM v GROUP BY 1", "v"))
def value_counts(spark, folder):
    return rel.value_counts(V.revisions(spark, folder), "docstatus")


@query("distinct_pairs", sql(f"SELECT DISTINCT unit, {d('start')} AS day FROM i", "i"))
def distinct_pairs(spark, folder):
    return V.intervals(spark, folder).select("unit", F.to_date("start").alias("day")).distinct()


@query("cross_join_expand", sql(f"""SELECT event_id, {d('day')} AS day, hour, condition FROM (SELECT event_id, unnest(generate_series(
    CAST(CAST({L('start')} AS DATE) AS TIMESTAMP), CAST(CAST({L('"end"')} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM e), (SELECT unnest(range(0, 24)) AS hour),
    (SELECT unnest(['no_context', 'context', 'oracle']) AS condition)""", "e"))
def cross_join_expand(spark, folder):
    e = tl.event_days(V.curated(spark, folder), "start", "end", TZ).select("event_id", "day")
    return rel.cross_join_expand(rel.cross_join_expand(e, "hour", 24), "condition", ["no_context", "context", "oracle"])


_GREEDY = """WITH RECURSIVE o AS (SELECT unit, row_id, start, "end", row_number() OVER (PARTITION BY unit ORDER BY l_quantity DESC, row_id) AS rn FROM j),
  w AS (SELECT unit, rn, row_id, NULL::VARCHAR AS duplicate_of, [{'i': row_id, 's': start, 'e': "end"}] AS kept FROM o WHERE rn = 1
    UNION ALL SELECT o.unit, o.rn, o.row_id, list_filter(w.kept, lambda k: o.start < k.e AND k.s < o."end")[1].i,
      CASE WHEN len(list_filter(w.kept, lambda k: o.start < k.e AND k.s < o."end")) > 0 THEN w.kept ELSE list_append(w.kept, {'i': o.row_id, 's': o.start, 'e': o."end"}) END
    FROM w JOIN o ON o.unit = w.unit AND o.rn = w.rn + 1) SELECT row_id, duplicate_of FROM w"""


@query("greedy_interval_dedup", sql("SELECT row_id, duplicate_of FROM z", "i", j="SELECT * FROM i", z=_GREEDY))
def greedy_interval_dedup(spark, folder):
    i = V.intervals(spark, folder).select("unit", "row_id", "start", "end", "l_quantity")
    return iv.greedy_interval_dedup(i, ["unit"], "row_id", "start", "end", "l_quantity", bucket_days=32).select("row_id", "duplicate_of")
