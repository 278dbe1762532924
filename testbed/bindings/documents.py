"""Threads, matching, selection and text."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.functions import text as tx
from hourloom.operators import documents as dc
from hourloom.operators import intervals as iv
from hourloom.operators import matching as ma
from hourloom.operators import relations as rel
from hourloom.operators import selection as se
from hourloom.operators import timeline as tl
from hourloom.sources import readers as rd
from hourloom.sources import sinks as sk
from testbed import views as V
from testbed.registry import b, d, query, r, t
from testbed.views import TZ, sql

L = V.LOCAL.format


def periods(spark, folder):
    """Every version's own period, and for odd versions a short wrap-up period five days later."""
    m = V.messages(spark, folder)
    late = F.struct((F.col("end") + F.expr("interval 5 days")).alias("start"), (F.col("end") + F.expr("interval 6 days")).alias("end"), (F.col("mw") / 2).alias("mw"))
    own = F.struct("start", "end", "mw")
    ps = F.when(F.col("version") % 2 == 1, F.array(own, late)).otherwise(F.array(own))
    return m.select("message", "version", "unit", "published", "remarks", "role", F.explode(ps).alias("p")).select(
        "message", "version", "unit", "published", "remarks", "role", "p.start", "p.end", "p.mw")


def versions(spark, folder):
    return dc.version_record(periods(spark, folder), ["message", "version", "unit", "published", "remarks"], "start", "end", "mw")


def bare_versions(spark, folder):
    """`versions` without their text. Remarks only tell versions apart here, so their digest is moved, not the text."""
    p = periods(spark, folder).withColumn("remarks", F.sha2("remarks", 256))
    return dc.version_record(p, ["message", "version", "unit", "published", "remarks"], "start", "end", "mw").drop("remarks")


def threads_of(spark, folder):
    """The bounds of each message's newest version."""
    v = bare_versions(spark, folder)
    return ma.latest_version(v.select("message", "version", "unit", "start", "end"), ["message"], "version")


def candidates_of(i):
    i = iv.derive_reduction(i, "nominal", "avail", "start", "end")
    return i.select("row_id", "unit", "start", "end", "reduction", "kind", "feed")


def candidates(spark, folder):
    return candidates_of(V.intervals(spark, folder))


def stored_parts(spark, folder):
    """The intervals' parts, made once for all that is asked of them: lineitem and orders are shuffled once to meet."""
    return sk.made_once(V.interval_parts(spark, folder).drop("l_shipdate"))


MP = """SELECT message, version, unit, published, remarks, role, start, "end", mw FROM m
    UNION ALL SELECT message, version, unit, published, remarks, role, "end" + INTERVAL 5 DAY, "end" + INTERVAL 6 DAY, mw / 2 FROM m WHERE version % 2 = 1"""
VR = """SELECT message, version, unit, published, remarks, min(start) AS start, max("end") AS "end", max(CASE WHEN start IS NOT NULL THEN coalesce(mw, 0) END) AS mw,
    count(start) AS n_periods FROM mp GROUP BY ALL"""
CD = 'SELECT row_id, unit, start, "end", l_quantity AS reduction, kind, feed FROM i'
LV = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY version DESC) AS k FROM vr) WHERE k = 1"


def frac(a, p):
    over = f"epoch(least({a}.\"end\", {p}.\"end\") - greatest({a}.start, {p}.start))"
    return f"CASE WHEN {over} > 0 THEN {over} / least(epoch({a}.\"end\" - {a}.start), epoch({p}.\"end\" - {p}.start)) ELSE 0 END"


PR = f"SELECT cd.row_id, lv.message, {frac('cd', 'lv')} AS fraction FROM cd JOIN lv ON lv.unit = cd.unit WHERE lv.start IS NOT NULL AND {frac('cd', 'lv')} >= 0.5"
BT = f"""SELECT row_id, arg_min(message, (far, message)) AS message, min(far) AS closeness_seconds, count(*) AS n_passed FROM (
    SELECT pr.row_id, pr.message, abs(epoch(f.first - cd.start)) AS far FROM pr JOIN cd ON cd.row_id = pr.row_id
    JOIN (SELECT message, arg_min(published, version) AS first FROM vr GROUP BY 1) f ON f.message = pr.message
    WHERE EXISTS (SELECT 1 FROM mp WHERE mp.message = pr.message AND mp.start IS NOT NULL AND {frac('cd', 'mp')} >= 0.5 AND epoch(mp."end" - mp.start) <= 3 * epoch(cd."end" - cd.start))) GROUP BY 1"""
CH = dict(mp=MP, vr=VR, cd=CD, lv=LV, pr=PR, bt=BT)


@query("version_record", sql(f"""SELECT message, version, unit, {t('published')} AS published, md5(remarks) AS remarks, {t('start')} AS start, {t('"end"')} AS "end", mw, n_periods FROM vr""", "m", mp=MP, vr=VR))
def version_record(spark, folder):
    return versions(spark, folder).withColumn("remarks", F.md5("remarks"))


@query("revision_surprise", sql("""SELECT message, count(*) AS n_versions, CAST(coalesce(bool_or(sp), false) AS INTEGER) AS surprise FROM (SELECT message, "end" IS NOT NULL AND (
    coalesce(abs(epoch("end" - lag("end") OVER w)) / 3600 > 60, false) OR coalesce(abs(mw - lag(mw) OVER w) > 100, false)) AS sp FROM vr WINDOW w AS (PARTITION BY message, "end" IS NULL ORDER BY version)) GROUP BY 1""", "m", mp=MP, vr=VR))
def revision_surprise(spark, folder):
    return dc.revision_surprise(versions(spark, folder), ["message"], "version", "end", "mw", stop_hours=60.0, bucket=4)


@query("first_nonnull_version", sql("SELECT message, arg_min(role, (published, version)) FILTER (WHERE role <> 'user') AS role FROM m GROUP BY 1", "m"))
def first_nonnull_version(spark, folder):
    m = V.messages(spark, folder).withColumn("role", F.when(F.col("role") != "user", F.col("role")))
    return dc.first_nonnull_version(m, ["message"], "role", "published", "version")


# of candidates of one unit that start together, all but the first are its duplicates; feed O plays transmission
@query("interval_overlap_match", sql("""SELECT cd.row_id, cd.unit, count(pr.message) AS n_matched, min(pr.message) AS first_match, CASE WHEN dup IS NOT NULL THEN 'duplicate_of_' || dup WHEN cd.unit IN (0, 3) THEN 'excluded_unit' WHEN count(pr.message) > 0 THEN NULL
    WHEN NOT EXISTS (SELECT 1 FROM lv WHERE lv.unit = cd.unit) THEN CASE feed WHEN 'O' THEN 'no_umm_thread' ELSE 'unit_not_pulled' END ELSE 'overlap_below_50pct' END AS reason
    FROM (SELECT *, nullif(min(row_id) OVER (PARTITION BY unit, start), row_id) AS dup FROM cd) cd LEFT JOIN pr ON pr.row_id = cd.row_id AND cd.unit NOT IN (0, 3) AND dup IS NULL GROUP BY cd.row_id, cd.unit, dup, feed""", "i", "m", **CH))
def interval_overlap_match(spark, folder):
    threads = threads_of(spark, folder)
    # the parts are shuffled once by unit and start, and named where they arrive: names are longer than what they are made of
    parts = stored_parts(spark, folder).dropna(subset=["l_suppkey", "o_orderdate"]).repartition("l_suppkey", "o_orderdate")
    c = candidates_of(V.intervals_of(parts)).withColumn("first", F.min("row_id").over(Window.partitionBy("unit", "start")))
    c = c.withColumn("duplicate_of", F.nullif("first", "row_id")).withColumn("kind", F.when(F.col("feed") == "O", "transmission").otherwise("generation"))
    c = sk.made_once(c.select("row_id", "unit", "start", "end", "kind", "duplicate_of"))
    _, report = ma.interval_overlap_match(c, threads, "unit", "row_id", "message", [0, 3], "duplicate_of", kind="kind")
    return report.select("row_id", "unit", "n_matched", "first_match", "reason")


def best(spark, folder, bounds=False, among=None):
    threads = threads_of(spark, folder)
    pairs, _ = ma.interval_overlap_match(candidates(spark, folder) if among is None else among, threads, "unit", "row_id", "message", [])
    return ma.best_thread_argmin(pairs, periods(spark, folder), "row_id", "message", "version", "published", bounds=bounds)


@query("best_thread_argmin", sql("SELECT row_id, message, closeness_seconds, n_passed FROM bt", "i", "m", **CH))
def best_thread_argmin(spark, folder):
    return best(spark, folder)


@query("lead_time_hours", sql(f"SELECT cd.row_id, cd.unit, bt.message, {r('epoch(cd.start - f.first) / 3600.0')} AS lead_hours FROM bt JOIN cd ON cd.row_id = bt.row_id JOIN (SELECT message, min(published) AS first FROM m GROUP BY 1) f ON f.message = bt.message", "i", "m", **CH))
def lead_time_hours(spark, folder):
    e = candidates(spark, folder).join(best(spark, folder), "row_id")
    return dc.lead_time_hours(e, V.messages(spark, folder), "message", "start", "published").select("row_id", "unit", "message", "lead_hours")


@query("end_mismatch_check", sql(f"""SELECT cd.row_id, bt.message, {r('abs(epoch(cd."end" - x.stop)) / 3600.0')} AS end_gap_hours, {b('coalesce(abs(epoch(cd."end" - x.stop)) / 3600.0 > 6, false)')} AS end_mismatch,
    {b('coalesce(x.first < cd.start, false)')} AS had_pre_start_version, {r('wm.m')} AS window_mean, {b('coalesce(wm.m >= 0.8 * cd.reduction, false)')} AS window_ok
    FROM bt JOIN cd ON cd.row_id = bt.row_id JOIN (SELECT message, arg_max("end", published) FILTER (WHERE TRUE) AS stop, min(published) AS first FROM vr GROUP BY 1) x ON x.message = bt.message
    LEFT JOIN (SELECT cd.row_id, avg(sw.total) AS m FROM bt JOIN cd ON cd.row_id = bt.row_id JOIN sw ON sw.unit = cd.unit AND sw.ts >= cd.start AND sw.ts < cd."end" GROUP BY 1) wm ON wm.row_id = cd.row_id""", "i", "m", **CH,
    sw="""SELECT sp.unit, sp.ts, sum(coalesce(i.l_quantity, 0)) AS total FROM (SELECT k.unit, x.ts FROM (SELECT DISTINCT unit FROM i) k, (SELECT unnest(generate_series(min(start), max("end"), INTERVAL 1 HOUR)) AS ts FROM i) x) sp
        LEFT JOIN i ON i.unit = sp.unit AND i.start <= sp.ts AND sp.ts < i."end" GROUP BY 1, 2"""))
def end_mismatch_check(spark, folder):
    i = V.intervals_of(stored_parts(spark, folder))
    c = candidates_of(i)
    chosen = sk.made_once(best(spark, folder, among=c).select("row_id", "message"))
    e = sk.made_once(rel.mark_possible(c, chosen, ["row_id"], "may").where("may").drop("may").join(chosen, "row_id"))
    # only the units and hours that an event asks for; every interval starts and ends at midnight, so these are hours of the spine
    asked = ma.window_hours(e, ["unit"], "row_id").select("unit", "ts").distinct()
    # what ends before a unit's first asked hour or starts after its last adds nothing there
    reach = e.groupBy("unit").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    near = iv.derive_reduction(i, "nominal", "avail", "start", "end").join(F.broadcast(reach), "unit").where("start < z and end > a")
    total = iv.sweep_line_sum(near, ["unit"], "start", "end", "reduction", asked)
    means = ma.window_mean(e, total, ["unit"], "row_id", "ts", "total", "1 hour")
    return ma.end_mismatch_check(e, bare_versions(spark, folder), means, "row_id", "message", "reduction")


ED = f"""SELECT row_id AS event_id, message, unnest(generate_series(CAST(CAST({L('start')} AS DATE) AS TIMESTAMP), CAST(CAST({L('"end"')} AS DATE) AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS day
    FROM (SELECT cd.*, bt.message FROM bt JOIN cd ON cd.row_id = bt.row_id)"""
AD = f"""SELECT ed.event_id, ed.day, m.message, m.version, m.published, m.remarks FROM ed JOIN m ON m.message = ed.message
    WHERE m.published <= timezone('UTC', timezone('{TZ}', ed.day - INTERVAL 12 HOUR))"""


def matched_events(spark, folder):
    return best(spark, folder, bounds=True).select(F.col("row_id").alias("event_id"), "message", "start", "end")


@query("asof_document_set", sql(f"SELECT event_id, {d('day')} AS day, message, version, {t('published')} AS published FROM ad", "i", "m", **CH, ed=ED, ad=AD))
def asof_document_set(spark, folder):
    versions = V.messages(spark, folder).select("message", "version", "published")
    known = dc.asof_event_documents(matched_events(spark, folder), versions, "message", TZ, "start", "end")
    return known.select("event_id", "day", "message", "version", "published")


@query("assemble_context", sql(f"""SELECT event_id, {d('day')} AS day, count(*) AS n_documents, md5(string_agg('--- version ' || version || ' | published ' || {t('published')} || ' ---' || chr(10) || regexp_replace(remarks, '^\\s+|\\s+$', '', 'g'),
    chr(10) || chr(10) ORDER BY published, version)) AS context FROM ad GROUP BY 1, 2""", "i", "m", **CH, ed=ED, ad=AD))
def assemble_context(spark, folder):
    versions = V.messages(spark, folder).select("message", "version", "published", "remarks")
    contexts = dc.event_day_contexts(matched_events(spark, folder), versions, "message", TZ, "event_id", "start", "end", "published", "version", "remarks")
    return contexts.withColumn("context", F.md5("context"))


# Message files made from the conversations: every turn is a version with one to three production units, of which the third has no periods; odd conversations also
# have a border; conversations divisible by 11 have no units at all. Periods start at the version's own times; a missing time is an absent field.
def message_files(spark, folder):
    """Written as lines of JSON and read back with the readers' schema."""
    m = V.messages(spark, folder)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = lambda c, k: c + F.make_dt_interval((k * 2).cast("int"))
    period = lambda k, j: F.struct(
        (F.col("mw") * j).alias("unavailableCapacity"), F.when(j != 2, F.lit(7.0) + k).alias("availableCapacity"),
        iso(later(F.col("start"), j + k)).alias("eventStart"), iso(later(F.col("end"), j)).alias("eventStop"))
    periods_of = lambda k: F.when(k < 3, F.transform(F.sequence(F.lit(1), F.lit(1) + F.col("version").cast("int") % 2), lambda j: period(k, j)))
    units = F.transform(F.sequence(F.lit(1), F.lit(1) + F.col("message").cast("int") % 3), lambda k: F.struct(
        F.concat(F.lit("unit-"), F.col("unit"), F.lit("/"), k).alias("name"), F.concat(F.lit("E"), F.col("unit"), F.lit("-"), k).alias("eic"), periods_of(k).alias("timePeriods")))
    border = F.array(F.struct(F.lit("border").alias("name"), F.lit("A").alias("inAreaEic"), F.concat(F.lit("B"), F.col("unit")).alias("outAreaEic"), periods_of(F.lit(0)).alias("timePeriods")))
    rows = m.select(
        F.concat(F.lit("m"), "message").alias("messageId"), F.col("version").cast("int").alias("version"), iso("published").alias("publicationDate"),
        F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).alias("unavailabilityType"), F.col("role").alias("unavailabilityReason"), "remarks",
        F.when(F.col("message") % 11 != 0, units).alias("productionUnits"), F.when((F.col("message") % 11 != 0) & (F.col("message") % 2 == 1), border).alias("transmissionUnits"))
    path = sk.scratch_folder(spark)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return rd.scan_messages(spark, path, multiline=False)


_ISO = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"
NESTED = dict(
    un="""SELECT m.*, k, 'generation' AS mkind, 'unit-' || unit || '/' || k AS uname, 'E' || unit || '-' || k AS ueic FROM m, (SELECT unnest([1, 2, 3]) AS k) WHERE message % 11 <> 0 AND k <= 1 + message % 3
        UNION ALL SELECT m.*, 0, 'transmission', 'border', 'A>B' || unit FROM m WHERE message % 11 <> 0 AND message % 2 = 1""",
    up="""SELECT un.*, j, CASE WHEN j IS NOT NULL THEN mw * j END AS pmw, CASE WHEN j <> 2 THEN 7.0 + k END AS pav, start + CAST(2 * (j + k) AS INTEGER) * INTERVAL 1 DAY AS pstart, "end" + CAST(2 * j AS INTEGER) * INTERVAL 1 DAY AS pend
        FROM un LEFT JOIN (SELECT unnest([1, 2]) AS j) p ON k < 3 AND j <= 1 + version % 2""",
)


@query("render_document", sql(f"""SELECT message, version, kind, n_units, md5(concat_ws(chr(10), 'Event: E' || message || ' (unit-' || unit || ', ' || kind || ')', 'Message: m' || message || ' version ' || version, 'Published: ' || {_ISO('published')},
    'Unavailability type: ' || CASE role WHEN 'user' THEN 'planned' WHEN 'assistant' THEN 'unplanned' ELSE 'None' END, 'Reason code: None', 'Unavailability reason: ' || role, '', 'Time periods:', lines, '', 'Remarks:', CASE WHEN remarks = '' THEN '(none)' ELSE remarks END)) AS body FROM (
    SELECT message, version, unit, published, remarks, role, mkind AS kind, count(*) AS n_units, string_agg(concat_ws(chr(10), '  Unit/border: ' || uname, lines), chr(10) ORDER BY k) AS lines FROM (
      SELECT message, version, unit, published, remarks, role, mkind, k, uname, string_agg('    ' || coalesce({_ISO('pstart')}, 'None') || ' -> ' || coalesce({_ISO('pend')}, 'None') || ': unavailable ' || coalesce(CAST(pmw AS VARCHAR), 'None') || ' MW, available ' || coalesce(CAST(pav AS VARCHAR), 'None') || ' MW',
        chr(10) ORDER BY j) FILTER (WHERE j IS NOT NULL) AS lines FROM up GROUP BY ALL) GROUP BY ALL)""", "m", **NESTED))
def render_document(spark, folder):
    own = V.messages(spark, folder).select(F.concat(F.lit("m"), "message").alias("messageId"), F.col("version").cast("int").alias("version"), "message", "unit").distinct()
    v = rd.message_units(message_files(spark, folder)).join(own, ["messageId", "version"])
    kinds = F.when(F.col("unavailabilityType") == 1, "planned").when(F.col("unavailabilityType") == 2, "unplanned")
    v = v.select("message", F.col("messageId").alias("thread"), "version", "kind", "units", "remarks", F.concat(F.lit("E"), "message").alias("event_id"), F.concat(F.lit("unit-"), "unit").alias("unit_name"),
                 F.col("publicationDate").alias("published_text"), F.col("unavailabilityReason").alias("reason"), F.col("reasonCode").alias("reason_code_text"), kinds.alias("type_text"))
    text = dc.render_document(v.withColumnRenamed("message", "number").withColumnRenamed("thread", "message"))
    return text.select(F.col("number").alias("message"), "version", "kind", F.size("units").alias("n_units"), F.md5("body").alias("body"))


@query("content_key", """SELECT doc_id, sha256('["' || lang || '","' || source || '","' || n_chars || '"]') AS key, CAST(doc_id % 4 = 0 AS INTEGER) AS cache_hit, CASE WHEN doc_id % 4 = 0 THEN lang END AS answer FROM documents""")
def content_key(spark, folder):
    docs = V.table(spark, folder, "documents")
    key = dc.content_key(F.col("lang"), F.col("source"), F.col("n_chars"))
    req = docs.select("doc_id", key.alias("key"))
    marked = docs.select(dc.content_key(F.col("doc_id"), F.col("lang")).alias("request"), "doc_id", "lang", key.alias("key"))
    cache = marked.where("doc_id % 4 = 0").select("request", F.col("lang").alias("answer"))
    hit = dc.cache_lookup(marked.select("request", "doc_id"), cache, "request")
    return req.join(hit.select("doc_id", "answer", "cache_hit"), "doc_id")


_EN = "['" + "', '".join(tx.ENGLISH_WORDS) + "']"
_FR = ["le", "la", "de", "un", "des", "que", "qui", "dans"]
_LANG = f"""SELECT lang, doc_id, tx, tok, len(list_intersect(tok, {_FR})) AS fh, len(list_intersect(tok, {_EN})) AS eh, regexp_matches(lower(tx), '[éèêç]') AS mk FROM (
    SELECT lang, doc_id, tx, list_filter(list_distinct(regexp_split_to_array(translate(lower(tx), '.,', '  '), '\\s+')), lambda w: w <> '') AS tok FROM (SELECT lang, doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS tx FROM (SELECT lang, doc_id, text FROM documents UNION ALL SELECT 'en', -1, '' UNION ALL SELECT 'en', -2, chr(10) || ' ' || chr(10) UNION ALL SELECT 'fr', -3, NULL)))"""


@query("language_heuristic", sql(f"""SELECT lang, count(*) AS n_total, count(*) FILTER (WHERE tx = '') AS n_empty, count(*) FILTER (WHERE tx <> '' AND NOT (mk OR fh > eh)) AS n_english, count(*) FILTER (WHERE tx <> '' AND (mk OR fh > eh)) AS n_foreign,
    count(*) FILTER (WHERE tx <> '' AND fh = 0 AND eh = 0 AND NOT mk AND len(tok) < 3) AS n_ambiguous, {r("count(*) FILTER (WHERE tx <> '' AND NOT (mk OR fh > eh)) / nullif(count(*) FILTER (WHERE tx <> ''), 0)")} AS share_english FROM lg GROUP BY 1""", lg=_LANG))
def language_heuristic(spark, folder):
    # texts without a word, added to the table's own
    blank = spark.createDataFrame([("en", ""), ("en", "\n \n"), ("fr", None)], "lang string, text string")
    docs = V.table(spark, folder, "documents").select("lang", "text").unionByName(blank)
    labelled = docs.select("lang", tx.language_label(F.col("text"), _FR, tx.ENGLISH_WORDS, "éèêç").alias("x")).select("lang", "x.label", "x.ambiguous")
    return dc.language_shares(labelled, ["lang"])


@query("unit_name_match", """SELECT s_suppkey, coalesce(min(c_custkey), (SELECT min(c_custkey) FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')) AS c_custkey, CAST(min(c_custkey) IS NOT NULL AS INTEGER) AS matched
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 7 END AS unit, CASE WHEN s_suppkey % 5 = 0 THEN 'no such unit' WHEN s_suppkey % 7 = 0 THEN '77' ELSE substr(s_name, 10) END AS name FROM supplier) s
    LEFT JOIN customer ON s.unit = c_custkey OR contains(lower(c_name), lower(s.name)) GROUP BY 1""")
def unit_name_match(spark, folder):
    s = V.table(spark, folder, "supplier")
    name = F.when(F.col("s_suppkey") % 5 == 0, "no such unit").when(F.col("s_suppkey") % 7 == 0, "77").otherwise(F.substring("s_name", 10, 100))
    outages = s.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") * 7).alias("unit"), name.alias("name"))
    c = V.table(spark, folder, "customer")
    remarks = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment"))
    messages = c.select("c_custkey", F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("unit"), F.col("c_name").alias("name"), remarks.alias("remarks"))
    return ma.unit_name_match(outages, messages, "s_suppkey", "c_custkey", "ord", "unit", "name", "remarks")


def effect_json(event_col, reduction, seed):
    """Effects as JSON text; every seventh one breaks a rule in its own way."""
    q = reduction
    head = F.format_string('{"reasoning": "%s", "p_active": %.2f, "start_hour": {"mean": %.1f, "sd": 1.5}, "end_hour": {"mean": %.1f, "sd": 2.0}, ',
                           event_col, (seed % 10) / F.lit(10.0), (seed % 20).cast("double"), (seed % 20 + 4).cast("double"))
    sizes = F.format_string('"size_mw": {"p10": %.1f, "p50": %.1f, "p90": %.1f}, "direction": "%s"}', q * 0.5, q, q * F.when(seed % 11 == 5, 0.9).otherwise(1.5),
                            F.when(seed % 13 == 4, "increase").when(seed % 6 == 2, "none").otherwise("reduce"))
    sizes = F.when(seed % 17 == 3, F.regexp_replace(sizes, "}$", ', "note": "x"}')).otherwise(sizes)
    return F.concat(head, sizes)


@query("validate_effect", sql(f"""SELECT event_id, CASE WHEN q % 17 = 3 THEN 'unexpected keys' WHEN q % 11 = 5 THEN 'invalid size_mw' WHEN q % 13 = 4 THEN 'invalid direction' END AS reason,
    {r('(q % 10) / 10.0')} AS p_active, {r('reduction')} AS p50 FROM (SELECT *, CAST(epoch(start) / 3600 AS BIGINT) AS q FROM e)""", "e"))
def validate_effect(spark, folder):
    e = V.curated(spark, folder)
    seed = F.floor(F.unix_seconds("start") / 3600)
    out = dc.validate_effect(e.withColumn("json", effect_json(F.col("event_id"), F.col("reduction"), seed)), "json")
    return out.select("event_id", "reason", "effect.p_active", "effect.size_mw.p50")


# ------------------------------------------------------------- selection
POOL = f"""SELECT row_id, unit, l_quantity AS size, CASE WHEN feed = 'F' THEN 'generation' ELSE 'transmission' END AS kind, kind AS business, {b(f"month({L('start')}) IN (4, 5, 6)")} = 1 AS flood,
    CASE WHEN month({L('start')}) IN (12, 1, 2) THEN 'winter' WHEN month({L('start')}) IN (3, 4, 5) THEN 'spring' WHEN month({L('start')}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM i"""


def pool(spark, folder):
    m = F.month(cal.wall(F.col("start"), TZ))
    return V.intervals(spark, folder).select(
        "row_id", "unit", F.col("l_quantity").alias("size"), F.when(F.col("feed") == "F", "generation").otherwise("transmission").alias("kind"),
        F.col("kind").alias("business"), cal.spring_flood(m).alias("flood"), cal.season(m).alias("season"))


def _step(k, mask, n, cap):
    prev = f"SELECT * FROM s{k - 1} UNION ALL " if k > 1 else ""
    anti = f"AND row_id NOT IN (SELECT row_id FROM s{k - 1})" if k > 1 else ""
    used = f"coalesce((SELECT count(*) FROM s{k - 1} u WHERE u.unit = q.unit), 0)" if k > 1 else "0"
    return f"""{prev} SELECT * FROM (SELECT row_id, unit, size, season, flood, kind, business FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY size DESC, row_id) AS rn FROM pool WHERE {mask} {anti}) q
        WHERE rn <= {cap} - {used} ORDER BY size DESC, row_id LIMIT {n})"""


_SEASONS = ["winter", "spring", "summer", "autumn"]
_CHAIN = {f"s{k}": _step(k, f"kind = 'generation' AND season = '{s}'", 8, 3) for k, s in enumerate(_SEASONS, 1)}
_CHAIN["s5"] = _step(5, "kind = 'generation'", 12, 3)


def chain(spark, folder):
    p = pool(spark, folder)
    strata = [((F.col("kind") == "generation") & (F.col("season") == s), 8, 3) for s in _SEASONS]
    return p, se.topk_per_stratum_capped(p, [*strata, (F.col("kind") == "generation", 12, 3)], "row_id", "unit", "size")


@query("topk_per_stratum_capped", sql("SELECT row_id, unit, size, season FROM s5", "i", pool=POOL, **_CHAIN))
def topk_per_stratum_capped(spark, folder):
    return chain(spark, folder)[1].select("row_id", "unit", "size", "season")


@query("topk_swap_quota", sql("""SELECT row_id, unit, size, business FROM s5 WHERE row_id NOT IN (SELECT o FROM sw) UNION ALL SELECT row_id, unit, size, business FROM sw""", "i", pool=POOL, **_CHAIN,
    sw="""SELECT f.row_id, f.unit, f.size, f.business, w.row_id AS o FROM (SELECT *, row_number() OVER (ORDER BY size DESC, row_id) AS k FROM pool WHERE business = 'R' AND kind = 'generation' AND row_id NOT IN (SELECT row_id FROM s5)) f
        JOIN (SELECT *, row_number() OVER (ORDER BY size, row_id) AS k FROM s5 WHERE business <> 'R') w ON w.k = f.k WHERE f.k <= 25 - (SELECT count(*) FROM s5 WHERE business = 'R')"""))
def topk_swap_quota(spark, folder):
    p, selected = chain(spark, folder)
    return se.topk_swap_quota(p.where("kind = 'generation'"), selected, F.col("business") == "R", 25, "row_id", "size").select("row_id", "unit", "size", "business")


@query("topk_swap_same_kind", sql("""SELECT x.row_id, x.unit, x.size, x.kind, x.business, CAST(x.flood AS INTEGER) AS flood FROM (SELECT unnest(sel) AS x FROM (SELECT sel FROM sw ORDER BY k DESC LIMIT 1))""",
    "i", pool=POOL, **_CHAIN,
    cd0="SELECT row_id, unit, size, kind, business, flood FROM pool WHERE flood AND row_id NOT IN (SELECT row_id FROM s5)",
    sw="""WITH RECURSIVE w AS (SELECT 0 AS k, -1e300 AS s, '' AS i, (SELECT list(struct_pack(row_id := row_id, unit := unit, size := size, kind := kind, business := business, flood := flood)) FROM s5) AS sel
        UNION ALL SELECT k + 1, -nx.size, nx.row_id, list_append(list_filter(sel, lambda x: x.row_id <> o), nx) FROM (
          SELECT *, list_sort(list_transform(list_filter(sel, lambda x: NOT x.flood AND x.kind = nx.kind AND x.business = nx.business), lambda x: struct_pack(size := x.size, row_id := x.row_id)))[1].row_id AS o FROM (
            SELECT w.*, (SELECT arg_min(struct_pack(row_id := c.row_id, unit := c.unit, size := c.size, kind := c.kind, business := c.business, flood := c.flood), (-c.size, c.row_id)) FROM cd0 c
              WHERE (-c.size > w.s OR (-c.size = w.s AND c.row_id > w.i)) AND NOT (c.kind = 'generation' AND len(list_filter(w.sel, lambda x: x.unit = c.unit)) >= 3)
              AND len(list_filter(w.sel, lambda x: NOT x.flood AND x.kind = c.kind AND x.business = c.business)) > 0) AS nx FROM w WHERE k < 8) WHERE nx IS NOT NULL)) SELECT * FROM w"""))
def topk_swap_same_kind(spark, folder):
    p, selected = chain(spark, folder)
    have = selected.where("flood").count()
    out = se.topk_swap_same_kind(p, selected, F.col("flood"), have + 8, "row_id", "unit", "size", ["kind", "business"], F.col("kind") == "generation", 3)
    return out.select("row_id", "unit", "size", "kind", "business", "flood")


# ---------------------------------------------------------- nested records
@query("scan_nested_messages", sql(f"""SELECT 'm' || message AS message, version, {t('published')} AS published, md5(remarks) AS remarks, mkind AS kind, uname AS unit_name, ueic AS unit, {t('pstart')} AS start, {t('pend')} AS "end", {r('pmw')} AS mw, {r('pav')} AS available FROM up""", "m", **NESTED))
def scan_nested_messages(spark, folder):
    flat = rd.explode_messages(message_files(spark, folder))
    return flat.withColumnRenamed("messageId", "message").withColumn("remarks", F.md5("remarks"))
