"""The test tables in the roles the operators expect (see FIXTURES.md), in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import timeline as tl

TZ = "Europe/Stockholm"
TARGET = "purchase"
EXOG = ["click", "error", "signup", "view"]
SERIES = [*EXOG, TARGET]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; wall-clock columns are read as UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(
        *[F.col(c).cast("timestamp").alias(c) if typ == "timestamp_ntz" else F.col(c) for c, typ in df.dtypes]
    )


# ------------------------------------------------------------------ Spark
def raw_series(spark, folder):
    return table(spark, folder, "events").select(F.col("event_type").alias("series"), "ts", "value", "event_id")


def spine(spark, folder):
    return tl.hour_spine(tl.bounds_of(raw_series(spark, folder), ["series"], "ts"), "start", "end")


def hourly(spark, folder):
    s = raw_series(spark, folder)
    return tl.resample_mean(s, ["series"], "ts", "value", spine(spark, folder))


def filled(spark, folder):
    return tl.ffill_columns(hourly(spark, folder), ["series"], "ts", ["value"])


ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def interval_parts(spark, folder):
    """What `intervals` is made of. A row's name needs the day and the cents only, fewer bytes to shuffle than the columns they are taken from."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    li = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate",
        F.to_date("l_shipdate").alias("ship_day"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    return li.join(o.select("o_orderkey", "o_orderdate"), li.l_orderkey == F.col("o_orderkey")).drop("o_orderkey")


def intervals_of(parts):
    """The intervals made of these parts, which may have been shuffled or stored as such; with l_shipdate if they have it."""
    start = F.col("o_orderdate")
    return parts.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    F.date_format("ship_day", "yyyyMMdd"), F.col("cents").cast("string")).alias("row_id"),
        F.col("l_suppkey").alias("unit"),
        start.alias("start"),
        (start + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("end"),
        F.lit(50.0).alias("nominal"),
        (F.lit(50.0) - F.col("l_quantity")).alias("avail"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("feed"),
        "l_quantity",
        *[c for c in parts.columns if c == "l_shipdate"],
        "l_orderkey",
        "l_linenumber",
    )


def intervals(spark, folder):
    return intervals_of(interval_parts(spark, folder))


def revisions(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("mrid"), F.col("l_linenumber").alias("revision"),
        F.when(F.col("l_returnflag") == "R", "Cancelled").when(F.col("l_returnflag") == "A", "Active").alias("docstatus"),
        F.col("l_shipdate").alias("period"), F.col("l_suppkey").alias("unit"), F.col("l_linestatus").alias("feed"),
        F.col("l_quantity").alias("qty"),
    )


def registry(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("mw"),
        "o_orderdate", "o_orderkey",
    )


def unit_bounds(spark, folder):
    """Per unit, whole days around its intervals."""
    i = intervals(spark, folder)
    return i.groupBy("unit").agg(F.min("start").alias("a"), F.max("end").alias("b"))


def messages(spark, folder):
    """One row per (message, version); bounds are missing for role 'system'."""
    m = table(spark, folder, "conversations")
    n_units = table(spark, folder, "lineitem").agg(F.countDistinct("l_suppkey").alias("n")).scalar()
    base = F.timestamp_seconds(F.lit(883612800) + F.col("conv_id") * 3 * 86400)  # 1998-01-01 + 3 days each
    has = F.col("role") != "system"
    return m.select(
        F.col("conv_id").alias("message"), F.col("turn").alias("version"), "role", F.col("text").alias("remarks"),
        F.pmod(F.col("conv_id"), n_units).alias("unit"),
        F.when(has, base).alias("start"),
        F.when(has, base + F.make_dt_interval((F.lit(10) + F.col("turn") * 2).cast("int"))).alias("end"),
        F.when(has, F.lit(50.0) + F.pmod(F.length("text"), F.lit(400))).alias("mw"),
        (base + F.make_dt_interval(F.lit(-1), (F.col("turn") * 6).cast("int"))).alias("published"),
    )


def conditions(spark, folder):
    """Day D as truth, D-1 without context, D-2 with context, their mean as oracle; long form."""
    w = wide_conditions(spark, folder)
    return w.select(
        "event_id", "day", "hour", "y",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("point")) for c in
                      ("no_context", "context", "oracle")])
        ).alias("c"),
    ).select("event_id", "day", "hour", "y", "c.condition", "c.point")


def wide_conditions(spark, folder):
    from hourloom.operators import features as ft

    h = ft.day_hour_profile(hourly(spark, folder), ["series"], "ts", "value", TZ)
    lagged = ft.lag_day_join(h, ["series"], "value", [1, 2])
    return lagged.select(
        F.col("series").alias("event_id"), "day", "hour", F.col("value").alias("y"),
        F.col("lag1").alias("no_context"), F.col("lag2").alias("context"),
        ((F.col("lag1") + F.col("lag2")) / 2).alias("oracle"),
    )


def curated(spark, folder):
    """One event per (unit, kind, feed) of the whole interval table, placed inside the series' month."""
    q = F.sum(F.col("l_quantity").cast("bigint"))
    g = intervals(spark, folder).groupBy("unit", "kind", "feed").agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    start = F.timestamp_seconds(F.lit(1704412800) + F.pmod("q", F.lit(432)) * 3600)  # 2024-01-05 + hours
    return g.select(
        F.concat_ws("-", F.col("unit").cast("string"), "kind", "feed").alias("event_id"),
        F.when(F.col("feed") == "F", "generation").otherwise("transmission").alias("kind"),
        F.when(F.col("feed") == "F", "error").otherwise("signup").alias("driver"),
        (F.pmod("q", F.lit(97)) + 1).cast("double").alias("reduction"),
        start.alias("start"),
        F.timestamp_seconds(F.unix_seconds(start) + (F.pmod("n", F.lit(47)) + 2) * 3600).alias("end"),
    )


# -------------------------------------------------------------------- SQL
LOCAL = "timezone('Europe/Stockholm', timezone('UTC', {}))"

CTES: dict[str, tuple[list[str], str]] = {
    "s": ([], "SELECT event_type AS series, ts, value, event_id FROM events"),
    "spine": (["s"], """SELECT k.series, x.ts FROM (SELECT DISTINCT series FROM s) k,
        (SELECT unnest(generate_series(min(date_trunc('day', ts)),
                max(date_trunc('day', ts)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts FROM s) x"""),
    "h": (["s", "spine"], """SELECT p.series, p.ts, m.value FROM spine p LEFT JOIN
        (SELECT series, date_trunc('hour', ts) AS ts, avg(value) AS value FROM s GROUP BY 1, 2) m
        ON m.series = p.series AND m.ts = p.ts"""),
    "hf": (["h"], """SELECT series, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM h"""),
    "i": ([], """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_id,
        l_suppkey AS unit, o_orderdate AS start, o_orderdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY AS "end",
        50.0::DOUBLE AS nominal, 50.0 - l_quantity AS avail, l_returnflag AS kind, l_linestatus AS feed, l_quantity,
        l_shipdate, l_orderkey, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "v": ([], """SELECT l_orderkey AS mrid, l_linenumber AS revision,
        CASE l_returnflag WHEN 'R' THEN 'Cancelled' WHEN 'A' THEN 'Active' END AS docstatus,
        l_shipdate AS period, l_suppkey AS unit, l_linestatus AS feed, l_quantity AS qty FROM lineitem"""),
    "g": ([], """SELECT o_custkey AS unit, year(o_orderdate) AS year, o_totalprice AS mw, o_orderdate, o_orderkey
        FROM orders"""),
    "m": ([], """SELECT conv_id AS message, turn AS version, role, text AS remarks,
        conv_id % (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS unit,
        CASE WHEN role <> 'system' THEN TIMESTAMP '1998-01-01' + CAST(3 * conv_id AS INTEGER) * INTERVAL 1 DAY END AS start,
        CASE WHEN role <> 'system' THEN TIMESTAMP '1998-01-01'
            + CAST(3 * conv_id + 10 + 2 * turn AS INTEGER) * INTERVAL 1 DAY END AS "end",
        CASE WHEN role <> 'system' THEN 50.0 + (length(text) % 400) END::DOUBLE AS mw,
        TIMESTAMP '1998-01-01' + CAST(3 * conv_id - 1 AS INTEGER) * INTERVAL 1 DAY
            + CAST(6 * turn AS INTEGER) * INTERVAL 1 HOUR AS published FROM conversations"""),
    # local day/hour profile of the hourly table: first of a repeated hour
    "p": (["h"], f"""SELECT series, day, hour, value FROM (
        SELECT series, CAST({LOCAL.format('ts')} AS DATE) AS day, hour({LOCAL.format('ts')}) AS hour, value,
            row_number() OVER (PARTITION BY series, CAST({LOCAL.format('ts')} AS DATE), hour({LOCAL.format('ts')})
                ORDER BY ts) AS rn FROM h) WHERE rn = 1"""),
    "pf": (["hf"], f"""SELECT series, day, hour, value FROM (
        SELECT series, CAST({LOCAL.format('ts')} AS DATE) AS day, hour({LOCAL.format('ts')}) AS hour, value,
            row_number() OVER (PARTITION BY series, CAST({LOCAL.format('ts')} AS DATE), hour({LOCAL.format('ts')})
                ORDER BY ts) AS rn FROM hf) WHERE rn = 1"""),
    "slots": (["p"], """SELECT x.series, x.day, CAST(k.hour AS BIGINT) AS hour, p.value FROM (SELECT DISTINCT series, day FROM p) x
        CROSS JOIN (SELECT unnest(range(0, 24)) AS hour) k
        LEFT JOIN p ON p.series = x.series AND p.day = x.day AND p.hour = k.hour"""),
    "cw": (["slots"], """SELECT a.series AS event_id, a.day, a.hour, a.value AS y, b.value AS no_context,
        c.value AS context, (b.value + c.value) / 2 AS oracle FROM slots a
        LEFT JOIN slots b ON b.series = a.series AND b.day = a.day - 1 AND b.hour = a.hour
        LEFT JOIN slots c ON c.series = a.series AND c.day = a.day - 2 AND c.hour = a.hour"""),
    "c": (["cw"], """SELECT event_id, day, hour, y, 'no_context' AS condition, no_context AS point FROM cw
        UNION ALL SELECT event_id, day, hour, y, 'context', context FROM cw
        UNION ALL SELECT event_id, day, hour, y, 'oracle', oracle FROM cw"""),
    "e": (["i"], """SELECT concat_ws('-', unit, kind, feed) AS event_id,
        CASE WHEN feed = 'F' THEN 'generation' ELSE 'transmission' END AS kind,
        CASE WHEN feed = 'F' THEN 'error' ELSE 'signup' END AS driver,
        (q % 97 + 1)::DOUBLE AS reduction,
        TIMESTAMP '2024-01-05' + CAST(q % 432 AS INTEGER) * INTERVAL 1 HOUR AS start,
        TIMESTAMP '2024-01-05' + CAST(q % 432 + n % 47 + 2 AS INTEGER) * INTERVAL 1 HOUR AS "end"
        FROM (SELECT unit, kind, feed, sum(CAST(l_quantity AS BIGINT))::BIGINT AS q, count(*) AS n FROM i GROUP BY 1, 2, 3)"""),
}


def sql(body: str, *names: str, **extra: str) -> str:
    """`body` after the named common tables (with what they need), then the `extra` ones in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in CTES[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
