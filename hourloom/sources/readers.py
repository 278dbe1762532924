"""Landed files -> DataFrames, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PERIOD = "array<struct<unavailableCapacity:double,availableCapacity:double,eventStart:string,eventStop:string>>"
MESSAGE_SCHEMA = (
    "messageId string, version int, publicationDate string, messageType int, isOutdated boolean, "
    "unavailabilityType int, reasonCode int, eventStatus int, unavailabilityReason string, remarks string, "
    "productionUnits array<struct<name:string,eic:string,fuelType:int,areaEic:string,areaName:string,"
    f"installedCapacity:double,timePeriods:{_PERIOD}>>, "
    "transmissionUnits array<struct<name:string,inAreaEic:string,inAreaName:string,outAreaEic:string,"
    f"outAreaName:string,installedCapacity:double,timePeriods:{_PERIOD}>>"
)


def parse_offset_timestamp(text: Column) -> Column:
    """Text with its own UTC offset -> instant; anything unparsable becomes NULL."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def parse_iso_utc(text: Column) -> Column:
    """ISO time with up to nine fraction digits and an optional Z, read as UTC."""
    trimmed = F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"(\.\d{6})\d+$", "$1")
    return F.try_to_timestamp(trimmed)


def scan_chunked_series(
    spark: SparkSession, folder: str, schema: T.StructType | str, index: str = "ts", keys: list[str] | None = None,
    full_row: bool = False,
) -> DataFrame:
    """All CSV chunks below a folder. The file path breaks ties, so the first chunk wins.

    `full_row` drops only rows equal in every column but the index, for feeds whose index repeats.
    """
    from hourloom.operators import timeline

    files = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    raw = files.option("pathGlobFilter", "*.csv").csv(folder).select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    )
    raw = raw.withColumn(index, F.coalesce(parse_offset_timestamp(F.col(index)), F.try_to_timestamp(index)))
    order = ["__file", "__block", "__row"]
    dedup = timeline.dedup_full_row if full_row else timeline.dedup_index_first
    return dedup(raw, [*(keys or []), index], order).drop(*order)


def union_drifting_schema(frames: list[DataFrame]) -> DataFrame:
    """Stack frames whose columns differ; missing ones become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_snapshot_by_year(
    spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = r"(\d{4})\.csv$"
) -> DataFrame:
    """Yearly snapshot files; the part of the path that `pattern` captures becomes `query_year`."""
    files = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
    rows = files.option("pathGlobFilter", "*.csv").csv(folder)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int").alias("query_year"))


def scan_messages(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Message versions with their nested units and periods; fields outside the schema are not read, absent ones are NULL.

    `multiline`: a file is one message or one list of messages; else every line is a message, and large files are split.
    """
    return spark.read.schema(MESSAGE_SCHEMA).option("multiLine", multiline).json(path)


def scan_event_file(spark: SparkSession, path: str, item_schema: str, bundled: bool = False) -> DataFrame:
    """JSON payloads that are either a list of events or an object holding one under `events`.

    A file is one payload; if `bundled`, every line is one, so that many payloads need few files.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=not bundled)
    as_list = F.from_json("value", f"array<{item_schema}>")
    as_object = F.from_json("value", f"struct<events:array<{item_schema}>>").getField("events")
    items = F.when(F.ltrim(F.col("value")).startswith("["), as_list).otherwise(as_object)
    return text.select(F.inline(items))


def scan_documents(
    spark: SparkSession, folder: str, pattern: str = r"([^/]+)/([^/]+)_v(\d+)\.txt$", bundled: bool = False
) -> DataFrame:
    """One text file per (event, message, version), told from the path by the pattern's three groups.

    A file costs milliseconds to list and open however short it is. If `bundled`, files are lines of JSON, each with the `path` that a document would have and
    its `text`, so that many documents need few files; a line that is no JSON fails the read.
    """
    files = spark.read.option("recursiveFileLookup", True)
    if bundled:
        rows = files.schema("path string, text string").option("mode", "FAILFAST").json(folder).select("path", F.col("text").alias("value"))
    else:
        rows = files.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    part = lambda i: F.regexp_extract("path", pattern, i)
    return rows.select(
        part(1).alias("event_id"), part(2).alias("message"), part(3).cast("int").alias("version"),
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("body"),
    )


# How a chunk's file suffix tells its outcome.
OUTCOME_SUFFIXES = {"ok": ".csv", "empty": ".empty", "error": ".error.json"}


def chunk_outcomes(
    spark: SparkSession, root: str, suffixes: dict[str, str] = OUTCOME_SUFFIXES, series: str = r"([^/]+)/[^/]+$"
) -> DataFrame:
    """Per series folder, how many chunks succeeded, were empty, or failed. Only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    kind = F.lit(None).cast("string")
    for name, suffix in suffixes.items():
        kind = F.when(F.col("path").endswith(suffix), name).otherwise(kind)
    named = files.select(F.regexp_extract("path", series, 1).alias("series"), kind.alias("kind")).where("kind is not null")
    return named.groupBy("series").pivot("kind", list(suffixes)).agg(F.count(F.lit(1))).na.fill(0)


def message_units(messages: DataFrame) -> DataFrame:
    """One row per (message, version, kind) that has units: units ARRAY<STRUCT<name, unit, periods ARRAY<STRUCT<start, end, mw, available>>>>, in the message's order.

    The bounds stay as the text they came in, as a rendered document shows them; absent periods are an empty list.
    """
    period = lambda p: F.struct(
        p["eventStart"].alias("start"), p["eventStop"].alias("end"), p["unavailableCapacity"].alias("mw"), p["availableCapacity"].alias("available"))
    none = F.expr("cast(array() as array<struct<start:string,end:string,mw:double,available:double>>)")
    unit = lambda name: lambda u: F.struct(
        u["name"].alias("name"), name(u).alias("unit"), F.coalesce(F.transform(u["timePeriods"], period), none).alias("periods"))
    kinds = F.array(
        F.struct(F.lit("generation").alias("kind"), F.transform("productionUnits", unit(lambda u: u["eic"])).alias("units")),
        F.struct(F.lit("transmission").alias("kind"), F.transform("transmissionUnits", unit(lambda u: F.concat_ws(">", u["inAreaEic"], u["outAreaEic"]))).alias("units")),
    )
    return messages.select("*", F.inline(kinds)).where(F.size("units") > 0)


def explode_messages(messages: DataFrame) -> DataFrame:
    """One row per (message, version, unit, period) of both unit lists.

    A unit without periods keeps one row with NULL bounds; a message without units has no rows.
    """
    head = ["messageId", "version", "publicationDate", "remarks"]
    gen = messages.select(*head, F.lit("generation").alias("kind"), F.explode("productionUnits").alias("u")).select(
        *head, "kind", F.col("u.name").alias("unit_name"), F.col("u.eic").alias("unit"), F.col("u.timePeriods").alias("tp")
    )
    tx = messages.select(*head, F.lit("transmission").alias("kind"), F.explode("transmissionUnits").alias("u")).select(
        *head, "kind", F.col("u.name").alias("unit_name"),
        F.concat_ws(">", "u.inAreaEic", "u.outAreaEic").alias("unit"), F.col("u.timePeriods").alias("tp"),
    )
    flat = gen.unionByName(tx).select("*", F.explode_outer("tp").alias("p"))
    return flat.select(
        "messageId", "version", parse_iso_utc(F.col("publicationDate")).alias("published"), "remarks", "kind",
        "unit_name", "unit", parse_iso_utc(F.col("p.eventStart")).alias("start"),
        parse_iso_utc(F.col("p.eventStop")).alias("end"), F.col("p.unavailableCapacity").alias("mw"),
        F.col("p.availableCapacity").alias("available"),
    )
