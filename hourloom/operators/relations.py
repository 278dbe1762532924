"""Relational building blocks: keyed look-ups, set comparison, ranking, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import inference, running

# Bits of `mark_possible`. They bound its memory and change no result.
PLACES = 1 << 26


def cross_join_expand(df: DataFrame, name: str, values: int | list) -> DataFrame:
    """Every row once per value of a small fixed domain (hours, conditions, draws); a projection, no join."""
    if isinstance(values, int):
        domain = F.sequence(F.lit(0), F.lit(values - 1))
    else:
        domain = F.array(*map(F.lit, values))
    return df.withColumn(name, F.explode(domain))


def hour_interval_overlap(df: DataFrame, day: str, hour: str, start: str, end: str, tz: str) -> DataFrame:
    """Overlap of the local delivery hour with [start, end); a skipped hour has none."""
    h0 = cal.hour_label(F.col(day), F.col(hour), tz)
    h1 = F.timestamp_seconds(F.unix_seconds(h0) + 3600)
    hours = F.coalesce(cal.overlap_seconds(h0, h1, F.col(start), F.col(end)) / F.lit(3600.0), F.lit(0.0))
    hours = F.when(h0.isNull(), F.lit(0.0)).otherwise(hours)
    return df.withColumn("overlap_hours", hours).withColumn("affected", F.col("overlap_hours") > 0)


def sum_by_side(df: DataFrame, side: Column, ts: str, amount: str) -> DataFrame:
    return df.groupBy(side.alias("side"), ts).agg(F.sum(F.coalesce(amount, F.lit(0.0))).alias("total"))


def registry_by_year(df: DataFrame, year: str, amount: str, threshold: float) -> DataFrame:
    kept = F.col(amount) >= threshold
    return df.groupBy(year).agg(
        F.count_if(kept).alias("n_kept"), F.count_if(F.col(amount) < threshold).alias("n_dropped"),
        F.sum(F.when(kept, F.col(amount))).alias("installed"),
    )


def first_per_year(df: DataFrame, year: Column, columns: list[str], order: list[str]) -> DataFrame:
    """Row-wise total (missing values skipped) of the first row of each year, and whether the year had more."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    rows = df.select(year.alias("year"), total.alias("total"), *order)
    return rows.groupBy("year").agg(
        F.min_by("total", F.struct(*order)).alias("total"), F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) > 1).alias("duplicated"),
    )


def key_reconciliation(rows: DataFrame, known: DataFrame, keys: list[str], n_sample: int, order: list[str]) -> DataFrame:
    """Keys of `rows` that `known` lacks: how many rows in all, and the first keys as examples."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    missing = counted.join(known.select(*keys).distinct(), keys, "left_anti")
    total = missing.agg(F.sum("n").alias("t"))
    return missing.orderBy(*order).limit(n_sample).withColumn("n_missing", total.select("t").scalar())


def _sides(left: DataFrame, right: DataFrame, key: str, among: DataFrame | None = None) -> DataFrame:
    mark = lambda df, *on: df.select(F.col(key), *[F.lit(int(c in on)).alias(c) for c in ("l", "r", "a")])
    marks = mark(left, "l").unionByName(mark(right, "r"))
    if among is not None:
        marks = marks.unionByName(mark(among, "a"))
    found = marks.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in ("l", "r", "a")])
    return found.where((F.col("l") + F.col("r") > 0) & (F.col("a") == int(among is not None)))


def id_set_compare(left: DataFrame, right: DataFrame, key: str, among: DataFrame | None = None) -> DataFrame:
    """Numbers of keys on the left only, the right only, and both; one aggregate over the union.

    Only keys that `among` has count, if it is given. They are met in the same aggregate: keys are few bytes each, so a sorted join of
    millions of them in one merged partition costs more memory than all else here.
    """
    s = _sides(left, right, key, among)
    return s.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_only_right"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"),
    )


def set_sides(left: DataFrame, right: DataFrame, key: str, out: str = "id", among: DataFrame | None = None) -> DataFrame:
    """Each distinct key, of those that `among` has if it is given, with the side it is on."""
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right")
    return _sides(left, right, key, among).select(side.alias("side"), F.col(key).alias(out))


def mark_possible(df: DataFrame, other: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Mark the rows of `df` whose keys `other` may have: all that it has, and by chance a few that it has not.

    Rows without the mark need no shuffle to learn that they meet nothing. Every key sets one of 2**26 bits by its hash, and tasks get the words
    that have a bit set: a million words at most, however many keys there are.
    """
    alike = df.select(*keys).union(other.select(*keys)).schema  # a join compares keys of two types as one type
    place = F.pmod(F.xxhash64(*[F.col(f.name).cast(f.dataType) for f in alike]), F.lit(PLACES))
    word, bit = F.shiftright("__place", 6).alias("__word"), (F.col("__place") % 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words = other.dropna(subset=keys).select(place.alias("__place")).select(word, one.alias("__one")).groupBy("__word").agg(F.bit_or("__one").alias("__bits"))
    met = df.withColumn("__place", place).select("*", word).join(F.broadcast(words), "__word", "left")
    hit = F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(1) == 1
    return met.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(out))


def union_tagged(feeds: dict[str, DataFrame], tag: str) -> DataFrame:
    out = None
    for name, feed in feeds.items():
        part = feed.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def lookup_enum(df: DataFrame, code: str, table: DataFrame, key: str, text: str, order: str, out: str) -> DataFrame:
    """Code -> text by the first matching entry of a code table; NULL when there is none."""
    first = table.groupBy(key).agg(F.min_by(text, order).alias(out))
    return df.join(first, df[code] == first[key], "left").select(*df.columns, out)


def positional_ids(df: DataFrame, prefix: str, order: list[str], out: str) -> DataFrame:
    """`<prefix>001`, `<prefix>002`, ... in `order`, which must be total, within each prefix: numbered over range partitions with offsets."""
    placed = inference.group_positions(df, [prefix], order, "__at")
    return placed.select(*df.columns, F.format_string("%s%03d", F.col(prefix), F.col("__at") + 1).alias(out))


def sample_head(df: DataFrame, by: list[str], value: str, n: int, out: str) -> DataFrame:
    """The first n distinct values per key, sorted. The rank limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    head = df.select(*by, value).where(F.col(value).isNotNull()).distinct().withColumn("__rn", rank).where(F.col("__rn") <= n)
    return head.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias(out))


def ordered_report(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in total order with their position, numbered over range partitions."""
    return running.global_positions(df, order, "position").withColumn("position", F.col("position") + 1)


def value_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def with_unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `df`, failing at run time if a key occurs twice."""
    payload = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in payload]
    )
    fail = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(F.struct(*keys))))
    checked = F.when(F.col("__n") == 1, F.lit(True)).otherwise(fail.cast("boolean"))
    return once.where(checked).select(*df.columns)


def join_many_to_one_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(with_unique_keys(right, keys), keys, "left")


def join_one_to_one_checked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return with_unique_keys(left, keys).join(with_unique_keys(right, keys), keys, "left")


def missing_partner_report(rows: DataFrame, partner: DataFrame, keys: list[str], check: str, detail: str) -> DataFrame:
    """Rows of `rows` without a partner, in the shape of failure records."""
    gone = rows.join(partner.select(*keys).distinct(), keys, "left_anti")
    return gone.select(F.lit(check).alias("check"), *rows.columns, F.lit(detail).alias("detail"))


