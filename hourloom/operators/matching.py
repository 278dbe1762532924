"""Candidate intervals against document threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.functions.text import strip
from hourloom.operators import relations as rel

MIN_OVERLAP = 0.5
MAX_LENGTH_RATIO = 3.0


def latest_version(versions: DataFrame, by: list[str], version: str) -> DataFrame:
    rest = [c for c in versions.columns if c not in by]
    newest = F.max_by(F.struct(*rest), version).alias("__r")
    return versions.groupBy(*by).agg(newest).select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def _bucketed(df: DataFrame, start: str, end: str, days: int, prefix: str) -> DataFrame:
    width = 86_400_000_000 * days
    first = F.floor(F.unix_micros(start) / F.lit(width))
    last = F.floor((F.unix_micros(end) - 1) / F.lit(width))
    return df.where(F.col(start) < F.col(end)).withColumn(f"__{prefix}0", first).withColumn(
        "__bucket", F.explode(F.sequence(first, last))
    )


def overlap_pairs(
    candidates: DataFrame, threads: DataFrame, key: str, candidate: str, thread: str, bucket_days: int = 32,
    min_overlap: float = MIN_OVERLAP,
) -> DataFrame:
    """(candidate, thread, fraction) where the overlap is at least `min_overlap` of the shorter interval.

    An equi-join on (key, time bucket); a pair meeting in several buckets counts in the first common one only.
    Both sides carry `start` and `end`; threads without bounds do not match. Candidates outside the time that threads cover are not shuffled,
    nor are those in whose buckets their key has no thread.
    """
    t = threads.select(key, thread, F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    reach = t.where("t_start < t_end").agg(F.min("t_start").alias("a"), F.max("t_end").alias("z"))
    near = candidates.where((F.col("end") > reach.select("a").scalar()) & (F.col("start") < reach.select("z").scalar()))
    c = _bucketed(near.select(key, candidate, "start", "end"), "start", "end", bucket_days, "c")
    t = _bucketed(t, "t_start", "t_end", bucket_days, "t")
    c = rel.mark_possible(c, t, [key, "__bucket"], "__near").where("__near")
    frac = cal.overlap_fraction(F.col("start"), F.col("end"), F.col("t_start"), F.col("t_end"))
    joined = c.join(t, [key, "__bucket"]).where(F.col("__bucket") == F.greatest("__c0", "__t0"))
    return joined.withColumn("fraction", frac).where(F.col("fraction") >= min_overlap).select(
        candidate, thread, "start", "end", "fraction"
    )


def interval_overlap_match(
    candidates: DataFrame, threads: DataFrame, key: str, candidate: str, thread: str, excluded_keys: list,
    duplicate_of: str | None = None, bucket_days: int = 32, kind: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Matched pairs, and per candidate how many there are or why there is none.

    Without any thread of its key a candidate says `unit_not_pulled`, or `no_umm_thread` if its `kind` is transmission. A thread without bounds is a
    thread of its key, too. Only candidates that may have a match are shuffled to meet the tally; the keys of threads are sent to all.
    """
    open_rows = candidates.where(~F.col(key).isin(*excluded_keys)) if excluded_keys else candidates
    if duplicate_of:
        open_rows = open_rows.where(F.col(duplicate_of).isNull())
    pairs = overlap_pairs(open_rows, threads, key, candidate, thread, bucket_days)
    tally = pairs.groupBy(candidate).agg(F.count(F.lit(1)).alias("n_matched"), F.min(thread).alias("first_match"))
    known = threads.select(key).distinct().withColumn("__known", F.lit(True))
    marked = rel.mark_possible(candidates, tally, [candidate], "__may")
    counted = marked.where("__may").drop("__may").join(tally, candidate, "left")
    none = [F.lit(None).cast(tally.schema[c].dataType).alias(c) for c in ("n_matched", "first_match")]
    out = counted.unionByName(marked.where("not __may").drop("__may").select("*", *none)).join(F.broadcast(known), key, "left")
    absent = F.lit("unit_not_pulled") if kind is None else F.when(F.col(kind) == "transmission", "no_umm_thread").otherwise("unit_not_pulled")
    reason = F.when(F.col("n_matched") > 0, F.lit(None).cast("string")).when(
        F.col("__known").isNull(), absent).otherwise("overlap_below_50pct")
    if excluded_keys:
        reason = F.when(F.col(key).isin(*excluded_keys), "excluded_unit").otherwise(reason)
    if duplicate_of:
        reason = F.when(F.col(duplicate_of).isNotNull(), F.concat(F.lit("duplicate_of_"), F.col(duplicate_of))).otherwise(reason)
    report = out.select(
        *candidates.columns, F.coalesce("n_matched", F.lit(0).cast("bigint")).alias("n_matched"), "first_match", reason.alias("reason")
    )
    return pairs, report


def best_thread_argmin(
    pairs: DataFrame, periods: DataFrame, candidate: str, thread: str, version: str, published: str,
    min_overlap: float = MIN_OVERLAP, max_ratio: float = MAX_LENGTH_RATIO, bounds: bool = False,
) -> DataFrame:
    """One thread per candidate: among threads with a fitting period in any version, the one first published
    nearest to the candidate's start (ties: smallest thread).

    A period fits if it overlaps enough and is not much longer than the candidate. Periods repeated by later
    versions are compared once. With `bounds` the candidate's own start and end are returned too, so that the candidates need not be read again for them.
    """
    first = periods.groupBy(thread).agg(F.min_by(published, version).alias("__first"))
    spans = periods.where(F.col("start") < F.col("end")).select(
        thread, F.col("start").alias("p_start"), F.col("end").alias("p_end")
    ).distinct()
    length, own = cal.seconds_between(F.col("p_start"), F.col("p_end")), cal.seconds_between(F.col("start"), F.col("end"))
    fits = (cal.overlap_fraction(F.col("start"), F.col("end"), F.col("p_start"), F.col("p_end")) >= min_overlap) & (
        (own <= 0) | (length <= F.lit(max_ratio) * own)
    )
    passed = pairs.select(candidate, thread, "start", "end").join(spans, thread).where(fits).select(
        candidate, thread, "start", *(["end"] if bounds else [])
    ).distinct()
    own_bounds = [F.min(c).alias(c) for c in ("start", "end")] if bounds else []
    far = F.abs(cal.seconds_between(F.col("__first"), F.col("start")))
    return passed.join(first, thread).groupBy(candidate).agg(
        F.min_by(thread, F.struct(far, F.col(thread))).alias(thread), F.min(far).alias("closeness_seconds"),
        F.count(F.lit(1)).alias("n_passed"), *own_bounds,
    )


def window_hours(events: DataFrame, keys: list[str], event: str, ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """The instants of [start, end) of each event. Events last at most some weeks, so those of one are a bounded list."""
    return events.where("start < end").select(event, *keys, F.explode(F.expr(f"sequence(start, end - interval 1 second, interval {step})")).alias(ts))


def window_mean(
    events: DataFrame, driver: DataFrame, keys: list[str], event: str, ts: str, value: str, step: str = "1 hour", bucket_days: int = 8,
) -> DataFrame:
    """Mean of a regular driver over [start, end) of each event. The driver need not have more than `window_hours` of the events.

    An event meets the driver's hours bucket by bucket, in an equi-join on (keys, time bucket), and takes those of its window there: it is shuffled
    once per bucket, not once per hour. `step` has a fixed length.
    """
    apart = F.expr(f"unix_micros(timestamp_micros(0) + interval {step})")
    hour = F.struct(F.unix_micros(ts).alias("at"), F.col(value).cast("double").alias("x"))
    told = driver.select(*keys, F.floor(F.unix_micros(ts) / F.lit(86_400_000_000 * bucket_days)).alias("__bucket"), hour.alias("__hour"))
    told = told.groupBy(*keys, "__bucket").agg(F.collect_list("__hour").alias("__hours"))
    spans = _bucketed(events.select(event, *keys, "start", "end"), "start", "end", bucket_days, "w")
    first, last = F.unix_micros("start"), F.unix_micros("end") - 1_000_000  # as in `window_hours`
    met = spans.join(told, [*keys, "__bucket"]).select(
        event, F.filter("__hours", lambda h: (h["at"] >= first) & (h["at"] <= last) & ((h["at"] - first) % apart == 0)).alias("__met"))
    known = F.filter(F.transform("__met", lambda h: h["x"]), lambda x: x.isNotNull())
    sums = met.select(event, F.size("__met").alias("__n"), known.alias("__x")).groupBy(event).agg(
        F.sum("__n").alias("__n"), F.sum(F.size("__x")).alias("__k"), F.sum(F.aggregate("__x", F.lit(0.0), lambda s, x: s + x)).alias("__s"))
    return sums.where("__n > 0").select(event, (F.col("__s") / F.nullif("__k", F.lit(0))).alias("window_mean"))


def end_mismatch_check(
    events: DataFrame, versions: DataFrame, means: DataFrame, event: str, thread: str, reduction: str,
    published: str = "published", max_hours: float = 6.0, min_share: float = 0.8,
) -> DataFrame:
    """Per event: was a version published before the start, does the last one agree on the end, is the driver high enough?"""
    last = versions.groupBy(thread).agg(
        F.max_by("end", published).alias("__stop"), F.min(published).alias("__first"),
    )
    rows = events.join(last, thread, "left").join(means, event, "left")
    gap = F.abs(cal.hours_between(F.col("__stop"), F.col("end")))
    return rows.select(
        event, thread, gap.alias("end_gap_hours"), F.coalesce(gap > max_hours, F.lit(False)).alias("end_mismatch"),
        F.coalesce(F.col("__first") < F.col("start"), F.lit(False)).alias("had_pre_start_version"), "window_mean",
        F.coalesce(F.col("window_mean") >= F.lit(min_share) * F.col(reduction), F.lit(False)).alias("window_ok"),
    )


def unit_name_match(
    outages: DataFrame, messages: DataFrame, outage: str, message: str, order: str, unit: str, name: str, remarks: str
) -> DataFrame:
    """Per outage the first message (by `order`) with the same unit id, or whose unit name contains the outage's.

    Of all messages with one unit id or one name only the first can be an answer, so messages are first reduced to those: outages and needles meet ids and
    distinct names, never messages. A name contains a needle if one of its pieces of the needle's length equals it, so names are cut into pieces of the lengths
    that needles have, and needles look them up: an equi-join without a candidate that has to be checked, whose work is that of the names' pieces.
    Without a match the first message with remarks stands in, or the first of all if none has remarks.
    """
    clean = lambda c: strip(F.lower(F.coalesce(F.col(c), F.lit(""))))
    o = outages.select(outage, F.col(unit).alias("__unit"), clean(name).alias("__needle"))
    m = messages.select(F.struct(F.col(order).alias("o"), F.col(message).alias("m")).alias("__msg"), F.col(unit).alias("__unit"), clean(name).alias("__hay"))
    first_of_unit = m.where(F.col("__unit").isNotNull()).groupBy("__unit").agg(F.min("__msg").alias("__by_id"))
    names = m.groupBy("__hay").agg(F.min("__msg").alias("__msg"))

    needles = o.where(F.col("__needle") != "").select("__needle").distinct()
    lengths = needles.agg(F.sort_array(F.collect_set(F.length("__needle"))).alias("l"))  # at most as many as the longest name has letters
    cuts = names.select("__msg", "__hay", F.explode(lengths.select("l").scalar()).alias("__n")).where(F.col("__n") <= F.length("__hay"))
    last = F.length("__hay") - F.col("__n") + 1
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col("__hay"), i, F.col("__n"))))
    pieces = cuts.select("__msg", F.explode(pieces).alias("__needle")).groupBy("__needle").agg(F.min("__msg").alias("__by_name"))
    found = needles.hint("merge").join(pieces, "__needle")

    spoken = F.when(F.coalesce(F.col(remarks), F.lit("")) != "", F.col(order))
    spare = messages.agg(F.min_by(message, F.struct(spoken.isNull(), order, message)).alias("m"))
    best = o.join(first_of_unit.hint("merge"), "__unit", "left").join(found.hint("merge"), "__needle", "left").select(outage, F.least("__by_id", "__by_name").getField("m").alias("__best"))
    return best.select(
        outage, F.coalesce("__best", spare.select("m").scalar()).alias(message), F.col("__best").isNotNull().alias("matched")
    )
