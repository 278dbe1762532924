"""Spines, deduplication, resampling, filling and coverage of time series.

Series are long: key columns `by`, an instant `ts`, values. After resampling a
series has one row per hour, so a window over one series is bounded by the
calendar (8,784 rows a year); anything working on raw points uses the
bucketed aggregates of `running` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import inference, running


# ------------------------------------------------------------------ spines
def hour_spine(bounds: DataFrame, start: str, end: str, tz: str = "UTC", out: str = "ts") -> DataFrame:
    """All hours of the wall-clock range [start, end): 23 or 25 of them on a switch day.

    Weeks are exploded before hours, so no row ever holds a long array.
    """
    keys = [c for c in bounds.columns if c not in (start, end)]
    first, last = F.to_utc_timestamp(F.col(start), tz), F.to_utc_timestamp(F.col(end), tz)
    spans = bounds.select(*keys, first.alias("__a"), last.alias("__b")).where("__a < __b")
    blocks = spans.select("*", F.explode(F.expr("sequence(__a, __b, interval 168 hours)")).alias("__s"))
    stop = F.least(F.expr("__s + interval 167 hours"), F.expr("__b - interval 1 hour"))
    blocks = blocks.withColumn("__t", stop).where("__s <= __t")
    return blocks.select(*keys, F.explode(F.expr("sequence(__s, __t, interval 1 hour)")).alias(out))


def day_spine(bounds: DataFrame, first: str, last: str, out: str = "day") -> DataFrame:
    """All calendar days from first to last, both included, counted on dates."""
    keys = [c for c in bounds.columns if c not in (first, last)]
    days = F.sequence(F.to_date(first), F.to_date(last))
    return bounds.where(F.to_date(first) <= F.to_date(last)).select(*keys, F.explode(days).alias(out))


def event_days(events: DataFrame, start: str, end: str, tz: str, out: str = "day") -> DataFrame:
    """Local days touched by [start, end]; an end at exactly midnight still adds its day."""
    days = F.sequence(cal.local_day(F.col(start), tz), cal.local_day(F.col(end), tz))
    return events.where(F.col(start) <= F.col(end)).withColumn(out, F.explode(days))


def bounds_of(series: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Per key, the whole-day range all series share: [first day, day after the last)."""
    share = series.agg(
        F.date_trunc("day", F.min(ts)).alias("a"),
        (F.date_trunc("day", F.max(ts)) + F.expr("interval 1 day")).alias("b"),
        )
    return (
        series.select(*by).distinct()
        .withColumn("start", share.select("a").scalar())
        .withColumn("end", share.select("b").scalar())
    )


# ----------------------------------------------------------- deduplication
def dedup_index_first(df: DataFrame, index: list[str], order: list[str]) -> DataFrame:
    """One row per index value, first in `order`; an aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in index]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*index).agg(best).select(*index, *[F.col(f"__r.{c}").alias(c) for c in rest])


def dedup_full_row(df: DataFrame, index: list[str], order: list[str]) -> DataFrame:
    """Drop rows equal in every column but the index; the first in `order` keeps its index."""
    helper = set(index) | set(order)
    body = [c for c in df.columns if c not in helper]
    keep = [c for c in df.columns if c in helper]
    best = F.min_by(F.struct(*keep), F.struct(*order)).alias("__r")
    return df.groupBy(*body).agg(best).select(*body, *[F.col(f"__r.{c}").alias(c) for c in keep])


# -------------------------------------------------------------- resampling
def hourly_mean(series: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    return series.groupBy(*by, F.date_trunc("hour", ts).alias(ts)).agg(F.avg(value).alias(value))


def resample_mean(series: DataFrame, by: list[str], ts: str, value: str, spine: DataFrame) -> DataFrame:
    """Mean of each UTC hour (missing values skipped) on the expected hours."""
    return spine.join(hourly_mean(series, by, ts, value), [*by, ts], "left")


def resample_ffill(
    series: DataFrame, by: list[str], ts: str, value: str, spine: DataFrame, bucket: str = "month"
) -> DataFrame:
    """Last value at or before each expected hour, for sources coarser than an hour."""
    points = series.select(*by, F.col(ts), F.col(value), F.lit(0).alias("__spine"))
    hours = spine.select(*by, F.col(ts), F.lit(None).cast("double").alias(value), F.lit(1).alias("__spine"))
    both = points.unionByName(hours)
    filled = running.carry_forward(both, by, ts, {value: "__f"}, bucket, tie=[F.col("__spine")])
    return filled.where("__spine = 1").select(*by, ts, F.col("__f").alias(value))


def ffill_columns(df: DataFrame, by: list[str], ts: str, columns: list[str], bucket: str = "month") -> DataFrame:
    filled = running.carry_forward(df, by, ts, {c: f"__f_{c}" for c in columns}, bucket)
    return filled.select(*[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def bfill_edge(df: DataFrame, by: list[str], ts: str, columns: list[str], bucket: str = "month") -> DataFrame:
    """Forward fill, then backward fill only what is still missing; adds `<c>_fill` in {none, forward, backward}."""
    fwd = running.carry_forward(df, by, ts, {c: f"__f_{c}" for c in columns}, bucket)
    both = running.carry_forward(fwd, by, ts, {c: f"__b_{c}" for c in columns}, bucket, backward=True)
    out = []
    for c in df.columns:
        out.append(F.coalesce(c, f"__f_{c}", f"__b_{c}").alias(c) if c in columns else F.col(c))
    for c in columns:
        label = (
            F.when(F.col(c).isNotNull(), "none")
            .when(F.col(f"__f_{c}").isNotNull(), "forward")
            .when(F.col(f"__b_{c}").isNotNull(), "backward")
        )
        out.append(label.alias(f"{c}_fill"))
    return both.select(*out)


def zero_fill_before_first(df: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Missing values strictly before a series' first observation become 0; adds a `filled` flag."""
    first = df.groupBy(*by).agg(F.min(F.when(F.col(value).isNotNull(), F.col(ts))).alias("__first"))
    early = F.col(value).isNull() & (F.col(ts) < F.col("__first"))
    out = df.join(first, by, "left") if by else df.withColumn("__first", first.scalar())
    return out.withColumn("filled", F.coalesce(early, F.lit(False))).withColumn(
        value, F.when(F.col("filled"), F.lit(0.0)).otherwise(F.col(value))
    ).drop("__first")


def align_on_spine(spine: DataFrame, series: DataFrame, ts: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One column per series on the expected hours: a single pivot and one left join."""
    wide = series.groupBy(ts).pivot(name, names).agg(F.max(value))
    return spine.join(wide, ts, "left")


def null_counts(before: DataFrame, after: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Missing values per column before and after filling, as long rows."""

    def counts(df: DataFrame, tag: str) -> DataFrame:
        agg = df.groupBy(*by).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return agg.unpivot(by, columns, "column", tag)

    return counts(before, "nulls_before").join(counts(after, "nulls_after"), [*by, "column"])


# ----------------------------------------------------------------- reports
def coverage_report(hourly: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Expected, present and missing hours, longest missing run (the earliest of equals), first and last valid."""
    w = Window.partitionBy(*by).orderBy(ts)
    numbered = hourly.select(
        *by, ts, F.col(value).isNull().alias("__gap"),
        (F.row_number().over(w) - F.sum(F.col(value).isNull().cast("int")).over(w)).alias("__island"),
    )
    runs = (
        numbered.where("__gap").groupBy(*by, "__island")
        .agg(F.count(F.lit(1)).alias("__len"), F.min(ts).alias("__from"), F.max(ts).alias("__to"))
    )
    longest = runs.groupBy(*by).agg(
        F.max_by(F.struct("__len", "__from", "__to"), F.struct("__len", -F.unix_micros("__from"))).alias("__r")
    )
    totals = hourly.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count(value).alias("n_present"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.min(F.when(F.col(value).isNotNull(), F.col(ts))).alias("first_valid"),
        F.max(F.when(F.col(value).isNotNull(), F.col(ts))).alias("last_valid"),
    )
    return totals.join(longest, by, "left").select(
        *totals.columns,
        F.coalesce("__r.__len", F.lit(0)).alias("longest_run"),
        F.col("__r.__from").alias("longest_start"),
        F.col("__r.__to").alias("longest_end"),
    )


def resolution_switch(series: DataFrame, by: list[str], ts: str, fine: int = 4, n_examples: int = 5) -> DataFrame:
    """First hour with more than one point; hours that then have not `fine` points, and hours before with not one."""
    hours = series.groupBy(*by, F.date_trunc("hour", ts).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    switch = hours.groupBy(*by).agg(F.min(F.when(F.col("__n") > 1, F.col("__h"))).alias("switch_hour"))
    tagged = hours.join(switch, by)
    after = F.coalesce(F.col("__h") >= F.col("switch_hour"), F.lit(False))
    bad = F.when(after, F.col("__n") != fine).otherwise(F.col("__n") != 1)
    tagged = tagged.select(*by, "switch_hour", "__h", after.alias("__after"), bad.alias("__bad"))
    counts = tagged.groupBy(*by, "switch_hour").agg(
        F.count_if("__after").alias("n_after"),
        F.count_if(F.col("__after") & F.col("__bad")).alias("n_bad_after"),
        F.count_if(~F.col("__after") & F.col("__bad")).alias("n_bad_before"),
    )
    rank = F.row_number().over(Window.partitionBy(*by, "__after").orderBy("__h"))
    examples = tagged.where("__bad").withColumn("__rn", rank).where(F.col("__rn") <= n_examples)
    examples = examples.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.when(F.col("__after"), F.col("__h")))).alias("examples_after"),
        F.sort_array(F.collect_list(F.when(~F.col("__after"), F.col("__h")))).alias("examples_before"),
    )
    return counts.join(examples, by, "left")


def spacing_steps(series: DataFrame, by: list[str], ts: str) -> DataFrame:
    """The list of spacings between neighbouring points: (by, step_us, n, first_at), one row per distinct spacing, with the point before its first use.

    Points are numbered over range partitions and meet their neighbour by number, so a long series is not sorted in one task.
    """
    known = series.select(*by, F.unix_micros(ts).alias("__u")).where(F.col("__u").isNotNull())
    points = inference.group_positions(known, by, ["__u"], "__i")
    before = points.select(*by, (F.col("__i") + 1).alias("__i"), F.col("__u").alias("__p"))
    return points.join(before, [*by, "__i"]).groupBy(*by, (F.col("__u") - F.col("__p")).alias("step_us")).agg(
        F.count(F.lit(1)).alias("n"), F.timestamp_micros(F.min("__p")).alias("first_at"))


def infer_freq(series: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Spacing between neighbouring points: the spacing itself if there is only one, else how many there are (`spacing_steps` lists them)."""
    return spacing_steps(series, by, ts).groupBy(*by).agg(
        (F.sum("n") + 1).alias("n_points"),
        F.count(F.lit(1)).alias("n_steps"),
        F.min("step_us").alias("min_step_us"),
        F.max("step_us").alias("max_step_us"),
        F.when(F.count(F.lit(1)) == 1, F.max("step_us")).alias("freq_us"),
    )


def series_report(raw: DataFrame, hourly: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    """Point counts and value range of the raw series, with coverage and resolution switch alongside."""
    points = raw.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(F.col(value) < 0).alias("n_negative"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )
    cover = coverage_report(hourly, by, ts, value)
    switch = resolution_switch(raw, by, ts).drop("examples_after", "examples_before")
    return points.join(cover, by, "left").join(switch, by, "left")


def range_sanity(
    df: DataFrame, by: list[str], ts: str, value: str, low: float, high: float, window: tuple[Column, Column]
) -> DataFrame:
    """Negatives, values outside [low, high], extremes and where they occur, minimum inside a window of time."""
    v = F.col(value)
    inside = (F.col(ts) >= window[0]) & (F.col(ts) <= window[1])
    return df.groupBy(*by).agg(
        F.count_if(v < 0).alias("n_negative"),
        F.count_if(~v.between(low, high)).alias("n_out_of_range"),
        F.count_if(v.isNull()).alias("n_null"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.min_by(F.col(ts), F.when(v.isNotNull(), F.struct(v, F.col(ts)))).alias("min_at"),
        F.min(F.when(inside, v)).alias("window_min"),
    )


def actuals_local_key(forecast: DataFrame, by: list[str], ts: str, tz: str, values: list[str]) -> DataFrame:
    """Forecast rows keyed by local day and hour; rows without an instant dropped, the first of a repeated hour kept."""
    keyed = forecast.where(F.col(ts).isNotNull()).select(
        *by, cal.local_day(F.col(ts), tz).alias("day"), cal.local_hour(F.col(ts), tz).alias("hour"), ts, *values
    )
    first = dedup_index_first(keyed, [*by, "day", "hour"], [ts])
    return first.select(*by, "day", "hour", *values)
