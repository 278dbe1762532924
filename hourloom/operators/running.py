"""Running aggregates that never put one whole key into one task.

A window over a key alone sorts the key's full history in a single task. Here
the history is cut into calendar buckets: rows are windowed inside their own
(key, bucket), and what earlier buckets contribute arrives through a summary
with one row per (key, bucket), which is small enough to be joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import numeric as num

BUCKET = "__bucket"


def _cut(df: DataFrame, order: str, bucket: str | int) -> DataFrame:
    """Bucket by calendar unit (text) or by a numeric width (whole number)."""
    if isinstance(bucket, int):
        return df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(bucket)))
    return df.withColumn(BUCKET, F.date_trunc(bucket, F.col(order)))


def _earlier(by: list[str]):
    return Window.partitionBy(*by, F.lit(0)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def running_sums(
    df: DataFrame, by: list[str], order: str, sums: dict[str, str], bucket: str = "month"
) -> DataFrame:
    """Add, for each `source -> output`, the sum of `source` over all rows at or before the row's `order`."""
    rows = _cut(df, order, bucket)
    keys = [*by, BUCKET]
    totals = rows.groupBy(*keys).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"__t_{s}").over(_earlier(by)), F.lit(0)).alias(f"__o_{s}") for s in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__w_{s}") for s in sums])
    out = within.join(offsets, keys, "left")
    return out.select(
        *df.columns, *[(F.col(f"__o_{s}") + F.col(f"__w_{s}")).alias(o) for s, o in sums.items()]
    )


def running_max_before(df: DataFrame, by: list[str], order: str, value: str, out: str, bucket: str = "month") -> DataFrame:
    """Add the largest `value` of all rows strictly before the row's `order`; NULL where there is none. One row per key and order."""
    rows = _cut(df, order, bucket)
    keys = [*by, BUCKET]
    earlier = rows.groupBy(*keys).agg(F.max(value).alias("__t")).select(*keys, F.max("__t").over(_earlier(by)).alias("__o"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("__w", F.max(value).over(inside))
    return within.join(earlier, keys, "left").select(*df.columns, F.greatest("__o", "__w").alias(out))


def carry_forward(
    df: DataFrame,
    by: list[str],
    order: str,
    fills: dict[str, str],
    bucket: str = "month",
    tie: list[Column] | None = None,
    backward: bool = False,
) -> DataFrame:
    """Add, for each `source -> output`, the nearest non-null `source` at or before the row.

    With `backward` the nearest value at or after the row is taken instead.
    """
    rows = _cut(df, order, bucket)
    keys = [*by, BUCKET]
    pick = F.min_by if backward else F.max_by
    rank = F.struct(F.col(order), *(tie or []))
    edges = rows.groupBy(*keys).agg(
        *[pick(F.col(s), F.when(F.col(s).isNotNull(), rank)).alias(f"__e_{s}") for s in fills]
    )
    across = Window.partitionBy(*by, F.lit(0)).orderBy(BUCKET)
    inside = Window.partitionBy(*keys).orderBy(order, *(tie or []))
    if backward:
        across = across.rowsBetween(1, Window.unboundedFollowing)
        inside = inside.rowsBetween(0, Window.unboundedFollowing)
        near = lambda c: F.first(c, ignorenulls=True)
    else:
        across = across.rowsBetween(Window.unboundedPreceding, -1)
        inside = inside.rowsBetween(Window.unboundedPreceding, 0)
        near = lambda c: F.last(c, ignorenulls=True)
    edges = edges.select(*keys, *[near(f"__e_{s}").over(across).alias(f"__c_{s}") for s in fills])
    within = rows.select("*", *[near(s).over(inside).alias(f"__i_{s}") for s in fills])
    out = within.join(edges, keys, "left")
    return out.select(
        *df.columns, *[F.coalesce(f"__i_{s}", f"__c_{s}").alias(o) for s, o in fills.items()]
    )


def previous_value(
    df: DataFrame, by: list[str], order: str, value: str, out: str, bucket: str | int = "day"
) -> DataFrame:
    """Add the `value` of the row just before (by `order`); the first row of a key gets NULL."""
    rows = _cut(df, order, bucket)
    keys = [*by, BUCKET]
    last = rows.groupBy(*keys).agg(F.max_by(value, order).alias("__last"))
    last = last.select(*keys, F.lag("__last").over(Window.partitionBy(*by, F.lit(0)).orderBy(BUCKET)).alias("__prev"))
    inside = Window.partitionBy(*keys).orderBy(order)
    within = rows.select(
        "*", F.lag(value).over(inside).alias("__lag"), (F.row_number().over(inside) == 1).alias("__first")
    )
    return within.join(last, keys, "left").select(
        *df.columns, F.when(F.col("__first"), F.col("__prev")).otherwise(F.col("__lag")).alias(out)
    )


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: list[float], bins: int = 1024, max_bin: int = 1_000_000
) -> DataFrame:
    """Linear-interpolation quantiles `(by..., p, q)` of groups of any size.

    NULL, NaN and infinite values do not count. The built-in `percentile` holds all distinct values of a group in one task. Here equal values are
    counted first. The value range is then cut into bins and only the bins that hold a wanted rank are looked
    at again, as often as needed until none of them has more than `max_bin` distinct values; those few are
    sorted. The table of wanted ranks has a handful of rows per group, so it is the small side of every join.
    """
    from hourloom.session import cut_lineage

    counts = cut_lineage(
        df.where(num.is_finite(F.col(value))).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    )
    span = counts.groupBy(*by).agg(
        F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__c").alias("__n"),
        F.count(F.lit(1)).alias("__m"),
    )
    wanted = span.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumn("__pos", F.col("p") * (F.col("__n") - 1)).withColumn(
        "__rank", F.explode(F.array_distinct(F.array(F.floor("__pos"), F.ceil("__pos"))))
    )
    wanted = wanted.select(*by, "p", "__pos", "__rank", "__lo", "__hi", "__m", F.lit(0).cast("bigint").alias("__below"))
    wanted = cut_lineage(wanted)

    def renamed(t: DataFrame, names: list[str]) -> DataFrame:
        return t.select(*[F.col(c).alias(f"__r_{c}") if c in names else F.col(c) for c in t.columns])

    def same(names: list[str]) -> Column:
        cond = F.lit(True)
        for n in names:
            cond = cond & F.col(n).eqNullSafe(F.col(f"__r_{n}"))
        return cond

    def candidates() -> DataFrame:
        ranges = renamed(wanted.select(*by, "__lo", "__hi", "__below").distinct(), by)
        inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
        return counts.join(ranges, same(by) & inside).select(*by, "__v", "__c", "__lo", "__hi", "__below")

    cell = [*by, "__lo", "__hi"]
    while not wanted.where((F.col("__m") > max_bin) & (F.col("__lo") < F.col("__hi"))).isEmpty():
        # halves, as the range of two large values may not be a number
        width = F.nullif(F.col("__hi") / 2 - F.col("__lo") / 2, F.lit(0.0))
        slot = F.least(F.coalesce(F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / width * bins), F.lit(0)), F.lit(bins - 1))
        grid = candidates().groupBy(*by, "__lo", "__hi", "__below", slot.alias("__slot")).agg(
            F.sum("__c").alias("__k"), F.count(F.lit(1)).alias("__m2"), F.min("__v").alias("__lo2"), F.max("__v").alias("__hi2")
        )
        before = Window.partitionBy(*by, "__lo", "__hi").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        grid = grid.withColumn("__start", F.col("__below") + F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__below")
        hit = (F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__start") + F.col("__k"))
        found = wanted.drop("__m", "__below").join(renamed(grid, cell), same(cell) & hit)
        wanted = cut_lineage(
            found.select(
                *by, "p", "__pos", "__rank", F.col("__lo2").alias("__lo"),
                F.col("__hi2").alias("__hi"), F.col("__m2").alias("__m"), F.col("__start").alias("__below"),
            )
        )
    upto = Window.partitionBy(*by, "__lo", "__hi").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    line = candidates().withColumn("__end", F.col("__below") + F.sum("__c").over(upto)).drop("__below")
    hit = (F.col("__rank") < F.col("__end")) & (F.col("__rank") >= F.col("__end") - F.col("__c"))
    found = wanted.join(renamed(line, cell), same(cell) & hit).select(*by, "p", "__pos", "__rank", "__v")
    low, high = F.min_by("__v", "__rank"), F.max_by("__v", "__rank")
    frac = F.max("__pos") - F.floor(F.max("__pos"))
    return found.groupBy(*by, "p").agg((low + (high - low) * frac).alias("q"))


def global_positions(df: DataFrame, order: list[str], out: str = "pos", part: str | None = None) -> DataFrame:
    """Number all rows 0, 1, 2, ... in `order` by range partitions: no single-task sort. `part` names a column for a row's range partition, if wanted.

    The ranged rows are checkpointed, as both branches must see the same partitions.
    """
    from hourloom.session import cut_lineage

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumn("__mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("__part", F.shiftright("__mid", 33)).withColumn(
        "__at", F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: the only unpartitioned window here, over a handful of rows
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return ranged.join(F.broadcast(sizes), "__part").select(
        *df.columns, (F.col("__off") + F.col("__at")).alias(out), *([F.col("__part").alias(part)] if part else [])
    )
