"""Paired tests and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.functions import numeric as num
from hourloom.operators import running
from hourloom.session import cut_lineage


LOCAL_GROUPS = 100_000  # first positions of so many groups and range partitions are sent to every task; more are met by a join


def group_positions(df: DataFrame, by: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """Positions 0, 1, ... within each group, by range partitions of the whole: no group is sorted in one task."""
    placed = running.global_positions(df, [*by, *order], "__g", "__part")
    if not by:
        return placed.drop("__part").withColumnRenamed("__g", out)
    # a group's first position meets its rows by (group, range partition): groups may be few and large, so a shuffle by group alone would have hot tasks
    first = placed.groupBy(*by, "__part").agg(F.min("__g").alias("__base"))
    base = cut_lineage(first.withColumn("__base", F.min("__base").over(Window.partitionBy(*by))))
    if base.count() <= LOCAL_GROUPS:
        base = F.broadcast(base)
    return placed.join(base, [*by, "__part"]).select(*df.columns, (F.col("__g") - F.col("__base")).alias(out))


def dm_test(
    df: DataFrame, by: list[str], order: list[str], diff: str, max_lag: int = 23, block: int = 4096
) -> DataFrame:
    """Diebold-Mariano statistic with Bartlett weights over the ordered loss differences of each group.

    The order is cut into blocks; each block also gets the `max_lag` rows before it, so every lag product
    is formed inside one block and only sums leave it.
    """
    rows = df.where(num.is_finite(F.col(diff))).select(*by, *order, F.col(diff).alias("__x"))
    rows = group_positions(cut_lineage(rows), by, order, "__i").select(*by, "__i", "__x")
    keys = by or ["__all"]
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__x").alias("mean_loss_diff"))
    centred = rows.join(stats.select(*keys, "mean_loss_diff"), keys).select(
        *keys, "__i", (F.col("__x") - F.col("mean_loss_diff")).alias("__c"), F.floor(F.col("__i") / block).alias("__own")
    )
    near_end = F.col("__i") % block >= block - max_lag
    spread = centred.withColumn(
        "__block", F.explode(F.when(near_end, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own")))
    )
    w = Window.partitionBy(*keys, "__block").orderBy("__i")
    lagged = spread.select(
        *keys, "__c", (F.col("__own") == F.col("__block")).alias("__mine"),
        *[F.lag("__c", k).over(w).alias(f"__l{k}") for k in range(1, max_lag + 1)],
    ).where("__mine")
    sums = lagged.groupBy(*keys).agg(
        F.sum(F.col("__c") * F.col("__c")).alias("__g0"),
        *[F.coalesce(F.sum(F.col("__c") * F.col(f"__l{k}")), F.lit(0.0)).alias(f"__g{k}") for k in range(1, max_lag + 1)],
    )
    out = stats.join(sums, keys)
    lag = F.least(F.lit(max_lag), F.floor(F.pow(F.col("n"), F.lit(1.0 / 3.0))).cast("int"))
    out = out.withColumn("lag", F.when(F.col("n") >= 10, lag))
    variance = F.col("__g0") / F.col("n")
    for k in range(1, max_lag + 1):
        weight = F.lit(2.0) * (F.lit(1.0) - F.lit(float(k)) / (F.col("lag") + 1))
        variance = variance + F.when(F.col("lag") >= k, weight * F.col(f"__g{k}") / F.col("n")).otherwise(F.lit(0.0))
    stat = F.when((F.col("n") >= 10) & (variance > 0), F.col("mean_loss_diff") / F.sqrt(variance / F.col("n")))
    out = out.withColumn("dm_stat", stat)
    return out.select(
        *by, "n", F.when(F.col("n") >= 10, F.col("mean_loss_diff")).alias("mean_loss_diff"), "dm_stat",
        num.erfc(F.abs("dm_stat") / F.sqrt(F.lit(2.0))).alias("p_value"), "lag",
    )


LOCAL_VALUES = 1_000_000  # so many values (8 bytes each) are sent to every task; more are shuffled to chunks of draws


def block_bootstrap(
    values: DataFrame, by: list[str], event: str, value: str, draws: int = 10_000, seed: int = 20260914, local_values: int = LOCAL_VALUES
) -> DataFrame:
    """Event-block bootstrap of a mean: estimate, 95 % interval and the share of draws below zero.

    Each slot of each draw picks an event by a reproducible hash of seed, draw and slot. The hash does not know the group, so a draw is hashed once, for the
    largest group, and serves all of them. Up to `local_values` values travel to the tasks, each of which makes whole draws; beyond that
    they are packed into arrays and shuffled to chunks of draws, without the driver. Both ways give the same draws.
    """
    if not by:  # one group
        one = block_bootstrap(values.withColumn("__all", F.lit(0)), ["__all"], event, value, draws, seed, local_values)
        return one.drop("__all")
    # one row per event, but costly to derive: written once, as numbering reads its input twice
    placed = group_positions(cut_lineage(values.select(*by, event, value)), by, [event], "__i")
    size = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("estimate")
    )
    total = size.agg(F.sum("n_events").alias("n")).first().n or 0
    way = _drawn_here if total <= local_values else _drawn_in_chunks
    means = way(placed, size, by, value, draws, seed)
    # one row per draw: a fixed number, so the built-in exact percentile is bounded
    spread = means.groupBy(*by).agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("m") < 0).cast("double")).alias("p_below_zero"),
    )
    return size.join(spread, by)


def _drawn_here(placed: DataFrame, size: DataFrame, by: list[str], value: str, draws: int, seed: int) -> DataFrame:
    """Means (by, draw, m) made draw by draw in the tasks, from values of a checked size."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in by)
    schema = f"{fields}, draw bigint, m double"
    groups: dict = {}
    for r in placed.select(*by, "__i", value).collect():
        groups.setdefault(tuple(r[: len(by)]), []).append((r["__i"], r[value]))
    arrays = {k: [v for _, v in sorted(rows)] for k, rows in groups.items()}

    def run(frames):
        import numpy as np
        import pandas as pd

        pools = {k: np.array([np.nan if v is None else v for v in rows], dtype=float) for k, rows in arrays.items()}
        for frame in frames:
            yield pd.DataFrame(_means(pools, frame["draw"].tolist(), seed), columns=[*by, "draw", "m"])

    spark = placed.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, draws, 1, max(4 * tasks, 1)).select(F.col("id").alias("draw")).mapInPandas(run, schema)


SLOT_BLOCK = 65_536


def _means(pools: dict, draws: list[int], seed: int) -> list[tuple]:
    """(key..., draw, mean) of every pool (a float array, NaN: missing) and draw; slots are hashed in blocks, once for all pools."""
    import numpy as np
    from hashlib import md5

    most = max(map(len, pools.values()), default=0)
    sums = {k: np.zeros(len(draws)) for k in pools}
    counts = {k: np.zeros(len(draws), dtype=np.int64) for k in pools}
    for first in range(0, most, SLOT_BLOCK):
        tails = [b"|%d" % s for s in range(first, min(first + SLOT_BLOCK, most))]
        for at, draw in enumerate(draws):
            head = b"%d|%d" % (seed, draw)
            digests = np.frombuffer(b"".join([md5(head + tail).digest() for tail in tails]), dtype=">u8")[::2]
            u = (digests >> np.uint64(12)).astype(float) / 2.0**52  # the first 13 hexadecimal digits
            for key, pool in pools.items():
                picked = pool[np.floor(u[: max(len(pool) - first, 0)] * len(pool)).astype(np.int64)]
                known = ~np.isnan(picked)
                counts[key][at] += int(known.sum())
                sums[key][at] += float(picked[known].sum())
    return [(*k, draw, float(sums[k][at] / counts[k][at]) if counts[k][at] else None) for k in pools for at, draw in enumerate(draws)]


def _drawn_in_chunks(placed: DataFrame, size: DataFrame, by: list[str], value: str, draws: int, seed: int, chunks: int = 128) -> DataFrame:
    """Means (by, draw, m) from values that are packed into arrays and shuffled once to every chunk of draws: 8 bytes a value and chunk, no row for a slot of a draw."""
    import numpy as np

    chunks = max(min(chunks, draws), 1)
    block = F.floor(F.col("__i") / SLOT_BLOCK).alias("__block")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("__i", F.col(value).cast("double").alias("v")))), lambda x: F.coalesce(x["v"], F.lit(float("nan"))))
    packs = cut_lineage(placed.groupBy(*by, block).agg(ordered.alias("__values")))
    sent = packs.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(chunks, "__chunk")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name in by)

    def run(frame):
        import pandas as pd

        pools: dict = {}
        for row in frame.sort_values("__block")[[*by, "__values"]].itertuples(index=False):
            pools.setdefault(tuple(None if pd.isna(k) else k for k in row[:-1]), []).append(row[-1])
        pools = {k: np.concatenate(v).astype(float) for k, v in pools.items()}
        mine = range(int(frame["__chunk"].iloc[0]), draws, chunks)
        return pd.DataFrame(_means(pools, list(mine), seed), columns=[*by, "draw", "m"])

    return sent.groupBy("__chunk").applyInPandas(run, f"{fields}, draw bigint, m double")


def event_differences(df: DataFrame, by: list[str], event: str, y: str, a: str, b: str) -> DataFrame:
    """Per event the MAE of `a` less the MAE of `b`, over hours where all three are finite."""
    ok = num.is_finite(F.col(y)) & num.is_finite(F.col(a)) & num.is_finite(F.col(b))
    err = lambda c: F.avg(F.abs(F.col(c) - F.col(y)))
    return df.where(ok).groupBy(*by, event).agg((err(a) - err(b)).alias("diff"), F.count(F.lit(1)).alias("n_obs"))


def medians(df: DataFrame, by: list[str], column: str, out: str = "median") -> DataFrame:
    """Median of groups of any size."""
    return running.exact_quantiles(df, by, column, [0.5]).select(*by, F.col("q").alias(out))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
