"""Stratified top-k selection with caps and quotas.

A selection never holds more rows than the targets ask for, so it is small by construction and may be
broadcast; the pools it is taken from are only ranked per unit (with the rank limit applied before the
shuffle) and cut by top-n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.session import cut_lineage


def _best(size: str, row_id: str) -> list[Column]:
    return [F.col(size).desc(), F.col(row_id).asc()]


def take(
    pool: DataFrame, selected: DataFrame | None, n: int, row_id: str, unit: str, size: str, cap: int | None = None
) -> DataFrame:
    """Add up to n rows of the pool, largest first, at most `cap` per unit counting earlier picks.

    Within a unit the rows not yet selected qualify in size order, so the greedy pass equals a rank limit.
    """
    rest = pool
    if selected is not None:
        rest = pool.join(selected.select(row_id), row_id, "left_anti")
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy(unit).orderBy(*_best(size, row_id)))
        rest = rest.withColumn("__rn", rank).where(F.col("__rn") <= cap)
        if selected is not None:
            used = selected.groupBy(unit).agg(F.count(F.lit(1)).alias("__used"))
            rest = rest.join(used, unit, "left").where(
                F.col("__rn") <= F.lit(cap) - F.coalesce("__used", F.lit(0))
            ).drop("__used")
        rest = rest.drop("__rn")
    picked = rest.orderBy(*_best(size, row_id)).limit(max(n, 0)).select(*pool.columns)
    return cut_lineage(picked if selected is None else selected.unionByName(picked))


def topk_per_stratum_capped(
    pool: DataFrame, strata: list[tuple[Column, int, int | None]], row_id: str, unit: str, size: str
) -> DataFrame:
    """Run strata in order: (which rows, how many, cap per unit); picks of one stratum count in the next.

    The pool is read once, for the rows that a stratum can take whatever was picked before: per unit its `cap` best rows, and of those the best `n` plus one for
    each earlier pick, as a pick takes at most one row from a later stratum (itself, or the last of its unit's share). Strata then run over that short list.
    """
    masks = [F.coalesce(mask, F.lit(False)) for mask, _, _ in strata]
    asked = [max(n, 0) for _, n, _ in strata]
    marked = pool.withColumn("__k", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in enumerate(masks)]))))
    best = None
    for capped in (True, False):
        group = [k for k, (_, _, cap) in enumerate(strata) if (cap is not None) == capped]
        if not group:
            continue
        rows = marked.where(F.col("__k").isin(group))
        if capped:
            caps = F.create_map(*[F.lit(x) for k in group for x in (k, strata[k][2])])
            rank = F.row_number().over(Window.partitionBy("__k", unit).orderBy(*_best(size, row_id)))
            rows = rows.withColumn("__rn", rank).where(F.col("__rn") <= max(strata[k][2] for k in group)).where(F.col("__rn") <= caps[F.col("__k")]).drop("__rn")
        best = rows if best is None else best.unionByName(rows)
    if best is None:
        return pool.limit(0)
    short = F.create_map(*[F.lit(x) for k in range(len(strata)) for x in (k, sum(asked[: k + 1]))])
    place = F.row_number().over(Window.partitionBy("__k").orderBy(*_best(size, row_id)))
    best = best.withColumn("__at", place).where(F.col("__at") <= sum(asked)).where(F.col("__at") <= short[F.col("__k")]).drop("__at")
    best = cut_lineage(best)
    selected = None
    for k, (_, n, cap) in enumerate(strata):
        selected = take(best.where(F.col("__k") == k).drop("__k"), selected, n, row_id, unit, size, cap)
    return selected


def _ranked(df: DataFrame, order: list[Column], out: str = "__i") -> DataFrame:
    """Positions in a selection (a handful of rows)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def topk_swap_quota(pool: DataFrame, selected: DataFrame, flag: Column, quota: int, row_id: str, size: str) -> DataFrame:
    """If fewer than `quota` selected rows carry the flag, the best flagged rows left replace the smallest unflagged."""
    flag = F.coalesce(flag, F.lit(False))
    have = selected.agg(F.count_if(flag).alias("n")).select("n").scalar()
    spare = pool.where(flag).join(F.broadcast(selected.select(row_id)), row_id, "left_anti")
    spare = _ranked(spare.orderBy(*_best(size, row_id)).limit(quota), _best(size, row_id))
    spare = spare.where(F.col("__i") <= F.lit(quota) - have)
    weak = _ranked(selected.where(~flag), [F.col(size).asc(), F.col(row_id).asc()])
    pairs = cut_lineage(weak.select("__i", F.col(row_id).alias("__out")).join(spare, "__i"))
    kept = selected.join(pairs.select(F.col("__out").alias(row_id)), row_id, "left_anti")
    return cut_lineage(kept.unionByName(pairs.select(*selected.columns)))


def _swaps(rows, cut: dict, used: dict, weak: dict, missing: int, cap: int):
    """Fold over candidates in order: (swaps as (in, out), last position looked at, whether more candidates have to be read first).

    rows (at, id, unit, class, is_capped); cut: unit -> position after which its candidates were not read; used: picks per unit; weak: class -> [(unit, id)],
    the weakest first.
    """
    swaps, last = [], None
    for at, row_id, unit, kind, is_capped in rows:
        if len(swaps) == missing:
            break
        # a unit below its cap whose candidates end before this one may have a better one that was not read
        if any(end < at and used.get(u, 0) < cap for u, end in cut.items()):
            return swaps, last, True
        last = at
        if not weak.get(kind) or (is_capped and used.get(unit, 0) >= cap):
            continue
        out_unit, out_id = weak[kind].pop(0)
        used[out_unit] = used.get(out_unit, 0) - 1
        used[unit] = used.get(unit, 0) + 1
        swaps.append((row_id, out_id))
    return swaps, last, False


def topk_swap_same_kind(
    pool: DataFrame, selected: DataFrame, flag: Column, quota: int, row_id: str, unit: str, size: str,
    alike: list[str], capped: Column, cap: int,
) -> DataFrame:
    """Quota by replacement inside the same kind: candidates in size order replace the smallest unflagged
    selected row that is `alike`; a candidate whose unit is at its cap (where `capped` applies) is passed over.

    The swaps depend on each other, so they are folded in order, over a list bounded by the sizes of the selection and the quota: of units without
    a pick the best rows of each kind, of the others the best of each unit and kind. One read of the pool, unless a unit gets below
    its cap after all its candidates on the list were passed over; then the fold goes on with a list that begins there.
    """
    flag = F.coalesce(flag, F.lit(False))
    columns = selected.columns
    place = F.struct((-F.col(size)).alias("s"), F.col(row_id).alias("i"))
    kind = F.struct(*alike)
    picks = selected.select(
        place.alias("at"), F.col(row_id).alias("id"), F.col(unit).alias("unit"), kind.alias("kind"), flag.alias("flag")).collect()  # the selection
    missing = quota - sum(r.flag for r in picks)
    used: dict = {}
    weak: dict = {}
    for r in sorted(picks, key=lambda r: (-r.at.s, r.id)):
        used[r.unit] = used.get(r.unit, 0) + 1
        if not r.flag:
            weak.setdefault(tuple(r.kind), []).append((r.unit, r.id))
    taken = F.broadcast(selected.select(row_id))
    candidates = pool.where(flag).join(taken, row_id, "left_anti").select(
        place.alias("at"), F.col(row_id).alias("id"), F.col(unit).alias("unit"), kind.alias("kind"), F.coalesce(capped, F.lit(False)).alias("capped"))
    swaps, after, more = [], None, missing > 0
    while more and len(swaps) < missing:
        need = missing - len(swaps)
        left = candidates if after is None else candidates.where(
            F.col("at") > F.struct(F.lit(after.s).alias("s"), F.lit(after.i).alias("i")))
        kinds = [F.struct(*[F.lit(v).alias(c) for v, c in zip(k, alike)]) for k, w in weak.items() if w]
        if not kinds:
            break
        mask = F.lit(False)
        for k in kinds:
            mask = mask | F.col("kind").eqNullSafe(k)
        known = F.col("unit").isin([u for u in used if u is not None]) | F.lit(None in used) & F.col("unit").isNull()
        by_unit = Window.partitionBy("unit", "kind").orderBy("at")
        best = left.where(mask).withColumn("known", F.coalesce(known, F.lit(False))).withColumn("rank", F.row_number().over(by_unit)).where(
            F.col("rank") <= need + 1)
        free = best.where(~F.col("known")).withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("at"))).where(F.col("rank") <= need)
        rows = sorted(best.where("known").unionByName(free).collect(), key=lambda r: (r.at.s, r.at.i))
        ends: dict = {}
        for r in rows:
            if r.known and r["rank"] > need:  # more rows of this unit and kind may follow
                ends[r.unit] = min(ends.get(r.unit, r.at), r.at)
        done, last, more = _swaps([(r.at, r.id, r.unit, tuple(r.kind), r.capped) for r in rows], ends, used, weak, need, cap)
        swaps += done
        after = last or after
    if not swaps:
        return selected
    spark = pool.sparkSession
    pair = spark.createDataFrame(swaps, f"`__in` {pool.schema[row_id].dataType.simpleString()}, `__out` {pool.schema[row_id].dataType.simpleString()}")
    came = pool.join(pair.select(F.col("__in").alias(row_id)), row_id, "left_semi").select(*columns)
    return cut_lineage(selected.join(pair.select(F.col("__out").alias(row_id)), row_id, "left_anti").select(*columns).unionByName(came))
