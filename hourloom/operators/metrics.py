"""Forecast scores: errors, pinball loss, coverage, grouped summaries, paired comparison.

All scores are plain partial aggregates, so a hot group is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.functions import numeric as num


def abs_error(y: Column, p: Column) -> Column:
    """NULL unless both sides are finite."""
    return F.when(num.is_finite(y) & num.is_finite(p), F.abs(y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(abs_error(y, p))


def mae_rmae(df: DataFrame, by: list[str], y: str, point: str, naives: list[str]) -> DataFrame:
    """MAE of the forecast and each naive, and their ratios (NULL when the naive's is missing or 0)."""
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"), mae(F.col(y), F.col(point)).alias("mae_model"),
        *[mae(F.col(y), F.col(n)).alias(f"mae_{n}") for n in naives],
    )
    return base.select("*", *[num.ratio(F.col("mae_model"), F.col(f"mae_{n}")).alias(f"rmae_vs_{n}") for n in naives])


def rmse_bias(df: DataFrame, by: list[str], y: str, point: str) -> DataFrame:
    """n, MAE, RMSE and mean error over rows with a finite truth."""
    e = F.col(point) - F.col(y)
    return df.where(num.is_finite(F.col(y))).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
    )


def coverage(y: Column, low: Column, high: Column) -> Column:
    """Share of truths inside [low, high]; rows with a missing part are left out."""
    known = y.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.avg(F.when(known, y.between(low, high).cast("double")))


def scored_rows(df: DataFrame, y="y", point="point", naive="naive", lag24="naive_lag24", q="q", nq="naive_q") -> DataFrame:
    """Per-row losses. `q` and `naive_q` are arrays over the quantile grid (NULL in burn-in).

    They are reduced to a few numbers here, before rows are expanded into grouping sets or shuffled. Loss and
    coverage count only rows with a truth, a finite forecast and finite quantiles (`ready`).
    """
    cy, cp = F.col(y), F.col(point)
    edge = lambda a, i: F.try_element_at(F.col(a), F.lit(i))
    ready = cy.isNotNull() & num.is_finite(cp) & num.is_finite(edge(q, 1))
    inside = lambda a: F.when(edge(a, 1).isNotNull() & edge(a, -1).isNotNull(),
                              cy.between(edge(a, 1), edge(a, -1)).cast("double"))
    keep = [c for c in df.columns if c not in (q, nq)]
    return df.select(
        *keep, abs_error(cy, cp).alias("e_model"), abs_error(cy, F.col(naive)).alias("e_naive"),
        abs_error(cy, F.col(lag24)).alias("e_lag24"), (~num.is_finite(cp)).alias("nonfinite"), ready.alias("ready"),
        F.when(ready, num.pinball_mean(cy, F.col(q))).alias("loss_model"),
        F.when(ready, num.pinball_mean(cy, F.col(nq))).alias("loss_naive"),
        F.when(ready, inside(q)).alias("in_model"), F.when(ready, inside(nq)).alias("in_naive"),
    )


def summary_columns() -> list[Column]:
    """The 14-field period summary over `scored_rows`."""
    m, n, l24 = F.avg("e_model"), F.avg("e_naive"), F.avg("e_lag24")
    return [
        F.count(F.lit(1)).alias("n_obs"),
        m.alias("mae_model"), n.alias("mae_naive"), l24.alias("mae_naive_lag24"),
        num.ratio(m, n).alias("rmae_vs_naive"), num.ratio(m, l24).alias("rmae_vs_naive_lag24"),
        F.count_if("nonfinite").alias("n_obs_nonfinite_point"), F.count_if("ready").alias("n_obs_scoreable_crps"),
        F.count_if(F.col("ready") & F.col("loss_model").isNull()).alias("n_crps_model_nan_rows"),
        F.count_if(F.col("ready") & F.col("loss_naive").isNull()).alias("n_crps_naive_nan_rows"),
        F.avg("loss_model").alias("crps_model"), F.avg("loss_naive").alias("crps_naive"),
        F.avg("in_model").alias("coverage90_model"), F.avg("in_naive").alias("coverage90_naive"),
    ]


def summary_period(df: DataFrame, by: list[str]) -> DataFrame:
    return scored_rows(df).groupBy(*by).agg(*summary_columns())


def summary_grouping_sets(df: DataFrame, ts: str, tz: str, inside: str) -> DataFrame:
    """Overall, by local year, by season, and inside/outside events: one pass by grouping sets.

    Rows without an instant form their own (NULL) year and season group.
    """
    keyed = df.withColumn("year", F.year(cal.wall(F.col(ts), tz))).withColumn(
        "season", cal.season(F.month(cal.wall(F.col(ts), tz)))
    ).withColumn("inside", F.col(inside))
    keyed = scored_rows(keyed)
    y, s, i = F.col("year"), F.col("season"), F.col("inside")
    cut = F.when(F.grouping("year") == 0, "year").when(F.grouping("season") == 0, "season").when(
        F.grouping("inside") == 0, "inside").otherwise("overall")
    out = keyed.groupingSets([[], [y], [s], [i]], y, s, i).agg(cut.alias("cut"), *summary_columns())
    label = (
        F.when(F.col("cut") == "year", F.col("year").cast("string")).when(F.col("cut") == "season", F.col("season"))
        .when(F.col("cut") == "inside", F.when(F.col("inside"), "inside").otherwise("outside")).otherwise("all")
    )
    return out.withColumn("label", label).drop("year", "season", "inside")


def select_by_min_metric(scores: DataFrame, metric: str, parameter: str) -> DataFrame:
    """The row with the lowest score; equal scores go to the smallest parameter."""
    return scores.where(num.is_finite(F.col(metric))).orderBy(metric, parameter).limit(1)


def pivot_condition(df: DataFrame, keys: list[str], condition: str, value: str, conditions: list[str]) -> DataFrame:
    """One column per condition; of several values in a cell the smallest stands for the first."""
    return df.groupBy(*keys).pivot(condition, conditions).agg(F.min(value))


def paired_wins(wide: DataFrame, by: list[str], y: str, base: str, others: list[str]) -> DataFrame:
    """MAE differences and win/lose/tie counts against the base, over rows where every condition is known."""
    full = wide.dropna(subset=[y, base, *others])
    e = {c: F.abs(F.col(c) - F.col(y)) for c in (base, *others)}
    out = [F.count(F.lit(1)).alias("n_hours")]
    for c in others:
        out += [
            (F.avg(e[c]) - F.avg(e[base])).alias(f"{c}_minus_{base}_mae"),
            F.count_if(e[c] < e[base]).alias(f"{c}_wins"),
            F.count_if(e[base] < e[c]).alias(f"{c}_loses"),
            F.count_if(e[base] == e[c]).alias(f"{c}_ties"),
        ]
    return full.groupBy(*by).agg(*out)


def by_group_delta_table(df: DataFrame, group: str, y: str, point: str, condition: str, base: str, others: list[str]) -> DataFrame:
    """Per group the MAE under each condition and the difference to the base, sorted by the first difference."""
    scored = df.where(num.is_finite(F.col(y)))
    err = lambda c: F.avg(F.when(F.col(condition) == c, F.abs(F.col(point) - F.col(y))))
    wide = scored.groupBy(group).agg(*[err(c).alias(f"mae_{c}") for c in (base, *others)])
    deltas = [(F.col(f"mae_{c}") - F.col(f"mae_{base}")).alias(f"{c}_minus_{base}_mae") for c in others]
    return wide.select("*", *deltas).orderBy(f"{others[0]}_minus_{base}_mae", group)


def corr_guarded(a: str, b: str) -> Column:
    """Pearson r over complete pairs; NULL with fewer than two pairs or without spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, z = F.when(both, F.col(a)), F.when(both, F.col(b))
    flat = (F.min(x) == F.max(x)) | (F.min(z) == F.max(z))
    return F.when((F.count(x) > 1) & ~flat, F.corr(a, b))


def corr_pair(left: DataFrame, right: DataFrame, by: list[str], ts: str, a: str, b: str) -> DataFrame:
    joined = left.join(right, [*by, ts])
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return joined.groupBy(*by).agg(F.count_if(both).alias("n"), corr_guarded(a, b).alias("r"))


def driver_validation(reference: DataFrame, driver: DataFrame, by: list[str], ts: str, ref: str, avail: str, lost: str) -> DataFrame:
    """Does a derived availability agree with a measured one?

    Overlapping hours, r, the measured p99, and the share of below-p99 hours in which the driver is active.
    """
    from hourloom.operators import running

    p99 = running.exact_quantiles(reference, by, ref, [0.99]).select(*by, F.col("q").alias("p99"))
    rows = reference.join(driver, [*by, ts], "left").join(p99, by, "left")
    below = F.col(ref) < F.col("p99")
    return rows.groupBy(*by).agg(
        F.count_if(F.col(ref).isNotNull() & F.col(avail).isNotNull()).alias("n_overlap"),
        corr_guarded(ref, avail).alias("r"),
        F.max("p99").alias("p99"),
        num.ratio(F.count_if(below & (F.col(lost) > 0)).cast("double"), F.count_if(below).cast("double")).alias("share_active"),
    )


def forecast_shift_rollup(wide: DataFrame, by: list[str], base: str, shifts: dict[str, str], tiny: float = 1e-10) -> DataFrame:
    """Largest |condition - base| per group, with the flag "no shift at all"."""
    out = [F.max(F.abs(F.col(c) - F.col(base))).alias(name) for c, name in shifts.items()]
    return wide.groupBy(*by).agg(*out).select("*", *[(F.col(n) < tiny).alias(f"{n}_none") for n in shifts.values()])


def usage_cost_rollup(calls: DataFrame, by: list[str], prompt: str, completion: str, hit: str, in_price: float, out_price: float) -> DataFrame:
    """Token sums, cost at prices per million tokens, cache hits."""
    p = F.sum(F.coalesce(prompt, F.lit(0)))
    c = F.sum(F.coalesce(completion, F.lit(0)))
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(hit).alias("cache_hits"), p.alias("prompt_tokens"),
        c.alias("completion_tokens"), (p * F.lit(in_price) / 1e6 + c * F.lit(out_price) / 1e6).alias("cost"),
    )


def model_diagnostics_rollup(models: DataFrame, days: DataFrame, keys: list[str], sums: list[str], peak: str) -> DataFrame:
    """Counter sums and the largest coefficient over an explicit list of days, and only those."""
    own = models.join(days.select(*keys).distinct(), keys, "left_semi")
    return own.agg(F.count(F.lit(1)).alias("n_models"), *[F.sum(c).alias(c) for c in sums], F.max(peak).alias(peak))


def explode_strata(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One row per stratum a row belongs to, in a column `stratum`."""
    names = F.array(*[F.when(m, F.lit(n)) for n, m in masks.items()])
    return df.withColumn("stratum", F.explode(F.filter(names, lambda s: s.isNotNull())))
