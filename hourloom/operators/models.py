"""Many small sparse models: fitting as a grouped map, prediction and what-if overrides as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions import numeric as num
from hourloom.session import cut_lineage

MODEL_FIELDS = (
    "refit_day date, hour int, intercept double, y_median double, y_mad double, "
    "terms array<struct<feature:string,coef:double,x_median:double,x_mad:double>>, n_features int, n_rows int, "
    "n_ffill int, n_bfill int, n_degenerate int, n_failed int, n_runaway int, max_abs_coef double, ridge_variance boolean, "
    "penalty double, violation double, aic double, aic_before double, aic_after double"
)
STATIONARY = 1e-6  # largest violation, as a share of the largest product of inputs and target


def _fit_block(keys: list[str], window: int):
    """The per-group function: fit every refit day of a block from the block's shared calibration rows."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        from hourloom.functions import lasso

        pdf = pdf.sort_values("day")
        # a day may lack features whose source day is missing: align on all names of the block
        table = pd.DataFrame([dict(zip(n, v)) for n, v in zip(pdf["names"], pdf["x"])], dtype=float).sort_index(axis=1)
        names = list(table.columns)
        day = pd.to_datetime(pdf["day"]).to_numpy()
        x_all = table.to_numpy()
        y_all = np.array([[np.nan if v is None else v for v in row] for row in pdf["y"]], dtype=float)
        out = []
        for refit in pdf["refits"].iloc[0]:
            d0 = np.datetime64(pd.Timestamp(refit))
            rows = (day < d0) & (day >= d0 - np.timedelta64(window, "D"))
            if not rows.any():
                continue
            raw = pd.DataFrame(x_all[rows])
            forward = raw.ffill()
            x = forward.bfill().to_numpy()
            gaps = [int(f.isna().sum().sum()) for f in (raw, forward, forward.bfill())]
            x = np.where(np.isnan(x), 0.0, x)
            y = y_all[rows]
            med = np.median(x, axis=0)
            mad = np.median(np.abs(x - med), axis=0)
            z = np.arcsinh((x - med) / np.where(mad < 1e-8, 1.0, mad))
            known = ~np.isnan(y)
            for mask in {known[:, h].tobytes() for h in range(24)}:
                hours = [h for h in range(24) if known[:, h].tobytes() == mask]
                ok = known[:, hours[0]]
                ridge = bool(ok.sum() <= z.shape[1] + 1)
                base = dict.fromkeys(hours, (np.zeros(z.shape[1]), 0.0, 1, 0, 0, [None] * 5))
                if ok.sum() >= lasso.MIN_ROWS:
                    t = y[np.ix_(ok, hours)]
                    tm = np.median(t, axis=0)
                    tmad = np.median(np.abs(t - tm), axis=0)
                    got = lasso.fit(z[ok], np.arcsinh((t - tm) / np.where(tmad < 1e-8, 1.0, tmad)))
                    proofs = np.array([got.penalty, got.violation, got.aic, got.aic_before, got.aic_after])
                    for k, h in enumerate(hours):
                        proof = [None if np.isnan(v) else float(v) for v in proofs[:, k]]
                        base[h] = (got.coef[:, k], float(got.intercept[k]), 0, int(got.failed[k]), int(got.runaway[k]), proof)
                for h in hours:
                    w, b, degenerate, failed, runaway, proof = base[h]
                    good = y[ok, h]
                    ym = float(np.median(good)) if len(good) else 0.0
                    ymad = float(np.median(np.abs(good - ym))) if len(good) else 1.0
                    terms = [
                        {"feature": names[j], "coef": float(w[j]), "x_median": float(med[j]), "x_mad": float(mad[j])}
                        for j in np.flatnonzero(w)
                    ]
                    out.append([
                        *[pdf[k].iloc[0] for k in keys], pd.Timestamp(refit).date(), h, b, ym, ymad, terms, len(names),
                        int(ok.sum()), gaps[0] - gaps[1], gaps[1] - gaps[2], degenerate, failed, runaway,
                        float(np.abs(w).max()), ridge, *proof,
                    ])
        columns = [*keys, *[f.split()[0] for f in MODEL_FIELDS.split(", ")]]
        return pd.DataFrame(out, columns=columns)

    return run


def fit_many_lasso(
    vectors: DataFrame, targets: DataFrame, refits: DataFrame, by: list[str], window: int, block_days: int = 16
) -> DataFrame:
    """24 sparse models per refit day, penalty chosen by AIC, from the `window` days before it.

    vectors (by, day, names, x) from `feature_vectors`; targets (by, day, y) with 24 values; refits (by, day).
    Refit days are grouped into calendar blocks, so a calibration row is sent once per block that needs it
    rather than once per refit day. A group holds at most window + block_days rows, whatever the data size.
    """
    index = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    blocks = refits.select(*by, "day").distinct().withColumn("__block", F.floor(index(F.col("day")) / block_days))
    blocks = blocks.groupBy(*by, "__block").agg(F.sort_array(F.collect_list("day")).alias("refits"))
    rows = vectors.join(targets, [*by, "day"])
    first, last = F.floor((index(F.col("day")) + 1) / block_days), F.floor((index(F.col("day")) + window) / block_days)
    sent = rows.withColumn("__block", F.explode(F.sequence(first, last))).join(blocks, [*by, "__block"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema if f.name in by)
    schema = f"{fields}, {MODEL_FIELDS}" if fields else MODEL_FIELDS
    return sent.groupBy(*by, "__block").applyInPandas(_fit_block(by, window), schema)


def certified(tolerance: float = STATIONARY) -> Column:
    """Is a fitted model the lasso's solution at its penalty, and its AIC no larger than that of the breakpoints next to it?

    True for models without a fit (too few rows), which promise nothing; false for models that were given up.
    """
    least = (F.col("aic") <= F.coalesce("aic_before", "aic")) & (F.col("aic") <= F.coalesce("aic_after", "aic"))
    return (F.col("n_degenerate") == 1) | F.coalesce((F.col("violation") <= tolerance) & least, F.lit(False))


def day_diagnostics(models: DataFrame, by: list[str]) -> DataFrame:
    """Counters per (by, refit_day): hours that are degenerate, given up or refitted, cells filled, ridge variance, largest coefficient."""
    return models.groupBy(*by, "refit_day").agg(
        F.sum("n_degenerate").alias("n_degenerate_hours"), F.sum("n_failed").alias("n_failed_hours"), F.sum("n_runaway").alias("n_runaway_hours"),
        F.max("n_ffill").alias("n_ffill"), F.max("n_bfill").alias("n_bfill"), F.max(F.col("ridge_variance").cast("int")).alias("n_ridge"),
        F.max("max_abs_coef").alias("max_abs_coef"),
    )


def model_terms(models: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Non-zero coefficients as rows (by, day, hour, feature, coef, x_median, x_mad)."""
    return models.select(*by, day, "hour", F.inline("terms"))


def model_heads(models: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    return models.select(*by, day, "hour", "intercept", "y_median", "y_mad")


def _z(value: Column) -> Column:
    return num.robust_scale(F.coalesce(value, F.col("x_median")), F.col("x_median"), F.col("x_mad"))


def linear_scores(features: DataFrame, terms: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    """Scaled linear score per (by, day, hour): intercept + sum of coef * scaled input.

    features (by, day, feature, value); a missing input counts as its calibration median. Only the non-zero
    coefficients travel.
    """
    cells = terms.join(features, [*by, "day", "feature"], "left")
    sums = cells.groupBy(*by, "day", "hour").agg(F.sum(F.col("coef") * _z(F.col("value"))).alias("__s"))
    return heads.join(sums, [*by, "day", "hour"], "left").select(
        *by, "day", "hour", (F.col("intercept") + F.coalesce("__s", F.lit(0.0))).alias("score"), "y_median", "y_mad"
    )


def level(scores: DataFrame, out: str = "point") -> DataFrame:
    """Score -> forecast in the target's own units."""
    value = num.robust_unscale(F.col("score"), F.col("y_median"), F.col("y_mad"))
    return scores.withColumn(out, value).drop("score", "y_median", "y_mad")


def predict_linear(features: DataFrame, terms: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    return level(linear_scores(features, terms, heads, by))


def override_feature(series: Column, hour: Column) -> Column:
    return F.concat(series, F.format_string("_d_h%02d", hour.cast("int")))


def what_if_scores(
    scores: DataFrame, overrides: DataFrame, features: DataFrame, terms: DataFrame, by: list[str], scenario: list[str]
) -> DataFrame:
    """Scores under overrides of one driver's same-day block.

    overrides (scenario..., by, day, series, hour, value). The linear part is additive, so a scenario is the base
    score plus the change of at most 24 inputs; the other inputs are not read again. Lags stay as they are.
    """
    changed = overrides.select(
        *scenario, *by, "day", override_feature(F.col("series"), F.col("hour")).alias("feature"), F.col("value").alias("__new")
    )
    cells = changed.join(terms, [*by, "day", "feature"]).join(features, [*by, "day", "feature"], "left")
    # a missing override leaves the input as it was
    delta = F.col("coef") * (_z(F.coalesce("__new", "value")) - _z(F.col("value")))
    sums = cells.groupBy(*scenario, *by, "day", "hour").agg(F.sum(delta).alias("__d"))
    asked = overrides.select(*scenario, *by, "day").distinct()
    return asked.join(scores, [*by, "day"]).join(sums, [*scenario, *by, "day", "hour"], "left").select(
        *scenario, *by, "day", "hour", (F.col("score") + F.coalesce("__d", F.lit(0.0))).alias("score"), "y_median", "y_mad"
    )


# ------------------------------------------------------------ scenario paths
def signed(driver_falls: Column, size: Column) -> Column:
    """A generation outage lowers its driver, an import restriction raises it."""
    return F.when(driver_falls, -size).otherwise(size)


def effect_to_paths(base: DataFrame, effects: DataFrame, keys: list[str], n_paths: int, seed: int) -> DataFrame:
    """Driver paths sampled from bounded effects: (keys, path, hour, value).

    base (keys, hour, value); effects (keys, falls, direction, p_active, start_mean, start_sd, end_mean, end_sd,
    p10, p50, p90). All draws are hashes of the key and path, so a retried task gives the same path.
    """
    draws = effects.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))))
    draws = draws.select(*keys, "path", _draw(keys, F.col("path"), seed).alias("__d"))
    hit = _hit(F.col("__d"), F.col("hour"))
    return draws.join(base, keys).select(
        *keys, "path", "hour", (F.col("value") + F.when(hit, F.col("__d.shift")).otherwise(F.lit(0.0))).alias("value")
    )


def _draw(keys: list[str], path: Column, seed: int) -> Column:
    """One draw of an effect: whether it is active, its first hour, the hour after its last, its signed size."""
    u = lambda tag: num.uniform(F.lit(seed), *[F.col(k) for k in keys], path, F.lit(tag))
    bound = lambda m, s, a, b: F.least(F.greatest(
        F.when(F.col(s) == 0, F.col(m)).otherwise(F.col(m) + F.col(s) * num.std_normal(u(a), u(b))), F.lit(0.0)), F.lit(24.0))
    x, y = bound("start_mean", "start_sd", "s1", "s2"), bound("end_mean", "end_sd", "e1", "e2")
    on = (F.col("direction") != "none") & (u("active") <= F.col("p_active"))
    size = num.triangular(u("size"), F.col("p10"), F.col("p50"), F.col("p90"))
    return F.struct(
        on.alias("active"), F.floor(F.least(x, y)).alias("first"), F.ceil(F.greatest(x, y)).alias("after"), signed(F.col("falls"), size).alias("shift"))


def _hit(draw: Column, hour: Column) -> Column:
    return draw["active"] & (hour >= draw["first"]) & (hour < draw["after"])


def path_scores(
    scores: DataFrame, base: DataFrame, effects: DataFrame, drivers: DataFrame, features: DataFrame, terms: DataFrame, keys: list[str], n_paths: int, seed: int,
    along: list[str] | None = None,
) -> DataFrame:
    """What `what_if_scores` gives for the driver as it stands and for each path of `effect_to_paths`, side by side.

    (keys, hour, score, held, scores by path, y_median, y_mad): `score` without an override, `held` with that of `base` (keys, hour, value). An hour
    outside a path's effect changes its inputs as the base does, so paths do not become rows. scores, features and terms are those of one target (by day);
    drivers (keys, series) may have more columns, of which those of `along` are passed on.
    """
    also = along or []
    drawn = effects.select(*keys, *[_draw(keys, F.lit(k), seed).alias(f"__p{k}") for k in range(n_paths)])
    # all partitions are kept: merged ones, of rows that compress well, would hold the sums of millions of hours each
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = base.select(*keys, "hour", "value").repartition(parts, *keys).join(drivers.select(*keys, "series", *also), keys)
    at = F.col("hour")
    changed = placed.join(drawn, keys, "left").select(
        *keys, override_feature(F.col("series"), at).alias("feature"), F.col("value").alias("__base"),
        *[_hit(F.col(f"__p{k}"), at).alias(f"__h{k}") for k in range(n_paths)], *[(F.col("value") + F.col(f"__p{k}.shift")).alias(f"__v{k}") for k in range(n_paths)])
    cells = changed.join(_same_day_inputs(features, terms), ["day", "feature"]).withColumn("__d", _change(F.col("__base")))
    sums = cells.groupBy(*keys, "hour").agg(
        F.sum("__d").alias("__d"), *[F.sum(F.when(F.col(f"__h{k}"), _change(F.col(f"__v{k}"))).otherwise(F.col("__d"))).alias(f"__d{k}") for k in range(n_paths)])
    asked = placed.select(*keys, *also).distinct().join(local_table(scores), "day")
    moved = lambda name: F.col("score") + F.coalesce(name, F.lit(0.0))
    return asked.join(sums, [*keys, "hour"], "left").select(
        *keys, *also, "hour", "score", moved("__d").alias("held"), F.array(*[moved(f"__d{k}") for k in range(n_paths)]).alias("scores"), "y_median", "y_mad")


def path_conditions(scores: DataFrame, n_paths: int, documented: Column, keys: list[str]) -> DataFrame:
    """The three conditions of `conditions_union` from the scores of `path_scores`."""
    value = lambda c: num.robust_unscale(c, F.col("y_median"), F.col("y_mad"))
    mean = sum((value(F.col("scores")[k]) for k in range(1, n_paths)), value(F.col("scores")[0])) / F.lit(n_paths)
    return _conditions(scores.select(*keys, "hour", value(F.col("held")).alias("__base"), value(F.col("score")).alias("__orc"), mean.alias("__ctx"), documented.alias("__doc")), keys)


def conditions_union(
    baseline: DataFrame, oracle: DataFrame, paths: DataFrame, documented: DataFrame, keys: list[str]
) -> DataFrame:
    """Forecasts (keys, hour, condition, point): no_context, oracle, and context as the mean over paths.

    Without a document by the forecast origin (`documented (keys)`) the context forecast is the baseline.
    """
    known = documented.select(*keys).distinct().withColumn("__doc", F.lit(True))
    mean = paths.groupBy(*keys, "hour").agg(F.avg("point").alias("__ctx"))
    rows = baseline.select(*keys, "hour", F.col("point").alias("__base")).join(
        oracle.select(*keys, "hour", F.col("point").alias("__orc")), [*keys, "hour"]
    ).join(mean, [*keys, "hour"], "left").join(known, keys, "left")
    return _conditions(rows, keys)


def _conditions(rows: DataFrame, keys: list[str]) -> DataFrame:
    context = F.when(F.col("__doc"), F.coalesce("__ctx", "__base")).otherwise(F.col("__base"))
    three = F.array(
        F.struct(F.lit("no_context").alias("condition"), F.col("__base").alias("point")),
        F.struct(F.lit("context").alias("condition"), context.alias("point")),
        F.struct(F.lit("oracle").alias("condition"), F.col("__orc").alias("point")),
    )
    return rows.select(*keys, "hour", F.inline(three))


def block_paths(base: DataFrame, events: DataFrame, keys: list[str], max_width: int = 24) -> DataFrame:
    """All 24 placements of a block of the declared size and width on the day, wrapping at midnight.

    base (keys, hour, value); events (keys, falls, size, width_hours). Draws only choose among these placements.
    """
    width = F.least(F.greatest(F.ceil("width_hours"), F.lit(1)), F.lit(max_width))
    placed = events.select(
        *keys, width.alias("width"), signed(F.col("falls"), F.col("size")).alias("__shift"),
        F.explode(F.sequence(F.lit(0), F.lit(23))).alias("start_hour"),
    )
    inside = F.pmod(F.col("hour") - F.col("start_hour"), F.lit(24)) < F.col("width")
    return placed.join(base, keys).select(
        *keys, "start_hour", "hour", "width",
        (F.col("value") + F.when(inside, F.col("__shift")).otherwise(F.lit(0.0))).alias("value"),
    )


LOCAL_CELLS = 200_000  # so many same-day coefficients (days x drivers x 576 at most) are sent to every task; more are met by a join


def local_table(rows: DataFrame) -> DataFrame:
    """The rows, written once; a table of at most LOCAL_CELLS of them is sent to every task that joins it."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= LOCAL_CELLS else rows


def _same_day_inputs(features: DataFrame, terms: DataFrame) -> DataFrame:
    inputs = terms.where(F.col("feature").rlike("_d_h[0-9]{2}$")).join(features, ["day", "feature"], "left")
    return local_table(inputs.select("day", "feature", F.col("hour"), "coef", _z(F.col("value")).alias("__z"), "x_median", "x_mad"))


def _change(new: Column) -> Column:
    """Of a score, if an input of `_same_day_inputs` becomes `new`; a missing one leaves the input as it was."""
    return F.coalesce(F.col("coef") * (num.robust_scale(new, F.col("x_median"), F.col("x_mad")) - F.col("__z")), F.lit(0.0))


def block_scores(
    scores: DataFrame, base: DataFrame, events: DataFrame, drivers: DataFrame, features: DataFrame, terms: DataFrame, keys: list[str], max_width: int = 24
) -> DataFrame:
    """What `what_if_scores` gives for each placement of `block_paths`, side by side: (keys, hour, scores by start hour, y_median, y_mad).

    An hour of the driver has two values only, outside and inside the block. The change of both is found once and the 24 placements are sums over them, so
    neither placements nor their hours become rows. scores, features and terms are those of one target (by day); drivers (keys, series).
    """
    width = F.least(F.greatest(F.ceil("width_hours"), F.lit(1)), F.lit(max_width))
    declared = events.select(*keys, width.alias("__width"), signed(F.col("falls"), F.col("size")).alias("__shift"))
    placed = base.select(*keys, "hour", "value").join(declared, keys).join(drivers.select(*keys, "series"), keys)
    changed = placed.select(
        *keys, "__width", "__shift", F.col("hour").alias("__at"), override_feature(F.col("series"), F.col("hour")).alias("feature"), F.col("value").alias("__base"))
    inputs = _same_day_inputs(features, terms)
    cells = changed.join(inputs, ["day", "feature"]).select(
        *keys, "hour", "__at", "__width", _change(F.col("__base") + F.lit(0.0)).alias("__out"), _change(F.col("__base") + F.col("__shift")).alias("__in"))
    inside = lambda start: F.pmod(F.col("__at") - start, F.lit(24)) < F.col("__width")
    sums = cells.groupBy(*keys, "hour").agg(*[F.sum(F.when(inside(k), F.col("__in")).otherwise(F.col("__out"))).alias(f"__d{k}") for k in range(24)])
    asked = placed.select(*keys).distinct().join(scores, "day")
    change = F.array(*[F.col("score") + F.coalesce(f"__d{k}", F.lit(0.0)) for k in range(24)])
    return asked.join(sums, [*keys, "hour"], "left").select(*keys, "hour", change.alias("scores"), "y_median", "y_mad")


def block_points(scores: DataFrame, keys: list[str]) -> DataFrame:
    """`level` of the placements' scores: (keys, hour, points by start hour)."""
    value = lambda k: num.robust_unscale(F.col("scores")[k], F.col("y_median"), F.col("y_mad"))
    return scores.select(*keys, "hour", F.array(*[value(k) for k in range(24)]).alias("points"))


def random_block_control(
    placements: DataFrame, scored: DataFrame, keys: list[str], draws: int, seed: int
) -> DataFrame:
    """Per event-day: how random blocks of the declared size fare against the forecast that read documents.

    placements (keys, hour, points by start hour), or (keys, start_hour, hour, point); scored (keys, hour, y, baseline, context). Every draw picks one of 24
    placements by hash; predictions are made once per placement and weighted by how often it is drawn. Placements stay side by side, so a row is an hour of an event-day.
    """
    if "start_hour" in placements.columns:
        at = lambda k: F.max(F.when(F.col("start_hour") == k, F.col("point")))
        placements = placements.groupBy(*keys, "hour").agg(F.array(*[at(k) for k in range(24)]).alias("points"))
    u = num.uniform(F.lit(seed), *[F.col(k) for k in keys], F.col("draw"))
    picks = scored.select(*keys).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(
        *keys, F.floor(u * 24).cast("int").alias("start_hour")
    )
    weights = picks.groupBy(*keys).agg(F.array(*[F.count_if(F.col("start_hour") == k) for k in range(24)]).alias("__w"))
    truth = scored.where(num.is_finite(F.col("y")))
    err = lambda c: F.abs(F.col(c) - F.col("y"))
    own = truth.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_hours"), F.avg(err("baseline")).alias("baseline_mae"), F.avg(err("context")).alias("context_mae"),
        F.max(F.abs(F.col("context") - F.col("baseline"))).alias("max_context_shift"),
    )
    rows = placements.join(truth.select(*keys, "hour", "y"), [*keys, "hour"]).join(weights, keys)
    drawn_sum = F.lit(0.0)
    for k in range(24):
        drawn_sum = drawn_sum + F.coalesce(F.when(F.col("__w")[k] > 0, F.col("points")[k] * F.col("__w")[k]), F.lit(0.0))
    spread = rows.groupBy(*keys).agg(
        F.avg(F.abs(drawn_sum / F.lit(draws) - F.col("y"))).alias("random_mean_mae"), F.first("__w").alias("__w"),
        F.array(*[F.avg(F.abs(F.col("points")[k] - F.col("y"))) for k in range(24)]).alias("__maes"),
    )
    # one value per draw (a fixed number), so the exact percentile is bounded
    drawn = spread.join(own.select(*keys, "context_mae"), keys).select(
        *keys, "random_mean_mae", "context_mae", F.inline(F.arrays_zip(F.col("__maes").alias("mae"), F.col("__w").alias("w")))).where("w > 0")
    q = lambda p: F.percentile("mae", F.lit(p), F.col("w")).alias(f"random_p{int(p * 100):02d}")
    compared = drawn.groupBy(*keys).agg(
        F.first("random_mean_mae").alias("random_mean_mae"), (F.sum(F.col("mae") * F.col("w")) / F.lit(draws)).alias("random_single_mean"), q(0.05), q(0.5), q(0.95),
        (F.sum(F.when(F.col("mae") < F.col("context_mae"), F.col("w")).otherwise(F.lit(0))) / F.lit(draws)).alias("p_random_beats_context"),
    )
    return own.join(compared, keys, "left")
