"""The event-hour panel and everything judged on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.functions import numeric as num
from hourloom.operators import inference, metrics, models, relations, running, timeline
from hourloom.session import cut_lineage

HIGH_SENSITIVITY = 0.10
DIFFERS = 1e-10
WORSENING = 100.0  # MW


def scenario_forecasts(
    event_days: DataFrame, realised: DataFrame, gates: DataFrame, features: DataFrame, terms: DataFrame, heads: DataFrame,
    worsening: float = WORSENING,
) -> DataFrame:
    """Forecasts of a day's model (driver, kind, day, hour, baseline, oracle, perturbed), two what-if runs beside the plain one.

    event_days (driver, kind, day); realised (driver, day, hour, value) and gates (driver, day, value) are the driver's profile and what was
    known of it at the forecast origin; features (day, feature, value) hold the drivers as known; terms and heads as of `models`.
    The oracle sees the realised driver. `perturbed` sees the known one made worse by `worsening`: less generation, or more import
    unavailable. A scenario hangs on the driver, the kind and the day, so events that share them share its forecasts. Days without a model have no rows.
    """
    asked = models.local_table(event_days.select("driver", "kind", "day").distinct())
    scores = cut_lineage(models.linear_scores(features, terms, heads, []))
    step = models.signed(F.col("kind") == "generation", F.lit(float(worsening)))
    held = relations.cross_join_expand(asked.join(gates.select("driver", "day", "value"), ["driver", "day"], "left"), "hour", 24)
    runs = asked.join(realised.select("driver", "day", "hour", "value"), ["driver", "day"]).select(
        F.lit("oracle").alias("scenario"), "driver", "kind", "day", "hour", "value",
    ).unionByName(held.select(F.lit("perturbed").alias("scenario"), "driver", "kind", "day", "hour", (F.col("value") + step).alias("value")))
    keys = ["driver", "kind"]
    changed = models.level(models.what_if_scores(
        scores, runs.withColumn("series", F.col("driver")), features, terms, [], ["scenario", *keys]))
    at = lambda name: F.max(F.when(F.col("scenario") == name, F.col("point")))
    both = changed.groupBy(*keys, "day", "hour").agg(at("oracle").alias("oracle"), at("perturbed").alias("perturbed"))
    plain = asked.join(models.level(scores, "baseline"), "day")
    return plain.join(both, [*keys, "day", "hour"], "left").select(*keys, "day", "hour", "baseline", "oracle", "perturbed")


def event_hour_panel(
    events: DataFrame, drivers: DataFrame, gates: DataFrame, actuals: DataFrame, forecasts: DataFrame, tz: str
) -> DataFrame:
    """One row per event, local day with a model, and hour.

    events (event_id, kind, driver, reduction, start, end); drivers (driver, day, hour, value) realised;
    gates (driver, day, value) known at the forecast origin; actuals (day, hour, y, stored);
    forecasts (driver, kind, day, hour, baseline, oracle) as of `scenario_forecasts`: a day they lack has no model and stays out.
    These four grow with the calendar, not with events: event-hours are not shuffled to meet them while they are short (`models.local_table`).
    """
    drivers, gates, actuals, forecasts = map(models.local_table, (drivers.withColumnRenamed("value", "driver_realised"), gates.select(
        "driver", "day", F.col("value").alias("driver_persistence")), actuals, forecasts.drop("perturbed")))
    days = timeline.event_days(events, "start", "end", tz)
    covered = days.join(models.local_table(forecasts.select("day").distinct()), "day", "left_semi")
    rows = relations.cross_join_expand(covered, "hour", 24)
    rows = relations.hour_interval_overlap(rows, "day", "hour", "start", "end", tz)
    rows = rows.withColumn("hour_start", cal.hour_label(F.col("day"), F.col("hour"), tz))
    rows = (
        rows.join(drivers, ["driver", "day", "hour"], "left")
        .join(gates, ["driver", "day"], "left")
        .join(actuals, ["day", "hour"], "left")
        .join(forecasts, ["driver", "kind", "day", "hour"], "left")
    )
    return rows.withColumn("driver_delta", F.col("driver_realised") - F.col("driver_persistence")).withColumn(
        "price_delta", F.col("oracle") - F.col("baseline")
    )


# Names of the checks and texts of their failures.
CHECKS = {
    "model_coverage": "no model for this day",
    "feature_wiring": "missing features: ",
    "baseline_persistence": "baseline driver differs from the value known at the forecast origin",
    "oracle_path": "oracle driver differs from the realised profile",
    "generation_sign": "driver injection has wrong sign or size",
    "transmission_sign": "driver injection has wrong sign or size",
    "event_interval_alignment": "an hour that the clock skips has a realised target",
}


def audit_results(
    event_days: DataFrame, panel: DataFrame, expected_gate: DataFrame, expected_profile: DataFrame, features: DataFrame, injected: DataFrame
) -> DataFrame:
    """What each of the seven mechanical checks found on each event-day: (check, event_id, day, passed, failures array of (hour, detail)).

    event_days (event_id, kind, day) are all that were asked for, panel those with a model. The others are made by other routes than the panel:
    expected_gate (driver, day, gate_expected), expected_profile (driver, day, hour, profile_expected), injected (event_id, day, hour, value), the driver's
    path with the declared reduction; features (day, feature) are the names that the day's model knows. One pass over the panel; an event-day
    has 24 rows. Missing on both sides counts as equal, missing on one side as different. Both panel and paths are added up per event-day, an hour to a bit or
    to a column, before they are shuffled to meet: event-hours are not.
    """
    near = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b), a.isNull() & b.isNull())
    known = models.local_table(features.select("day", F.col("feature").alias("__f")).distinct().withColumn("__known", F.lit(True)))
    rows = (
        panel.withColumn("__f", models.override_feature(F.col("driver"), F.col("hour")))
        .join(models.local_table(expected_gate), ["driver", "day"], "left").join(models.local_table(expected_profile), ["driver", "day", "hour"], "left")
        .join(known, ["day", "__f"], "left")
    )
    skipped = F.col("hour_start").isNull() & num.is_finite(F.col("y"))
    hours_where = lambda c: F.coalesce(F.bit_or(F.when(c, F.expr("shiftleft(1, CAST(hour AS INT))"))), F.lit(0))
    by_hour = lambda c, name: [F.max(F.when(F.col("hour") == h, F.col(c))).alias(f"__{name}{h}") for h in range(24)]
    per_day = rows.groupBy("event_id", "day", "kind", "driver").agg(  # sums of fixed width, which a hash aggregate can hold
        hours_where(F.col("__known").isNull()).alias("__unknown"),
        F.every(near(F.col("driver_persistence"), F.col("gate_expected"))).alias("__gate"),
        F.every(near(F.col("driver_realised"), F.col("profile_expected"))).alias("__profile"),
        hours_where(skipped).alias("__at"), F.count(F.lit(1)).alias("__hours"),
        F.max("reduction").alias("__reduction"), *by_hour("driver_persistence", "held"),
    ).join(injected.groupBy("event_id", "day").agg(*by_hour("value", "path")), ["event_id", "day"], "left")
    declared = models.signed(F.col("kind") == "generation", F.col("__reduction"))
    right = [near(F.col(f"__path{h}") - F.col(f"__held{h}"), F.when(F.col(f"__held{h}").isNotNull(), declared)) for h in range(24)]
    hours_in = lambda c: F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.getbit(F.col(c), h) == 1)
    per_day = per_day.select(
        "event_id", "day", "kind", "__gate", "__profile", "__hours", reduce(Column.__and__, right).alias("__sign"), hours_in("__at").alias("__skipped"),
        F.array_sort(F.transform(hours_in("__unknown"), lambda h: models.override_feature(F.col("driver"), h))).alias("__missing"),
    )
    none = F.expr("array()").cast("array<struct<hour:int,detail:string>>")
    one = lambda detail: F.array(F.struct(F.lit(None).cast("int").alias("hour"), detail.alias("detail")))
    entry = lambda name, ok, detail: F.struct(
        F.lit(name).alias("check"), ok.cast("bigint").alias("passed"), F.when(ok, none).otherwise(one(detail)).alias("failures"))
    text = lambda name: F.lit(CHECKS[name])
    sign = F.when(F.col("kind") == "generation", "generation_sign").otherwise("transmission_sign")
    found = F.array(
        entry("model_coverage", F.col("__hours").isNotNull(), text("model_coverage")),
        entry("feature_wiring", F.size("__missing") == 0, F.concat(text("feature_wiring"), F.array_join("__missing", ", "))),
        entry("baseline_persistence", F.col("__gate"), text("baseline_persistence")),
        entry("oracle_path", F.col("__profile"), text("oracle_path")),
        F.struct(sign.alias("check"), F.col("__sign").cast("bigint").alias("passed"),
                 F.when(F.col("__sign"), none).otherwise(one(text("generation_sign"))).alias("failures")),
        F.struct(F.lit("event_interval_alignment").alias("check"), (F.col("__hours") - F.size("__skipped")).alias("passed"),
                 F.transform("__skipped", lambda h: F.struct(h.alias("hour"), text("event_interval_alignment").alias("detail"))).alias("failures")),
    )
    only = F.array(entry("model_coverage", F.lit(False), text("model_coverage")))
    all_days = event_days.select("event_id", "kind", "day").distinct().join(per_day, ["event_id", "day", "kind"], "left")
    return all_days.select("event_id", "day", F.inline(F.when(F.col("__hours").isNull(), only).otherwise(found)))


def audit_invariants(results: DataFrame) -> DataFrame:
    """(check, passed, failed) over all event-days."""
    return results.groupBy("check").agg(F.sum("passed").alias("passed"), F.sum(F.size("failures").cast("bigint")).alias("failed"))


def audit_failures(results: DataFrame) -> DataFrame:
    """One row per failure: (check, event_id, day, hour, detail)."""
    return results.select("check", "event_id", "day", F.inline("failures"))


def panel_summary(panel: DataFrame, stored: str = "stored", recomputed: str = "baseline", tolerance: float = 1e-5) -> DataFrame:
    """Sizes of the panel and how far stored and recomputed baselines are apart."""
    gap = F.abs(F.col(stored) - F.col(recomputed))
    comparable = num.is_finite(F.col(stored))
    counts = {
        "n_event_hours": F.lit(True), "n_affected": F.col("affected"), "n_nonfinite_actual": ~num.is_finite(F.col("y")),
        "n_comparable": comparable, "n_differs": comparable & (gap > tolerance),
    }
    # an event-day's hours are added up before anything is shuffled; counting distinct keys in one aggregate would send each row three times
    per_day = panel.groupBy("event_id", "day").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.max(F.when(comparable, gap)).alias("max_abs_diff"))
    sums = [F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in counts]
    known = F.col("event_id").isNotNull()
    per_event = per_day.groupBy("event_id").agg(F.count_if(known & F.col("day").isNotNull()).alias("n_event_days"), *sums, F.max("max_abs_diff").alias("max_abs_diff"))
    return per_event.agg(
        F.count_if(known).alias("n_events"), F.coalesce(F.sum("n_event_days"), F.lit(0).cast("bigint")).alias("n_event_days"), *sums, F.max("max_abs_diff").alias("max_abs_diff"))


def matched_normal_profile(
    profile: DataFrame, event_days: DataFrame, by: list[str], value: str, weeks: int = 4
) -> DataFrame:
    """Per key, event day and hour: the median of the same weekday in the weeks before, event days excluded.

    profile (by, day, hour, value); event_days (by, day) are both the days asked for and the days left out.
    """
    asked = event_days.select(*by, "day").distinct()
    busy = asked.select("day").distinct()
    quiet = profile.join(busy, "day", "left_anti").where(num.is_finite(F.col(value)))
    sent = quiet.select(
        *by, F.col("day").alias("__control"), "hour", F.col(value).alias("__v"),
        F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("__k"),
    ).withColumn("day", F.date_add("__control", F.col("__k") * 7))
    used = sent.join(asked, [*by, "day"], "left_semi")
    controls = used.groupBy(*by, "day").agg(F.countDistinct("__control").alias("n_controls"))
    # at most `weeks` values per cell
    level = used.groupBy(*by, "day", "hour").agg(F.median("__v").alias("normal"))
    return relations.cross_join_expand(asked, "hour", 24).join(level, [*by, "day", "hour"], "left").join(
        controls, [*by, "day"], "left"
    ).withColumn("n_controls", F.coalesce("n_controls", F.lit(0).cast("bigint")))


def absorption(panel: DataFrame, normal: DataFrame) -> DataFrame:
    """Per event-day: is the declared reduction visible in the realised driver, against normal and persistence?

    A generation outage lowers availability, an import restriction raises unavailability; anomalies are signed so
    that "as declared" is positive. An event-day has at most 24 rows, so the medians are bounded.
    """
    rows = panel.join(normal, ["driver", "day", "hour"], "left")
    sign = F.when(F.col("kind") == "generation", -1.0).otherwise(1.0)
    ok = F.col("affected") & num.is_finite(F.col("driver_realised")) & num.is_finite(F.col("normal"))
    vs_normal = F.when(ok, sign * (F.col("driver_realised") - F.col("normal")))
    vs_persist = F.when(ok, sign * (F.col("driver_realised") - F.col("driver_persistence")))
    out = rows.groupBy("event_id", "day", "kind", "driver", "reduction").agg(
        F.max("n_controls").alias("n_control_days"),
        F.count_if(ok).alias("n_valid"),
        F.median(vs_normal).alias("median_vs_normal"),
        F.median(vs_persist).alias("median_vs_persistence"),
        F.avg((vs_normal > 0).cast("double")).alias("share_vs_normal"),
        F.avg(F.when(ok, F.coalesce((vs_persist > 0).cast("double"), F.lit(0.0)))).alias("share_vs_persistence"),
    )
    visible = (F.col("share_vs_normal") >= 0.75) & (F.col("median_vs_normal") >= 0.1 * F.col("reduction"))
    return out.withColumn("visible_share_of_declared", num.ratio(F.col("median_vs_normal"), F.col("reduction"))).withColumn(
        "classification",
        F.when(F.col("n_valid") == 0, "no_valid_affected_hours").when(visible, "visible_vs_normal")
        .otherwise("weak_or_not_visible_vs_normal"),
    )


def with_sensitivity(panel: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Add the forecast's change under the worsening of `scenario_forecasts` and whether the oracle driver differs at all."""
    rows = panel.join(perturbed.select("driver", "kind", "day", "hour", "perturbed"), ["driver", "kind", "day", "hour"], "left")
    return rows.withColumn("sensitivity", F.col("perturbed") - F.col("baseline")).withColumn(
        "differs", F.coalesce(F.abs("driver_delta") > DIFFERS, F.lit(False))
    )


def high_sensitivity() -> Column:
    return F.coalesce(F.abs("sensitivity") >= HIGH_SENSITIVITY, F.lit(False))


def sensitivity_summary(panel: DataFrame) -> DataFrame:
    """All scored hours and affected hours: n, median, mean, share positive, share at or above the threshold."""
    rows = metrics.explode_strata(
        panel, {"all": F.lit(True), "affected": F.col("affected")}
    ).where(num.is_finite(F.col("sensitivity")))
    rows = cut_lineage(rows.select("stratum", "sensitivity"))
    sums = rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_hours"), F.avg("sensitivity").alias("mean_change"),
        inference.share(F.col("sensitivity") > 0).alias("share_positive"),
        inference.share(high_sensitivity()).alias("share_high"),
    )
    return sums.join(inference.medians(rows, ["stratum"], "sensitivity", "median_change"), "stratum")


def nested_masks() -> dict[str, Column]:
    a, d, h = F.col("affected"), F.col("differs"), high_sensitivity()
    return {
        "all_scored_event_hours": F.lit(True),
        "realised_affected_hours": a,
        "affected_hours_driver_differs": a & d,
        "affected_high_sensitivity_hours": a & h,
        "affected_driver_differs_and_high_sensitivity": a & d & h,
    }


def kind_masks() -> dict[str, Column]:
    a, d, h = F.col("affected"), F.col("differs"), high_sensitivity()
    gen, tx = F.col("kind") == "generation", F.col("kind") == "transmission"
    return {
        "generation_affected": a & gen,
        "generation_affected_driver_differs": a & gen & d,
        "generation_affected_driver_differs_high_sensitivity": a & gen & d & h,
        "transmission_affected": a & tx,
        "transmission_affected_driver_differs": a & tx & d,
        "all_affected": a,
    }


def masked_scores(panel: DataFrame) -> DataFrame:
    """Baseline and oracle MAE with wins, losses and ties in each of the nested strata; one pass."""
    rows = metrics.explode_strata(panel.where(num.is_finite(F.col("y"))), nested_masks())
    be, oe = F.abs(F.col("baseline") - F.col("y")), F.abs(F.col("oracle") - F.col("y"))
    return rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg(be).alias("mae_baseline"), F.avg(oe).alias("mae_oracle"),
        (F.avg(oe) - F.avg(be)).alias("oracle_minus_baseline"),
        F.count_if(oe < be).alias("oracle_better"), F.count_if(be < oe).alias("baseline_better"),
        F.count_if(be == oe).alias("ties"),
    )


def oracle_ceiling(panel: DataFrame) -> DataFrame:
    """Headroom of the oracle in the generation strata: gains, win rate, size of the forecast shift."""
    ok = num.is_finite(F.col("y")) & num.is_finite(F.col("baseline")) & num.is_finite(F.col("oracle"))
    masks = {k: m for k, m in kind_masks().items() if k.startswith("generation")}
    rows = metrics.explode_strata(panel.where(ok), masks)
    be, oe = F.abs(F.col("baseline") - F.col("y")), F.abs(F.col("oracle") - F.col("y"))
    rows = rows.withColumn("__be", be).withColumn("__oe", oe).withColumn("__gain", be - oe).withColumn(
        "__shift", F.abs("price_delta")
    ).withColumn("__won", F.when(F.col("__gain") > 0, F.col("__gain")))
    rows = cut_lineage(rows.select("stratum", "event_id", "__be", "__oe", "__gain", "__shift", "__won"))
    sums = rows.groupBy("stratum").agg(
        F.countDistinct("event_id").alias("n_events"), F.count(F.lit(1)).alias("n_hours"),
        F.avg("__be").alias("baseline_mae"), F.avg("__oe").alias("oracle_mae"), F.avg("__gain").alias("gain"),
        (F.lit(100.0) * num.ratio(F.avg("__gain"), F.avg("__be"))).alias("gain_pct"),
        F.count_if(F.col("__gain") > 0).alias("wins"), F.count_if(F.col("__gain") < 0).alias("loses"),
        F.count_if(F.col("__gain") == 0).alias("ties"), inference.share(F.col("__gain") > 0).alias("win_rate"),
        F.avg("__shift").alias("mean_shift"), F.max("__shift").alias("max_shift"), F.avg("__won").alias("mean_gain_won"),
    )
    shift = running.exact_quantiles(rows, ["stratum"], "__shift", [0.5, 0.95]).groupBy("stratum").agg(
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median_shift"),
        F.max(F.when(F.col("p") == 0.95, F.col("q"))).alias("p95_shift"),
    )
    won = inference.medians(rows, ["stratum"], "__won", "median_gain_won")
    return sums.join(shift, "stratum", "left").join(won, "stratum", "left")


def decompose_event_day(panel: DataFrame, context: DataFrame, context_columns: list[str]) -> DataFrame:
    """Error decomposition per event-day: scores over all scored and over affected hours, and what co-moved.

    context (day, hour, <context_columns>): realised profiles that only describe the affected hours.
    """
    rows = panel.join(context, ["day", "hour"], "left")
    scored = num.is_finite(F.col("y"))
    hit = scored & F.col("affected")
    be, oe = F.abs(F.col("baseline") - F.col("y")), F.abs(F.col("oracle") - F.col("y"))
    mean = lambda m, x: F.avg(F.when(m, x))
    return rows.groupBy("event_id", "day", "kind", "driver").agg(
        F.count_if(scored).alias("n_scored"), F.count_if(hit).alias("n_affected"),
        mean(scored, be).alias("baseline_mae_all"), mean(scored, oe).alias("oracle_mae_all"),
        mean(scored, oe - be).alias("delta_all"),
        mean(hit, be).alias("baseline_mae"), mean(hit, oe).alias("oracle_mae"), mean(hit, oe - be).alias("delta"),
        mean(hit, F.col("y") - F.col("baseline")).alias("residual"),
        mean(hit, F.col("price_delta")).alias("shift"),
        mean(hit, F.coalesce((F.col("sensitivity") > 0).cast("double"), F.lit(0.0))).alias("share_positive"),
        F.median(F.when(hit, F.abs("sensitivity"))).alias("median_sensitivity"),
        *[mean(hit, F.col(c)).alias(f"mean_{c}") for c in context_columns],
    )


def decompose_rollup(daily: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean of the daily means per group, ordered by the oracle's difference."""
    means = ["baseline_mae", "oracle_mae", "delta", "residual", "shift", "share_positive", "median_sensitivity"]
    return daily.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_event_days"), F.sum("n_affected").alias("n_affected"),
        *[F.avg(c).alias(c) for c in means],
    ).orderBy("delta", *by)
