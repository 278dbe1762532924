"""From landed series, outage feeds and registry snapshots to the aligned hourly table and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import intervals as iv
from hourloom.operators import relations as rel
from hourloom.operators import timeline as tl


def merged_outages(feed_a: DataFrame, feed_b: DataFrame) -> DataFrame:
    """Latest revisions of both feeds; rows of B that overlap a row of A for the same unit are left out.

    Columns: mrid, revision, docstatus, unit, start, end, nominal, avail, plant_type.
    """
    a, b = iv.latest_revision(feed_a), iv.latest_revision(feed_b)
    merged = rel.union_tagged({"A": a, "B": iv.interval_anti_join(b, a, ["unit"], "start", "end")}, "source")
    return iv.derive_reduction(merged, "nominal", "avail", "start", "end")


def generation_drivers(outages: DataFrame, registry: DataFrame, spine: DataFrame, tz: str, min_mw: float = 100.0) -> DataFrame:
    """Hourly unavailable MW (all and nuclear), installed MW of the local year, and what is left."""
    total = iv.sweep_line_sum(outages, [], "start", "end", "reduction", spine, out="unavail_mw")
    nuclear = iv.sweep_line_sum(
        outages.where("plant_type = 'Nuclear'"), [], "start", "end", "reduction", spine, out="unavail_nuclear_mw"
    )
    installed = rel.registry_by_year(registry, "year", "mw", min_mw).select("year", "installed")
    left = iv.available_capacity(installed, "year", total, "ts", "unavail_mw", tz)
    return left.join(nuclear, "ts", "left").select(
        "ts", F.col("installed").alias("installed_mw"), "unavail_mw", "unavail_nuclear_mw", F.col("available").alias("avail_gen_mw")
    )


def transmission_drivers(restrictions: DataFrame, spine: DataFrame, pairs: list[str], imports: list[str]) -> DataFrame:
    """Hourly unavailable MW per pair as columns, with import and export totals. Pairs without rows are 0."""
    prepared = iv.latest_revision(restrictions)
    grid = spine.select("ts", F.explode(F.array(*map(F.lit, pairs))).alias("pair"))
    lost = iv.capacity_driver(prepared, ["pair"], "start", "end", "avail", grid)
    side = F.when(F.col("pair").isin(*imports), "import").otherwise("export")
    totals = rel.sum_by_side(lost, side, "ts", "unavailable").groupBy("ts").pivot("side", ["import", "export"]).agg(F.max("total"))
    wide = lost.groupBy("ts").pivot("pair", pairs).agg(F.max("unavailable"))
    names = [F.col(p).alias(f"unavail_tx_{p}_mw") for p in pairs]
    return wide.join(totals, "ts").select(
        "ts", *names, F.coalesce("import", F.lit(0.0)).alias("unavail_tx_import_mw"),
        F.coalesce("export", F.lit(0.0)).alias("unavail_tx_export_mw"),
    )


def build_hourly_table(
    series: DataFrame, names: list[str], slow: DataFrame, outages: DataFrame, registry: DataFrame, restrictions: DataFrame,
    bounds: DataFrame, pairs: list[str], imports: list[str], tz: str, zero_before_first: list[str] = (),
) -> DataFrame:
    """One row per expected hour with every column.

    series (series, ts, value) raw; slow (ts, value) coarser than an hour; bounds: one row (start, end), wall clock.
    """
    spine = tl.hour_spine(bounds, "start", "end", tz)
    per_series = spine.select("ts", F.explode(F.array(*map(F.lit, names))).alias("series"))
    hourly = tl.resample_mean(series, ["series"], "ts", "value", per_series)
    if zero_before_first:
        early = tl.zero_fill_before_first(hourly.where(F.col("series").isin(*zero_before_first)), ["series"], "ts", "value")
        hourly = hourly.where(~F.col("series").isin(*zero_before_first)).unionByName(early.drop("filled"))
    reservoir = tl.resample_ffill(slow, [], "ts", "value", spine).withColumnRenamed("value", "reservoir_fill")
    table = tl.align_on_spine(spine, hourly, "ts", "series", "value", names)
    for part in (
        generation_drivers(outages, registry, spine, tz), transmission_drivers(restrictions, spine, pairs, imports), reservoir
    ):
        table = table.join(part, "ts", "left")
    return table.withColumn("local_day", cal.local_day(F.col("ts"), tz)).withColumn("local_hour", cal.local_hour(F.col("ts"), tz))


def table_coverage(table: DataFrame) -> DataFrame:
    """Coverage of every numeric column, as rows."""
    columns = [c for c in table.columns if c not in ("ts", "local_day", "local_hour")]
    long = table.select("ts", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["ts"], columns, "column", "value")
    return tl.coverage_report(long, ["column"], "ts", "value")
