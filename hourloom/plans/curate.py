"""Candidate outages matched to document threads, and the stratified selection of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.functions import calendar as cal
from hourloom.operators import documents as dc
from hourloom.operators import intervals as iv
from hourloom.operators import matching as ma
from hourloom.operators import relations as rel
from hourloom.operators import selection as se
from hourloom.session import cut_lineage

# Targets, caps and quotas of the selection.
PER_SEASON = 2
UNPLANNED_TARGET = 11
PLANNED_TARGET = 3
TRANSMISSION_TARGET = 4
PER_UNIT_CAP = 3
PLANNED_LEAD_HOURS = 168.0
LARGE_MW = 300.0
SEASONS = ["winter", "spring", "summer", "autumn"]
UNPLANNED, PLANNED = "Unplanned outage", "Planned maintenance"


def label_candidates(candidates: DataFrame, prefix: str, tz: str) -> DataFrame:
    """Ids by start, season and spring-flood flag of the local start, and duplicates of larger overlapping rows."""
    month = F.month(cal.wall(F.col("start"), tz))
    rows = candidates.withColumn("__p", F.lit(prefix)).withColumn("season", cal.season(month)).withColumn(
        "flood", cal.spring_flood(month)
    )
    ids = rel.positional_ids(rows, "__p", ["start", "row_id"], "event_id").drop("__p")
    return iv.greedy_interval_dedup(cut_lineage(ids), ["unit"], "event_id", "start", "end", "reduction")


def match_threads(candidates: DataFrame, periods: DataFrame, excluded_units: list) -> DataFrame:
    """Candidates with their best thread, lead time and revision surprise, or the reason for rejection.

    A cheap pass over latest versions first, then the full history of only the threads it left.
    periods: message, version, unit, published, remarks, start, end, mw.
    """
    versions = dc.version_record(periods, ["message", "version", "unit", "published", "remarks"], "start", "end", "mw")
    threads = ma.latest_version(versions, ["message", "unit"], "version")
    pairs, report = ma.interval_overlap_match(candidates, threads, "unit", "event_id", "message", excluded_units, "duplicate_of", kind="kind" if "kind" in candidates.columns else None)
    best = ma.best_thread_argmin(pairs, periods, "event_id", "message", "version", "published")
    rows = report.join(best.select("event_id", "message"), "event_id", "left")
    rows = dc.lead_time_hours(rows, versions, "message", "start", "published")
    surprise = dc.revision_surprise(versions, ["message"], "version", "end", "mw")
    reason = F.coalesce("reason", F.when(F.col("message").isNull(), "no_thread_survived_first_version_check"))
    return rows.join(surprise, "message", "left").withColumn("reason", reason).withColumn(
        "accepted", F.col("message").isNotNull()
    )


def select_events(accepted: DataFrame, min_surprise: int, min_flood: int) -> DataFrame:
    """The fixed chain of strata. accepted: event_id, unit, kind, businesstype, season, flood, reduction,
    lead_hours, surprise."""
    kind, business = F.col("kind"), F.col("businesstype")
    unplanned = (kind == "generation") & (business == UNPLANNED)
    args = ("event_id", "unit", "reduction")
    strata = [(unplanned & (F.col("season") == s), PER_SEASON, PER_UNIT_CAP) for s in SEASONS]
    selected = se.topk_per_stratum_capped(accepted, strata, *args)
    missing = UNPLANNED_TARGET - selected.count()
    selected = se.take(accepted.where(unplanned), selected, missing, *args, cap=PER_UNIT_CAP)
    selected = se.topk_swap_quota(accepted.where(unplanned), selected, F.col("surprise"), min_surprise, "event_id", "reduction")
    planned = (kind == "generation") & (business == PLANNED) & (F.col("lead_hours") >= PLANNED_LEAD_HOURS)
    selected = se.take(accepted.where(planned), selected, PLANNED_TARGET, *args, cap=PER_UNIT_CAP)
    tx = kind == "transmission"
    before = selected.count()
    selected = se.take(accepted.where(tx & (F.col("reduction") >= LARGE_MW)), selected, TRANSMISSION_TARGET, *args)
    missing = TRANSMISSION_TARGET - (selected.count() - before)
    selected = se.take(accepted.where(tx & (F.col("reduction") < LARGE_MW)), selected, missing, *args)
    return se.topk_swap_same_kind(
        accepted, selected, F.col("flood"), min_flood, *args, alike=["kind", "businesstype"], capped=kind == "generation",
        cap=PER_UNIT_CAP,
    )
