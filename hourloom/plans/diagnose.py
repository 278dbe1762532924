"""All diagnostics of an event-hour panel, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hourloom.operators import audit as au
from hourloom.operators import inference as inf
from hourloom.operators import metrics as mt
from hourloom.session import cut_lineage


def diagnose(panel: DataFrame, perturbed: DataFrame, normal: DataFrame, context: DataFrame, columns: list[str], draws: int = 10_000) -> dict[str, DataFrame]:
    """The panel is written once, as every report reads it."""
    rows = cut_lineage(au.with_sensitivity(panel, perturbed))
    daily = au.decompose_event_day(rows, context, columns)
    strata = mt.explode_strata(rows, au.kind_masks())
    differences = inf.event_differences(strata, ["stratum"], "event_id", "y", "oracle", "baseline")
    return {
        "summary": au.panel_summary(rows),
        "absorption": au.absorption(rows, normal),
        "sensitivity": au.sensitivity_summary(rows),
        "nested_scores": au.masked_scores(rows),
        "decomposition_by_day": daily,
        "decomposition_by_event": au.decompose_rollup(daily, ["event_id", "kind", "driver"]),
        "decomposition_by_kind": au.decompose_rollup(daily, ["kind"]),
        "bootstrap": inf.block_bootstrap(differences, ["stratum"], "event_id", "diff", draws),
        "ceiling": au.oracle_ceiling(rows),
    }
