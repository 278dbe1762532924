"""Walk-forward residual quantiles over a stream of forecasts and actuals."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hourloom.functions import numeric as num
from hourloom.streaming.revisions import use_keyed_state

DAY_MS = 86_400_000


class _RollingResiduals(StatefulProcessor):
    """State of a key: days that are not final yet, and the last residuals of final ones (at most `last` numbers)."""

    def __init__(self, by: list[str], last: int, burn_in: int, taus: list[float]):
        self.by, self.last, self.burn_in, self.taus = by, last, burn_in, taus

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long", "y double, point double")
        self.residuals = handle.getValueState("residuals", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            if frame.empty:  # a key that is only called for its timers
                continue
            for day, y, point in zip(frame["day_number"].tolist(), frame["y"].tolist(), frame["point"].tolist()):
                self.waiting.updateValue((int(day),), tuple(None if v is None or np.isnan(v) else float(v) for v in (y, point)))
                self.handle.registerTimer(int(day) * DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A day is final once the watermark has passed it: nothing can come before it any more."""
        until = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        final = sorted(k[0] for k in self.waiting.keys() if k[0] <= until)
        known = list(self.residuals.get()[0]) if self.residuals.exists() else []
        out = []
        for day in final:
            y, point = self.waiting.getValue((day,))
            self.waiting.removeKey((day,))
            q = None
            if len(known) >= self.burn_in:
                q = [None if point is None else float(v + point) for v in np.quantile(known, self.taus)]
            out.append((*key, datetime.fromtimestamp(day * 86_400, timezone.utc).date(), y, point, q))
            if y is not None and point is not None:
                known = [*known, y - point][-self.last :]
        self.residuals.update((known,))
        if out:
            yield pd.DataFrame(out, columns=[*self.by, "day", "y", "point", "q"])

    def close(self) -> None:
        pass


def rolling_residual_quantiles(
    rows: DataFrame, by: list[str], day: str, y: str, point: str, lateness: str = "2 days", last: int = 90, burn_in: int = 28,
    taus: list[float] = num.QUANTILE_GRID,
) -> DataFrame:
    """The stream's form of `operators.forecast.rolling_residual_quantiles`: (by, day, y, point, q) of every day once it is final.

    One row per key and day; `by` must include the hour of day. A day is final when the watermark, the newest day less `lateness`, has passed it.
    Days that come in any order before that give the batch result; later ones are dropped. Of a day that comes twice the second row counts.
    """
    use_keyed_state(rows.sparkSession)
    stamped = rows.select(
        *by, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint").alias("day_number"), F.col(day).cast("timestamp").alias("instant"),
        F.col(y).cast("double").alias("y"), F.col(point).cast("double").alias("point"),
    ).withWatermark("instant", lateness)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    return stamped.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=_RollingResiduals(by, last, burn_in, taus), outputStructType=f"{fields}, day date, y double, point double, q array<double>",
        outputMode="Append", timeMode="EventTime")
