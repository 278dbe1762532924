"""Revision feeds as a stream: rows that a newer revision has replaced are dropped on arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from hourloom.operators import intervals

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Operators with keyed state need the store that holds it on disk; its change log goes to the query's checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _NewestOnly(StatefulProcessor):
    """State of a slot of keys: the highest revision so far of each of them, and when it was last seen, as one Arrow table."""

    def __init__(self, key: str, revision: str, columns: list[str], keep_for_ms: int | None):
        self.key, self.revision, self.columns, self.keep_for_ms = key, revision, columns, keep_for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tops = handle.getValueState("tops", StructType([StructField("tops", BinaryType())]), self.keep_for_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = 0 if self.keep_for_ms is None else timerValues.getCurrentProcessingTimeInMs()
        known = pd.DataFrame({"top": pd.Series(dtype="int64"), "seen": pd.Series(dtype="int64")}, index=pd.Index([], dtype="object"))
        if self.tops.exists():
            with pa.ipc.open_stream(self.tops.get()[0]) as stored:
                table = stored.read_all().to_pandas()
            known = table.set_index(pd.Index(table["key"].astype("object"))).drop(columns="key")
            if self.keep_for_ms is not None:
                known = known[known["seen"] > now - self.keep_for_ms]
        for frame in rows:  # chunks, so a hot key is never held whole
            frame = frame.reset_index(drop=True)
            counted = frame.loc[frame[self.revision].notna(), [self.key, self.revision]].astype({self.revision: "int64"})
            found = counted.groupby(self.key)[self.revision].max().to_frame("top").assign(seen=now)
            known = pd.concat([known, found]).groupby(level=0, sort=False).max()
            # a revision that this chunk outdates is dropped as well; one that a later chunk outdates is left to the reader
            left = frame.drop(index=counted.index[counted[self.revision] < counted[self.key].map(known["top"])])
            if len(left):
                yield left[self.columns]
        if len(known):
            table = pa.table({"key": pa.array(known.index.tolist(), pa.string()), "top": pa.array(known["top"]), "seen": pa.array(known["seen"])})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            self.tops.update((sink.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


SLOTS = 1024  # groups of keys that share a state row; a call of the processor costs far more than a key in it


def newest_revisions(rows: DataFrame, key: str, revision: str, keep_for_hours: int | None = None, slots: int = SLOTS) -> DataFrame:
    """The stream without rows of a revision lower than the highest one that arrived before for their key.

    What is left still holds every row of each key's highest revision, so `current_revisions` of all that was written is the batch result. Rows may
    come in any order: late rows of the highest revision pass, late rows of older ones do not. With `keep_for_hours` a key that gets no rows for
    so long is forgotten; older revisions that come after that pass again, which costs room in the sink and changes no result. Keys share
    `slots` state rows by hash; a batch reads and writes the rows of the slots it touches, two numbers a key.
    """
    use_keyed_state(rows.sparkSession)
    keep = None if keep_for_hours is None else keep_for_hours * 3_600_000
    typed = rows.withColumn(revision, F.col(revision).cast("bigint"))
    # plain names inside: a name with a leading underscore does not reach the processor as it is
    plain = {c: f"c{i}" for i, c in enumerate(typed.columns)}
    inside = typed.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
    text = F.coalesce(F.concat(F.lit("k"), F.col(plain[key]).cast("string")), F.lit(""))  # NULL is a key like others
    dealt = inside.withColumn("slot", F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")).withColumn("keytext", text)
    kept = dealt.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=_NewestOnly("keytext", plain[revision], inside.columns, keep), outputStructType=inside.schema, outputMode="Append",
        timeMode="None" if keep is None else "ProcessingTime")
    return kept.select(*[F.col(p).alias(c) for c, p in plain.items()])


def current_revisions(sink: DataFrame, key: str, revision: str, status: str, excluded: list[str] = intervals.CANCELLED) -> DataFrame:
    """The rows in force, from all that `newest_revisions` has written."""
    return intervals.latest_revision(sink, key, revision, status, excluded)
