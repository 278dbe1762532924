"""Shards of near equal bytes through fixed virtual slots and a versioned slot map.

Records are hashed into a fixed number of slots, sizes are summed per slot, and a map says which shard holds a slot. The first version deals the slots
in even ranges; rebalancing and growth edit it, and every version is kept. Only slot sums (one row per slot) and the map come to the driver; their
size is the number of slots, whatever the corpus.

A row that repeats another one (same id, same text) gets a slot of its own: its hash takes in the task and the how-manyth copy it is, so that a row
that makes up a third of a table spreads over all slots. All other rows' slots follow from id and text alone.

Nulls: a missing text has no bytes (size 8, crc32 0), a missing id is hashed as a missing value. Empty and long texts are rows like others; a text
is never cut, so a shard that gets a text larger than the mean stays that large. Repeated rows are dealt one by one. Ties between shards and slots go to
the lower number. An empty table gives no rows and a map of even ranges. Further columns do not take part and cannot clash: only the named ones are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hourloom.llm.common import mix, stored

SLOTS = 4096
RECORD_BYTES = 8  # what a record takes beside its text
SEEN_KEYS = 200_000  # hashes a task remembers to tell copies apart; a copy forgotten in between counts as a first one again
CLOSE = 5e-4  # shards this near to each other, as a share of their mean, count as equal
MOST_EDITS = 20_000


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard_of[slot]."""

    version: int
    shards: int
    shard_of: np.ndarray

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, np.arange(slots) * shards // slots)

    def loads(self, sizes: np.ndarray) -> np.ndarray:
        return np.bincount(self.shard_of, sizes, self.shards)

    def rebalanced(self, sizes: np.ndarray) -> SlotMap:
        """The next version: slots leave shards above the mean for the lightest ones, then pairs of shards move or swap slots until they are close
        or no exchange between the heaviest and any other shard helps."""
        shard_of, load = self.shard_of.copy(), self.loads(sizes)
        mean = load.sum() / self.shards
        loose = []
        for shard in range(self.shards):
            own = np.flatnonzero(shard_of == shard)
            for slot in own[np.lexsort((own, -sizes[own]))]:
                if sizes[slot] and load[shard] - sizes[slot] >= mean:
                    load[shard] -= sizes[slot]
                    loose.append(slot)
        for slot in sorted(loose, key=lambda s: (-sizes[s], s)):
            shard_of[slot] = load.argmin()
            load[shard_of[slot]] += sizes[slot]
        for _ in range(MOST_EDITS):
            if load.max() - load.min() <= CLOSE * mean or not self._exchange(shard_of, load, sizes):
                break
        return replace(self, version=self.version + 1, shard_of=shard_of)

    @staticmethod
    def _exchange(shard_of: np.ndarray, load: np.ndarray, sizes: np.ndarray) -> bool:
        """One move or swap between the heaviest shard and the lightest partner with which the larger of the two gets smaller."""
        heavy = int(load.argmax())
        mine = np.flatnonzero(shard_of == heavy)
        for light in np.argsort(load, kind="stable"):
            gap = load[heavy] - load[light]
            if gap <= 1:
                return False
            theirs = np.flatnonzero(shard_of == light)
            back = np.append(sizes[theirs], 0)  # the last one stands for a move without return
            change = sizes[mine][:, None] - back[None, :]
            left = np.where((change > 0) & (change < gap), np.abs(gap - 2 * change), np.inf)
            best = int(left.argmin())
            if left.flat[best] < gap:
                a, b = divmod(best, len(back))
                shard_of[mine[a]] = light
                if b < len(theirs):
                    shard_of[theirs[b]] = heavy
                load[heavy] -= change[a, b]
                load[light] += change[a, b]
                return True
        return False

    def grown(self, sizes: np.ndarray) -> SlotMap:
        """The next version with one more shard. Slots move into the new shard only, each from the shard that is heaviest then, up to its mean."""
        shard_of = self.shard_of.copy()
        load = np.append(self.loads(sizes), 0)
        mean, new = load.sum() / (self.shards + 1), self.shards
        while True:
            room = mean - load[new]
            for heavy in np.argsort(-load[:new], kind="stable"):
                own = np.flatnonzero(shard_of == heavy)
                fits = own[(sizes[own] > 0) & (sizes[own] <= room)]
                if load[heavy] > mean and len(fits):
                    break
            else:
                return SlotMap(self.version + 1, self.shards + 1, shard_of)
            slot = fits[np.lexsort((fits, -sizes[fits]))[0]]
            shard_of[slot] = new
            load[heavy] -= sizes[slot]
            load[new] += sizes[slot]

    def store(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the map's table (version, shards, slot, shard)."""
        rows = [(self.version, self.shards, slot, int(shard)) for slot, shard in enumerate(self.shard_of)]
        frame = spark.createDataFrame(rows, "version int, shards int, slot int, shard int")
        frame.coalesce(1).write.mode("append").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one unless named."""
        table = spark.read.parquet(folder)
        if version is None:
            version = table.agg(F.max("version").alias("v")).first().v
        rows = table.where(F.col("version") == version).orderBy("slot").collect()  # one row per slot
        return cls(version, rows[0].shards, np.array([x.shard for x in rows]))


def _slots_of(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = np.uint64(TaskContext.get().partitionId() + 1)
        seen: dict[int, int] = {}
        for batch in batches:
            keys = batch.column("record_hash").to_numpy().view(np.uint64)
            copy = np.empty(len(keys), np.uint64)
            for i, key in enumerate(keys.tolist()):
                copy[i] = n = seen.get(key, 0)
                seen[key] = n + 1
                if len(seen) > SEEN_KEYS:
                    seen.clear()
            salted = np.where(copy > 0, mix(keys ^ mix(copy + (task << np.uint64(40)))), keys)
            slot = (mix(salted) % np.uint64(slots)).astype(np.int32)
            columns = [batch.column(c) for c in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot)], ["doc_id", "size", "text_crc32", "virtual_slot"])

    return run


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row, written once: what follows reads no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("record_hash"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = narrow.mapInArrow(_slots_of(slots), f"doc_id {kind}, size bigint, text_crc32 bigint, virtual_slot int")
    return stored(dealt, "records")


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes per slot; partial sums before the shuffle, one row per slot to the driver."""
    sizes = np.zeros(slots)
    for x in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():
        sizes[x.virtual_slot] = x.bytes
    return sizes


def _numbered(slot_map: SlotMap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), np.zeros(slot_map.shards, np.int64)
        for batch in batches:
            shard = slot_map.shard_of[batch.column("virtual_slot").to_numpy()].astype(np.int32)
            order = np.argsort(shard, kind="stable")
            here = np.bincount(shard, minlength=slot_map.shards)
            rank = np.empty(len(shard), np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(here) - here, here)
            rank += count[shard]
            count += here
            names = [*batch.schema.names, "shard", "task", "rank"]
            columns = [*batch.columns, pa.array(shard), pa.array(np.full(len(shard), task, np.int32)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def assign(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """The records with their shard and their place in it, numbered from 0 without gaps.

    A task numbers its own rows of each shard; counts per (task, shard) give every task its first number. No shard is sorted or gathered.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered = stored(rows.mapInArrow(_numbered(slot_map), f"{fields}, shard int, task int, rank bigint"), "assigned")
    counts = numbered.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    first = counts.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return numbered.join(first, ["task", "shard"]).withColumn("slot", F.col("first") + F.col("rank")).drop("task", "rank", "first")


def write_shards(docs: DataFrame, assigned: DataFrame, folder: str) -> None:
    """The rows of `docs` as Parquet, one folder per shard, for tables whose (doc_id, text) are distinct: the shard comes by id, size and checksum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    where = assigned.select("doc_id", "size", "text_crc32", "shard")
    rows = docs.withColumn("size", (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("bigint")).withColumn("text_crc32", F.crc32(text.cast("binary")))
    joined = rows.join(where, rows.doc_id.eqNullSafe(where.doc_id) & (rows["size"] == where["size"]) & (rows.text_crc32 == where.text_crc32))
    kept: list[Column] = [rows[f"`{c}`"] for c in docs.columns]
    joined.select(*kept, where.shard).write.partitionBy("shard").parquet(folder)
