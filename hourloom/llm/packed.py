"""Token ids in fixed-width bit packing.

The file format is a Parquet table of blocks in ascending doc_id order. Every id takes the bits that the largest id of the
vocabulary needs, little end first, without gaps inside a block. A block holds whole documents (about `block_ids` ids, more
only if one document is longer) and can be read alone:

    shard, block        which file part, and which block in it; in this order documents ascend
    first               ids of the shard before this block
    n_ids, width        ids in the block, bits of each
    lo, hi              smallest and largest doc_id, for skipping blocks
    doc_ids, ends       documents of the block and, for each, where its ids end in the block
    payload             the packed ids

Rows: each document ends with the end id, so an empty or null text is one id. Documents with equal ids follow each other in
order of their text; a missing doc_id comes first. Other columns are ignored; an empty table gives no blocks.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourloom.llm.bpe import Splitter, byte_letters
from hourloom.llm.common import Remembered, texts_of

BLOCKS = (
    "shard int, block int, first long, n_ids long, width int, lo long, hi long, doc_ids array<long>, ends array<long>, payload binary"
)
FIELDS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()),
     ("lo", pa.int64()), ("hi", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """ids start .. start + count; only their bytes are touched."""
    first, last = start * width // 8, -(-(start + count) * width // 8)
    data = np.frombuffer(payload, np.uint8, last - first, first)
    bits = np.unpackbits(data, bitorder="little")[start * width - first * 8 :][: count * width]
    return (bits.reshape(count, width).astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class LibraryIds:
    """The ids of a text by the tokenizers library, which encodes each word on its own; words in use are remembered."""

    def __init__(self, path: str):
        self.split = Splitter(path)
        self.vocabulary = self.split.library.get_vocab_size(with_added_tokens=True)
        self.tokenize = self.split.library.model.tokenize
        names = {b: letter for letter, b in byte_letters().items()}
        self.letters = [names[b] for b in range(256)]
        self.ids_of = Remembered(self.encode_word)

    def encode_word(self, word: str) -> bytes:
        if word in self.split.special:
            return np.array([self.split.special[word]], "<u4").tobytes()
        return array("I", [t.id for t in self.tokenize("".join(map(self.letters.__getitem__, word.encode())))]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, self.split.words(text))), "<u4")


@functools.cache
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, block_ids: int = 65_536) -> None:
    """Encode `docs` and write the blocks to `folder`. Documents are dealt out by ranges of doc_id, so that a task writes the
    ids of one range; Spark commits the files, and a task that is run again writes the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library_ids(path)
        width, shard = width_of(lib.vocabulary), TaskContext.get().partitionId()
        block, first, ids, sizes, held = 0, 0, [], [], 0

        def flush(docs_held: list) -> pa.RecordBatch:
            joined = np.concatenate(ids)
            known = [x for x in docs_held if x is not None]
            row = [shard, block, first, len(joined), width, min(known, default=None), max(known, default=None), docs_held, np.cumsum(sizes).tolist(), pack(joined, width)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FIELDS, strict=True)], schema=FIELDS)

        names: list = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids.append(np.append(lib.encode(text), np.uint32(end_id)))
                sizes.append(len(ids[-1]))
                names.append(doc_id)
                held += sizes[-1]
                if held >= block_ids:
                    yield flush(names)
                    block, first, ids, sizes, names, held = block + 1, first + held, [], [], [], 0
        if names:
            yield flush(names)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, base: ids in all shards before. One row for each writing task, so the running sum is small."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def summaries(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"]).astype("<u4")
                ends = row["ends"]
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["base"] + row["first"] + s for s in starts], pa.int64()),
                     pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                     pa.array([zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    columns = ("first", "n_ids", "width", "doc_ids", "ends", "payload")
    placed = blocks.join(F.broadcast(shard_starts(blocks)), "shard").select(*columns, "base")  # one row for each shard
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(blocks: DataFrame, doc_id: int) -> DataFrame:
    """doc_id, ids of one document: blocks are skipped by lo and hi, and of the payload only the document is unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = [0, *row["ends"][:-1]]
                hits = [unpack(row["payload"], row["width"], s, e - s).tolist() for d, s, e in zip(row["doc_ids"], starts, row["ends"], strict=True) if d == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(hits), pa.int64()), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "ids"])

    hit = blocks.where((F.col("lo") <= doc_id) & (F.col("hi") >= doc_id)).select("width", "doc_ids", "ends", "payload")
    return hit.mapInArrow(run, "doc_id long, ids array<long>")
