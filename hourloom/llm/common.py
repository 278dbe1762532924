"""What the operators share: shared scratch folders, stored intermediate tables, word hashes and fold numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words a Python worker remembers, twice at most. It bounds memory and changes no result.
CACHED_WORDS = 300_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Remembered(dict):
    """A function of words with a bounded memory: when it is full it becomes the older half, from which words in use come back."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= CACHED_WORDS:
            self.older = self.copy()
            self.clear()
        self[word] = value
        return value


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session without that
    setting (tests) gets a folder of its own; a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/hourloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and survives lost executors. Its shuffle files, which nothing
    reads once the table is written, are deleted with the end of the write."""
    spark = df.sparkSession
    folder, before = scratch(spark, name), spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def forget(df: DataFrame, part: str = "") -> None:
    """Delete the files of a table made by `stored`, once nothing reads it any more, or those of one `part` of it, as in "kind=1"."""
    spark, by = df.sparkSession, part.split("=")[0] or "kind"
    for folder in {f.rsplit("/part-", 1)[0].split(f"/{by}=")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}" if part else folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of `df` has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem in taken:
            stem += "_"
        taken.add(stem)
        out.append(stem)
    return out


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def pieces(batch: pa.RecordBatch, most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most_bytes` of text, so that numpy work stays small whatever the rows
    are. A longer text is a run of its own."""
    sizes = np.array([len(x or "") for x in batch.column(column).to_pylist()])
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


# ---- 64-bit hashes of words and of runs of words
MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class WordHashes(Remembered):
    """Word bytes to a 64-bit hash."""

    def __init__(self, compute=xxhash.xxh3_64_intdigest):
        super().__init__(compute)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words. A shorter text, if it has a word, is one run whose hash also depends on its length."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(k, n)
    out = hashes[: n - size + 1].copy()
    for i in range(1, size):
        out = out * MUL + hashes[i : n - size + 1 + i]
    return mix(out + np.uint64(size))
