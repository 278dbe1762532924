"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are short and documents long, so the similarity of whole sets says nothing. Items are partitioned by the number of their shingles
(five words each) into powers of two. For a partition of size s, documents are seen as windows of 2s shingles, one every s, so that every
passage of s shingles lies inside a window and makes up a fixed part of it whatever the document's length. An item and a window are
candidates if they share one of FUNCTIONS minima; at the least similarity that a contained item can have with its window (0.19), a
candidate is missed with a probability of 5 in 100,000. Minima of large windows are minima of small ones, so a document is hashed once.

A candidate is verified on the words themselves: the item's distinct shingles that the whole document has, over all it has.

Items are taken in blocks of bounded size, each block in a pass of its own, so what every task gets does not grow with the benchmark.

Rows: words are runs of letters and digits in lower case. A null or empty text has none. Items under five words have no shingle and match
nothing. Repeated documents and repeated items each give their own pairs; other columns are ignored by `leaks` and kept by `clean`; empty tables
give no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import WordHashes, mix, runs_of, texts_of

WORDS = re.compile(r"[^\W_]+")
SHINGLE = 5
FUNCTIONS = 48
CHUNK = 1 << 17  # shingles hashed at once
BLOCK_BYTES = 8_000_000  # of item text in a block
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def seeds() -> list[tuple[np.uint64, np.uint64]]:
    numbers = mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64))
    return [(a, b | np.uint64(1)) for a, b in zip(numbers[::2], numbers[1::2], strict=True)]


class Items:
    """One block of items, their minima by partition and function, and a search over many documents at once."""

    def __init__(self, rows: list, percent: int):
        hashes = WordHashes()
        self.percent, self.ids, self.shingles, self.hashed = percent, [], [], []
        for item_id, text in rows:
            words = WORDS.findall((text or "").lower())
            if len(words) >= SHINGLE:
                self.ids.append(item_id)
                self.shingles.append({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})
                self.hashed.append(np.unique(runs_of(hashes.of(words), SHINGLE)))
        self.seeds = seeds()
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(self.hashed):
            by_size.setdefault((len(x) - 1).bit_length(), []).append(i)
        self.largest = max(by_size, default=0)
        self.minima = {}
        for power, members in by_size.items():
            for f, (flip, factor) in enumerate(self.seeds):
                least = np.array([((self.hashed[i] ^ flip) * factor).min() for i in members], np.uint64)
                order = np.argsort(least)
                first_bits = np.zeros(1 << 16, bool)
                first_bits[least >> np.uint64(48)] = True
                self.minima[power, f] = (first_bits, least[order], np.array(members)[order])

    def _candidates(self, shingles: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs with a common minimum. Windows may reach over a document's end; verification settles it."""
        unit = 1 << self.largest
        padded = np.full(-(-len(shingles) // unit) * unit, NONE)
        padded[: len(shingles)] = shingles
        found = set()
        for f, (flip, factor) in enumerate(self.seeds):
            least = (padded ^ flip) * factor
            least[len(shingles) :] = NONE
            for power in range(self.largest + 1):
                if power:
                    least = np.minimum(least[::2], least[1::2])
                if (power, f) not in self.minima:
                    continue
                first_bits, known, members = self.minima[power, f]
                windows = np.minimum(least, np.append(least[1:], NONE))
                hits = np.flatnonzero(first_bits[windows >> np.uint64(48)])
                low, high = np.searchsorted(known, windows[hits]), np.searchsorted(known, windows[hits], side="right")
                for w, a, b in zip(hits[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                    begin, end = w << power, (w + 2) << power
                    for doc in range(int(np.searchsorted(starts, begin, side="right")) - 1, int(np.searchsorted(starts, end))):
                        found.update((doc, int(i)) for i in members[a:b])
        return found

    def search(self, texts: list[str], hashes: WordHashes) -> Iterator[tuple[int, int, int]]:
        """(position of the text, position of the item, shared shingles) of every item that a text contains."""
        if not self.ids:
            return
        held: list[tuple[int, list[str], np.ndarray]] = []
        total = 0
        for i, text in enumerate(texts):
            words = WORDS.findall(text.lower())
            if len(words) >= SHINGLE:
                held.append((i, words, runs_of(hashes.of(words), SHINGLE)))
                total += len(held[-1][2])
            if total >= CHUNK:
                yield from self._verified(held)
                held, total = [], 0
        if held:
            yield from self._verified(held)

    def _verified(self, held: list[tuple[int, list[str], np.ndarray]]) -> Iterator[tuple[int, int, int]]:
        starts = np.cumsum([0, *(len(x) for _, _, x in held[:-1])])
        for doc, item in sorted(self._candidates(np.concatenate([x for _, _, x in held]), starts)):
            i, words, hashed = held[doc]
            need = self.percent * len(self.shingles[item])
            if 100 * np.isin(self.hashed[item], hashed).sum() >= need:
                wanted = self.shingles[item]
                shared = len(wanted & {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)})
                if 100 * shared >= need:
                    yield i, item, shared


def blocks(items: DataFrame, percent: int) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES of text; a block is read only when its turn comes."""
    texts = items.select("item_id", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for b in range(count):
        yield Items(texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect(), percent)


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared: every item of which a document has `percent` or more of the shingles."""
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shingles long, n_shared long"

    def search(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                found = list(block.search(texts_of(batch), hashes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([i for i, _, _ in found], pa.int64())), pa.array([block.ids[k] for _, k, _ in found]).cast(item_kind),
                     pa.array([len(block.shingles[k]) for _, k, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
                    ["doc_id", "item_id", "n_shingles", "n_shared"],
                )

        return run

    item_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[1]]
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, percent):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(search(block), schema))
    return out


def clean(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of `docs` that contain no item."""

    def without(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _, _ in block.search(texts_of(batch), hashes)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in blocks(items, percent):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs
