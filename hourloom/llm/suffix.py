"""Removal of long repeated byte strings by longest-previous-factor arrays over distributed suffix order.

Every string of `length` bytes (a window) has one anchor: the k-gram inside it with the smallest hash, the left one of equals. Equal
windows have equal anchors at equal offsets, so windows that could be equal meet by the anchor's hash, and windows whose anchor occurs
once in the corpus are dropped before anything is shipped.

1.  Texts that are equal as a whole form a class, by key and count alone; only one of each class takes part below.
2.  Anchors of all texts, one row for about 180 bytes; those that occur at two places or more are kept.
3.  Neighbouring windows with the same repeated anchor form a segment. Equal segments of a batch are merged before they are shipped.
4.  Anchors with more than HOT segments are taken window by window: equal windows meet by the 128-bit hash of their bytes, as counts and
    minima of positions added up before the shuffle, so a hot anchor with many surroundings spreads over all tasks.
5.  The segments of any other anchor are put in suffix order, as deep as a window: ranks of 8 bytes are doubled to the full length, and
    suffixes that are equal that far follow each other by position. In this order the previous smaller position of a suffix is its left
    neighbour if both have the same rank, so its longest previous factor reaches the length exactly then; and a suffix has a
    later copy if its right neighbour has the same rank.
6.  Windows with an earlier copy (keep="first") or with any other copy (keep="none") are joined to spans and cut out of the texts.

Spans are judged on the input; matches never cross documents. The first of equal windows is that with the smallest doc_id, then the
smallest position; a missing doc_id comes before all others.

Rows: every row gives one row. A null text is empty; texts shorter than the length stay whole. With keep="none" repeated rows are copies
of each other; with keep="first" rows with equal doc_id and text count as one document. Cutting can split a UTF-8 character; digests
are of the remaining bytes, and texts drop what is left of such a character. Other columns pass through `remove`; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import forget, fresh, mix, stored, texts_of

K = 32  # bytes of an anchor
SLICE = 1 << 20  # bytes handled at once; longer texts are cut into overlapping slices
POSITION = np.uint64((1 << 24) - 1)
ORDERED = 2_000_000  # bytes put into suffix order at once
OFFSETS = 32  # of an anchor with many segments, so many window offsets are ordered at once
HOT = 5_000  # segments of an anchor that one task takes
SPREAD = 20_000  # anchors that occur more often are looked up in every task instead of being dealt by their hash ...
MOST_SPREAD = 50_000  # ... so many at most: no more anchors can each have their share of all occurrences
NO_ID = -(1 << 63)


def _slices(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in groups of about SLICE bytes; every window of every text lies in exactly one slice."""
    held, total = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), SLICE):
            part = text[at : at + SLICE + length - 1]
            held.append((i, at, part))
            total += len(part)
            if total >= SLICE:
                yield held
                held, total = [], 0
    if held:
        yield held


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, first window, number of windows, anchor position, anchor hash) of the runs of windows with one anchor."""
    for group in _slices(texts, length):
        data = np.frombuffer(b"".join(x for _, _, x in group), np.uint8)
        sizes = np.array([len(x) for _, _, x in group])
        ends = np.cumsum(sizes)
        h = mix(data.astype(np.uint64) + np.uint64(1))
        size, base = 1, 0x9E3779B97F4A7C15
        while size < K:
            h = h[:-size] * np.uint64(base) + h[size:]
            size, base = 2 * size, base * base % (1 << 64)
        h = mix(h)
        least = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        wide, size = length - K + 1, 1
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < wide:
            least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
        anchor = (least & POSITION).astype(np.int64)
        starts = ends - sizes
        windows = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(starts, ends, strict=True)])
        anchor = anchor[windows]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)])
        owner = np.searchsorted(ends, windows[first], side="right")
        shift = np.array([at for _, at, _ in group])[owner] - starts[owner]
        many = np.diff(np.r_[first, len(windows)])
        yield np.array([i for i, _, _ in group])[owner], windows[first] + shift, many, anchor[first] + shift, h[anchor[first]].view(np.int64)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, texts = [], []
            for key, text in zip(batch.column("text_hash").to_pylist(), texts_of(batch), strict=True):
                if key not in seen:
                    if len(seen) < 1_000_000:  # only saves rows that count as one place anyway
                        seen.add(key)
                    keys.append(key)
                    texts.append(text.encode())
            names = np.array(keys, np.int64)
            for owner, _, _, at, hashes in segments(texts, length):
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(names[owner]), pa.array(at)], ["anchor", "text_hash", "at"])

    return run


def _ship(length: int, keep: str):
    """Segments of repeated anchors. Those that are equal to another of the batch are decided here: span rows (anchor null)."""
    schema = pa.schema([("anchor", pa.int64()), ("text_hash", pa.int64()), ("first_id", pa.int64()), ("first", pa.int64()), ("windows", pa.int64()), ("left", pa.int64()), ("data", pa.binary()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                names, ids = part.column("text_hash").to_pylist(), part.column("first_id").to_pylist()
                texts = [x.encode() for x in texts_of(part)]
                repeated = [set(x) for x in part.column("ats").to_pylist()]
                kept: dict[bytes, list] = {}
                spans: list[list] = []
                for owner, first, many, at, hashes in segments(texts, length):
                    for i, f, n, p, h in zip(owner.tolist(), first.tolist(), many.tolist(), at.tolist(), hashes.tolist(), strict=True):
                        if p not in repeated[i]:
                            continue
                        data = texts[i][f : f + n - 1 + length]
                        row = [h, names[i], ids[i], f, n, p - f, data, 0]
                        other = kept.setdefault(data, row)
                        if other is row or (other[1], other[3]) == (names[i], f):  # the same place of a repeated row
                            continue
                        if (ids[i], f) < (other[2], other[3]):
                            kept[data] = row
                            row, other = other, row
                        spans.append([None, *row[1:5], None, None, 1])
                        if keep == "none":
                            spans.append([None, *other[1:5], None, None, 1])
                rows = [*kept.values(), *spans]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def ranks(data: np.ndarray, length: int, wanted: np.ndarray) -> np.ndarray:
    """Rank of the `length` bytes from each wanted position, in the order of the bytes; -1 if no other wanted position can be equal."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    rank = np.full(n, -1, np.int64)
    places, size = np.arange(n), 8
    while True:
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        rank[:] = -1
        several = counts[inverse] > 1
        rank[places[several]] = inverse[several]
        step = min(size, length - size)
        if step <= 0:
            break
        ok = np.zeros(n, bool)
        ok[: n - step] = (rank[: n - step] >= 0) & (rank[step:] >= 0)
        size += step
        places = np.flatnonzero(ok) if size < length else wanted[ok[wanted]]
        key = (rank[places].astype(np.uint64) << np.uint64(32)) | rank[places + step].astype(np.uint64)
        if not len(places):
            rank[:] = -1
            break
    return rank[wanted]


def copied(parts: list[tuple], length: int, keep: str) -> list[np.ndarray]:
    """For each segment (first_id, text_hash, first, windows, data), which of its windows have an earlier (or any) copy among all."""
    sizes = np.array([len(p[4]) for p in parts])
    many = np.array([p[3] for p in parts])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rank = ranks(np.frombuffer(b"".join(p[4] for p in parts), np.uint8), length, begins[owner] + offset)
    ids, names, firsts = (np.array([p[c] for p in parts], np.int64)[owner] for c in (0, 1, 2))
    order = np.lexsort((firsts + offset, names, ids, rank))  # suffix order, equal suffixes by position
    same = np.zeros(len(order) + 1, bool)  # same[i]: suffix i and its left neighbour agree over the whole length
    ranked = rank[order]
    same[1:-1] = (ranked[1:] == ranked[:-1]) & (ranked[1:] >= 0)
    hit = np.zeros(len(order), bool)
    hit[order] = same[:-1] | same[1:] if keep == "none" else same[:-1]
    return np.split(hit, np.cumsum(many)[:-1])


def _find(length: int, keep: str):
    """Rows come sorted by anchor. Whole anchors are put into suffix order together until ORDERED bytes are reached; an anchor with more is taken
    by ranges of the window's offset from it, since only windows with equal offsets can be equal."""

    def spans(parts: list[tuple]) -> Iterator[tuple[int, int, int]]:
        for part, hit in zip(parts, copied(parts, length, keep), strict=True):
            edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield part[1], part[2] + a, part[2] + b - 1 + length

    def cut(rows: list[tuple]) -> Iterator[list[tuple]]:
        for low in range(0, max(r[5] for r in rows) + 1, OFFSETS):
            parts = []
            for first_id, name, first, windows, data, left in rows:
                a, b = max(0, left - low - OFFSETS + 1), min(windows, left - low + 1)
                if a < b:
                    parts.append((first_id, name, first + a, b - a, data[a : b - 1 + length]))
            if len(parts) > 1:
                yield parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["text_hash", "start", "end"])

        held: list[tuple] = []
        group: list[tuple] = []
        held_bytes = group_bytes = 0
        anchor = None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, held_bytes
            if len(group) < 2:
                return
            if group_bytes > ORDERED:
                for parts in cut(group):
                    yield out(list(spans(parts)))
                return
            held += [r[:5] for r in group]
            held_bytes += group_bytes
            if held_bytes > ORDERED // 2:
                yield out(list(spans(held)))
                held, held_bytes = [], 0

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "first_id", "text_hash", "first", "windows", "data", "left")]
            for name, *row in zip(*columns, strict=True):
                if name != anchor:
                    yield from close()
                    anchor, group, group_bytes = name, [], 0
                group.append(tuple(row))
                group_bytes += len(row[4])
        yield from close()
        if held:
            yield out(list(spans(held)))

    return run


def _windows(length: int):
    """One row for each window of a segment: hash of its bytes, and where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                many = part.column("windows").to_numpy()
                found = [xxhash.xxh3_128_digest(data[i : i + length]) for data, n in zip(part.column("data").to_pylist(), many.tolist(), strict=True) for i in range(n)]
                shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                ids, names, firsts = (np.repeat(part.column(c).to_numpy(), many) for c in ("first_id", "text_hash", "first"))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids), pa.array(names), pa.array(firsts + shift)], ["name", "first_id", "text_hash", "start"])

    return run


STRETCH = 4096  # positions of a text whose windows are joined in one group


def _of_hot(segments_: DataFrame, length: int, keep: str) -> DataFrame:
    """text_hash, start, end of the windows that have an earlier (or any) copy among the segments of hot anchors. Windows that overlap or touch are
    joined inside stretches of STRETCH positions, so a text leaves few rows however many windows go."""
    rows = stored(segments_.mapInArrow(_windows(length), "name binary, first_id long, text_hash long, start long"), "windows")
    place = F.struct("first_id", "text_hash", "start")
    several = rows.groupBy("name").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most")
    copies = rows.join(several, "name")
    if keep == "first":
        copies = copies.where(place != F.col("least"))
    own = Window.partitionBy("text_hash", "stretch").orderBy("start")
    near = copies.select("text_hash", "start", F.floor(F.col("start") / STRETCH).alias("stretch")).distinct()
    begins = (F.col("start") - F.coalesce(F.lag("start").over(own), F.lit(-(1 << 62))) > length).cast("int")
    runs = near.withColumn("begins", begins).withColumn("run", F.sum("begins").over(own))
    return runs.groupBy("text_hash", "stretch", "run").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end")).select("text_hash", "start", "end")


def _repeated(anchors: DataFrame) -> DataFrame:
    """The rows of anchors that occur at two places or more. Rows of an anchor that is met everywhere stay where they are: such anchors, MOST_SPREAD at most,
    are known to every task. Only the rows of the others are dealt by anchor."""
    place = F.xxhash64("text_hash", "at")
    counts = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("anchor", "n"), "repeated")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    often = counts.where(F.col("n") > max(SPREAD, total // MOST_SPREAD)).select("anchor")
    rest = anchors.join(F.broadcast(often), "anchor", "left_anti").join(counts.select("anchor"), "anchor", "left_semi")
    return anchors.join(F.broadcast(often), "anchor", "left_semi").unionByName(rest)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def repeated_spans(docs: DataFrame, length: int, keep: str) -> DataFrame:
    """text_hash, n_rows, first_id, spans: for texts with a copy or a repeated window. Spans are arrays of (start, end) in bytes."""
    texts = keyed(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text"))
    classes = texts.groupBy("text_hash").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id"))
    long_texts = texts.where(F.octet_length("text") >= length)
    anchors = stored(long_texts.select("text_hash", "text").mapInArrow(_anchors(length), "anchor long, text_hash long, at long"), "anchors")
    marked = _repeated(anchors).groupBy("text_hash").agg(F.collect_set("at").alias("ats"))
    marked = stored(marked.join(classes, "text_hash"), "marked")
    forget(anchors)
    one = long_texts.join(marked, "text_hash").where("doc_id = first_id").select("text_hash", "first_id", "ats", "text")
    shipped = stored(one.mapInArrow(_ship(length, keep), "anchor long, text_hash long, first_id long, first long, windows long, left long, data binary, kind int"), "segments", "kind")
    forget(marked)
    apart = shipped.where("kind = 0").dropDuplicates(["anchor", "text_hash", "first"])
    hot = stored(shipped.where("kind = 0").groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot")
    some_hot = not hot.isEmpty()
    few = (apart.join(hot, "anchor", "left_anti") if some_hot else apart).repartition("anchor").sortWithinPartitions("anchor")
    found = stored(few.select("anchor", "first_id", "text_hash", "first", "windows", "data", "left").mapInArrow(_find(length, keep), "text_hash long, start long, end long"), "spans")
    if some_hot:
        found = found.unionByName(_of_hot(apart.join(hot, "anchor", "left_semi"), length, keep))
    local = shipped.where("kind = 1").select("text_hash", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + length).alias("end"))
    spans = found.unionByName(local).groupBy("text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return classes.join(spans, "text_hash", "left").where("n_rows > 1 or spans is not null")


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removed(size: int, length: int, keep: str, n_rows: int | None, later: bool, spans: list | None) -> list[tuple[int, int]]:
    if size >= length and (later if keep == "first" else (n_rows or 0) > 1):
        return [(0, size)]
    return merged([(s["start"], s["end"]) for s in spans or []])


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _with_spans(docs: DataFrame, length: int, keep: str) -> tuple[DataFrame, list[str]]:
    """`docs` with three more columns, and their names: how many rows have the text, whether this one is a later copy, the spans."""
    h, first, rows, later, spans = fresh(docs, "text_hash", "first_id", "n_rows", "later", "spans")
    found = repeated_spans(docs, length, keep).select(F.col("text_hash").alias(h), F.col("first_id").alias(first), F.col("n_rows").alias(rows), F.col("spans").alias(spans))
    own: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    joined = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit("")))).join(found, h, "left")
    return joined.withColumn(later, F.coalesce(own > F.col(first), F.lit(False))).drop(h, first), [rows, later, spans]


def summaries(docs: DataFrame, length: int = 400, keep: str = "none", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and `text`, what is left of it, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, n, later, spans in zip(texts_of(batch), *(batch.column(c).to_pylist() for c in helpers), strict=True):
                data = text.encode()
                gone = _removed(len(data), length, keep, n, later, spans)
                rest = _cut(data, gone)
                rows.append((len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else ""))
            columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
            yield out if with_text else out.select(out.schema.names[:-1])

    joined, helpers = _with_spans(docs.select("doc_id", "text"), length, keep)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if with_text else ""))


def remove(docs: DataFrame, length: int = 400, keep: str = "first", least_words: int = 0, least_bytes: int = 0) -> DataFrame:
    """The rows of `docs` with the repeated spans cut out of `text`. Rows whose whole text goes are left with an empty text. Spans stay that have
    fewer than both `least_words` words (parts of words count) and `least_bytes` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, n, later, spans in zip(*(batch.column(c).to_pylist() for c in ("text", *helpers)), strict=True):
                data = (text or "").encode()
                gone = _removed(len(data), length, keep, n, later, spans) if text else []
                gone = [(a, b) for a, b in gone if b - a >= least_bytes or len(data[a:b].split()) >= least_words]
                texts.append(_cut(data, gone).decode("utf-8", "ignore") if gone else text)
            out = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    names = docs.columns
    joined, helpers = _with_spans(docs, length, keep)
    return joined.mapInArrow(run, docs.schema)
