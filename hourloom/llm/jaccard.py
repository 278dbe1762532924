"""Documents linked by the Jaccard similarity of their word n-grams, by prefixes under several global orders.

If two sets have similarity t or more, then under any one order of all tokens they share a token among the first
`size - ceil(t * size) + 1` of each. Three orders are used. Each puts tokens that many documents have last (their counts come
from a sketch of fixed size, so two tokens may share a count; any order is valid), and within that sorts by a different hash.

1.  One pass over the texts gives a fingerprint of each document's set, by which documents with equal sets form a class, and packets of
    tokens by hash range, each token once for a group of documents. Where the packets of a range meet, the tokens that one document alone has
    are known, and their number goes back to the group. A class with a whole prefix of such tokens is similar to none: under an order that
    has them first it shares no prefix token. Only the sets of the other classes are kept.
2.  A sketch of these sets tells the frequent tokens. A token that several classes have in their prefix under the first order is replaced by
    the smallest of them, its leader: all classes that share the token share the leader. Of the classes below a leader with a neighbour of
    fitting size there, those stay that have a partner of fitting size that shares a prefix token under each of the other orders too.
3.  The classes of a leader are verified together by exact intersection counts. Large groups are cut into chunks; each task
    compares two chunks and returns one link for each member to the smallest one it reaches, never the pairs.
4.  Components of these links, by `graph.components`.

Only fingerprints, packets, and the texts, prefixes and sets of candidates are shuffled. Tokens are 64-bit hashes of word n-grams; a packet has 41 bits or more of
each, of every second token by hash. Tokens that agree there count as one that both documents have, which costs work and no link.

Rows: every row gives one row. A text that is null or has no word has an empty set and is linked with nothing; one with fewer than
n words has its whole sequence as its only token. Rows that repeat are linked by their equal sets. A component without any doc_id
has a null id. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourloom.llm.common import WordHashes, forget, fresh, mix, runs_of, stored, texts_of
from hourloom.llm.graph import components

SEEDS = (0x51ED270B1A5B3C97, 0x2F8D1C3B5A697887, 0x6C0793E1D2B4A5F3)
CHUNK = 512  # classes of a leader that are compared in one task with as many others
CHUNK_TOKENS = 400_000
COLUMNS = 4096
GROUP_TOKENS = 1_000_000  # tokens of a group of documents, at which it is closed
GROUP_CLASSES = 60_000
RANGES = 512  # hash ranges at least
RANGE_BYTES = 32 << 20  # text for each hash range, at most
SHARED = 0xFFFF  # instead of a document: several of the group have the token


def token_set(hashes: WordHashes, text: str, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; A-Z count as lower case, words end at ASCII white space."""
    return np.unique(runs_of(hashes.of(text.encode().lower().split()), n))


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(bits: int):
    """Counts of the tokens of all sets by the leading bits of their hash, in blocks of little-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, shift = np.zeros(1 << bits, np.uint32), np.uint64(64 - bits)
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint64)
            sketch += np.bincount((tokens >> shift).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        if sketch.any():
            blocks = [x.astype("<u4").tobytes() for x in np.split(sketch, 64)]
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(blocks, pa.binary())], ["block", "counts"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            got = np.frombuffer(counts, "<u4").astype(np.uint64)
            total[block] = total[block] + got if block in total else got
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def levels(sketch_rows: DataFrame, bits: int) -> np.ndarray:
    """For each slot of the sketch 0, or the power of two of its count where that stands out from the mean load. One byte a slot."""
    summed = sketch_rows.repartition(8, "block").mapInArrow(_add_blocks, "block int, counts binary").collect()
    counts = np.zeros((64, (1 << bits) // 64), np.float64)
    for r in summed:
        counts[r["block"]] = np.frombuffer(r["counts"], np.uint64)
    counts = counts.ravel()
    mean = counts.mean()
    over = counts - mean
    return np.where(over > 6 * np.sqrt(mean) + 8, np.log2(np.maximum(over, 1)).astype(np.uint8) + 1, 0).astype(np.uint8)


def prefix_length(size, percent: int):
    return size - -(-percent * size // 100) + 1


def first_tokens(tokens: np.ndarray, percent: int, level: np.ndarray, seed: int) -> np.ndarray:
    """The prefix of a set under one order: tokens that few documents have first, then by hash."""
    most = prefix_length(len(tokens), percent)
    weight = level[tokens >> np.uint64(64 - (len(level).bit_length() - 1))]
    return tokens[np.lexsort((mix(tokens ^ np.uint64(seed)), weight))[:most]].view(np.int64)


SCAN = "doc_id long, text_hash long, n_shingles long, class long, part long, range long, tokens binary, owners binary, kind int"


def _packets(part: int, names: list[int], sets: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, tokens, owners) of a group of classes: of every second token by hash the 32 bits after those of its range, in order, and the position of the one
    class that has it, or SHARED. Range -1 has the classes and their sizes."""
    yield -1, np.array(names, "<i8").tobytes(), np.array([len(x) for x in sets], "<i8").tobytes()
    half = [x[x & np.uint64(1) == 0] for x in sets]
    tokens, owner = np.concatenate(half), np.repeat(np.arange(len(half), dtype="<u2"), [len(x) for x in half])
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    first = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
    owner = np.where(np.r_[first[1:], True][: len(tokens)], owner, SHARED).astype("<u2")[first]
    tokens = tokens[first]
    cuts = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    short = ((tokens >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    for i in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(i), short[cuts[i] : cuts[i + 1]].tobytes(), owner[cuts[i] : cuts[i + 1]].tobytes()


def _scan(n: int, bits: int):
    """kind 0: doc_id, text_hash, n_shingles, class of each document; kind 1: the packets (part, range, tokens, owners) of groups of classes."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "n_shingles", "class", "part", "range")] + [("tokens", pa.binary()), ("owners", pa.binary()), ("kind", pa.int32())])

    def packets(part: int, held: dict[int, np.ndarray]) -> pa.RecordBatch:
        ranges, tokens, owners = zip(*_packets(part, list(held), list(held.values()), bits), strict=True)
        none, many = pa.nulls(len(ranges), pa.int64()), len(ranges)
        named = pa.array(np.full(many, part)), pa.array(ranges, pa.int64()), pa.array(tokens, pa.binary()), pa.array(owners, pa.binary())
        return pa.RecordBatch.from_arrays([none, none, none, none, *named, pa.array(np.ones(many, np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, waiting, part = WordHashes(), {}, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes, classes = [], []
            for text in texts_of(batch):
                tokens = token_set(hashes, text, n)
                sizes.append(len(tokens))
                classes.append(class_of(tokens) if len(tokens) else None)
                if len(tokens) and classes[-1] not in held:
                    held[classes[-1]] = tokens
                    waiting += len(tokens)
                if waiting >= GROUP_TOKENS or len(held) >= GROUP_CLASSES:
                    yield packets(part, held)
                    held, waiting, part = {}, 0, part + 1
            rows = batch.num_rows
            none, no_bytes = pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), none, none, no_bytes, no_bytes, pa.array(np.zeros(rows, np.int32))], schema=schema)
        if held:
            yield packets(part, held)

    return run


def _alone(packets: pa.Table) -> pa.Table:
    """Of one hash range: the owners of tokens that one class of one group alone has."""
    parts = packets.column("part").to_numpy()
    tokens = [np.frombuffer(x, "<u4") for x in packets.column("tokens").to_pylist()]
    at = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    tokens, owner = np.concatenate(tokens), np.frombuffer(b"".join(packets.column("owners").to_pylist()), "<u2")
    order = np.argsort(tokens)
    differs = tokens[order][1:] != tokens[order][:-1]
    once = order[np.r_[True, differs] & np.r_[differs, True]]
    once = np.sort(once[owner[once] != SHARED])
    cuts = np.searchsorted(at[once], np.arange(len(parts) + 1))
    owners = [owner[once[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table([pa.array(parts), pa.nulls(len(parts), pa.binary()), pa.array(owners, pa.binary())], names=["part", "tokens", "owners"])


def _open_classes(percent: int):
    """Of one group: the classes without a whole prefix of tokens that they alone have."""

    def run(rows: pa.Table) -> pa.Table:
        alone, names, sizes = 0, None, None
        for tokens, owners in zip(rows.column("tokens").to_pylist(), rows.column("owners").to_pylist(), strict=True):
            if tokens is None:
                alone = alone + np.bincount(np.frombuffer(owners, "<u2"), minlength=GROUP_CLASSES)
            else:
                names, sizes = np.frombuffer(tokens, "<i8"), np.frombuffer(owners, "<i8")
        few = np.zeros(len(names), np.int64) + (alone if np.isscalar(alone) else alone[: len(names)]) < prefix_length(sizes, percent)
        return pa.table([pa.array(names[few])], names=["class"])

    return run


def open_classes(packets: DataFrame, percent: int) -> DataFrame:
    """class: those that could be similar to another class, and those with equal sets in several groups."""
    names = packets.where("range < 0").select("part", "tokens", "owners")
    alone = packets.where("range >= 0").select("part", "range", "tokens", "owners").groupBy("range").applyInArrow(_alone, "part long, tokens binary, owners binary")
    return stored(alone.unionByName(names).groupBy("part").applyInArrow(_open_classes(percent), "class long").distinct(), "open")


def _prefixes(percent: int, level: np.ndarray, *orders: int):
    """class, ord, token under these orders, from sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("class").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens = np.frombuffer(data, np.uint64)
                for i in orders:
                    found = first_tokens(tokens, percent, level, SEEDS[i])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name, np.int64)), pa.array(np.full(len(found), i, np.int32)), pa.array(found)], ["class", "ord", "token"])

    return run


def _shared(prefixes: DataFrame) -> DataFrame:
    """ord, token, class, leader of tokens that several classes have; the leader is the smallest of them. One shuffle by token: rows are small, a window spills, and
    tokens of many classes are last in every order, so only groups of near copies have long ones."""
    same = Window.partitionBy("ord", "token")
    led = prefixes.withColumn("leader", F.min("class").over(same)).withColumn("other", F.max("class").over(same))
    return led.where("leader < other").drop("other")


def leaders(prefixes: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """leader, class: for every class the leaders of its shared tokens under the first order, where the next smaller or the next larger class of that leader
    has a size that could be similar. `sizes` has class, size."""
    led = _shared(prefixes).select("leader", "class").distinct().join(sizes, "class")
    order = Window.partitionBy("leader").orderBy("size", "class")
    near = led.withColumn("less", F.lag("size").over(order)).withColumn("more", F.lead("size").over(order))
    fits = (100 * F.col("less") >= percent * F.col("size")) | (100 * F.col("size") >= percent * F.col("more"))
    return stored(near.where(fits).select("leader", "class"), "leaders")


def _tasks(members: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows (leader, class, size) dealt into comparisons: (leader, i, j), where side tells the two chunks i < j apart. A chunk has about CHUNK members
    and CHUNK_TOKENS tokens. The columns of `heavy`, by class, join last, so that they are shuffled once."""
    size = members.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_TOKENS)).cast("int").alias("chunks"), F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("class", "leader"), F.col("chunks")).cast("int")
    dealt = members.join(size.drop("n"), "leader").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "class")
    return dealt.join(heavy, "class").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "class")


def _by_task(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """(leader, rows) of each comparison with two rows or more; rows are (side, class, columns)."""
    task, rows = None, []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j")), strict=True)
        for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("side", "class", *columns)), strict=True), strict=True):
            if key != task:
                if len(rows) > 1:
                    yield task[0], rows
                task, rows = key, []
            rows.append(row)
    if len(rows) > 1:
        yield task[0], rows


def _sides(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two chunks; within one chunk both are all rows."""
    side = np.array([r[0] for r in rows])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (left, right) if len(left) and len(right) else (np.arange(len(rows)), np.arange(len(rows)))


def _spread(ids: np.ndarray, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each row the smallest id it reaches over the links between left and right rows."""
    root, none = ids.copy(), np.iinfo(np.int64).max
    while True:
        before = root.copy()
        root[left] = np.minimum(root[left], np.where(linked, root[right][None, :], none).min(axis=1))
        root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], none).min(axis=0))
        if (root == before).all():
            return root


def _agree(percent: int):
    """leader, class of members with a partner that passes every filter: sizes, and a shared prefix token under each of the other orders. The leader is now
    the smallest class that is reached over such partners, so candidates that met below several leaders meet once from here on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_task(batches, "size", "t1", "t2"):
            left, right = _sides(rows)
            size = np.array([r[2] for r in rows])
            low, high = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
            ok = 100 * low >= percent * high
            for c in (3, 4):
                if not ok.any():
                    break
                sets = [np.array(sorted(r[c]), np.int64) for r in rows]
                ok &= shared_counts([sets[i] for i in left], [sets[i] for i in right]) > 0
            names = np.array([r[1] for r in rows])
            ok &= names[left][:, None] != names[right][None, :]
            found = np.unique(np.concatenate([left[ok.any(axis=1)], right[ok.any(axis=0)]]))
            root = _spread(names, left, right, ok) if len(found) else names
            yield pa.RecordBatch.from_arrays([pa.array(root[found]), pa.array(names[found])], ["leader", "class"])

    return run


def agreeing(first: DataFrame, sets: DataFrame, percent: int, level: np.ndarray) -> DataFrame:
    """leader, class: groups of classes with a partner under every order."""
    # read once, so they go straight into the shuffle
    kept = _shared(sets.select("class", "tokens").mapInArrow(_prefixes(percent, level, 1, 2), "class long, ord int, token long"))
    # at most a prefix each; half of a token's bits are enough for a filter
    own = [F.collect_set(F.when(F.col("ord") == i, F.col("token").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).alias(f"t{i}") for i in (1, 2)]
    filters = stored(kept.groupBy("class").agg(*own).where("size(t1) > 0 and size(t2) > 0").join(sets.select("class", "size"), "class"), "filters")
    members = first.join(filters.select("class", "size"), "class")
    found = stored(_tasks(members, filters).mapInArrow(_agree(percent), "leader long, class long").distinct(), "members")
    forget(filters)
    return found


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep, data = [], []
            for wanted, text in zip(batch.column("class").to_pylist(), texts_of(batch), strict=True):
                tokens = token_set(hashes, text, n)
                if len(tokens) and class_of(tokens) == wanted:
                    keep.append(wanted)
                    data.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([len(x) // 8 for x in data], pa.int64()), pa.array(data, pa.large_binary()).cast(pa.binary())], ["class", "size", "tokens"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the tokens that both sides have."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        return rows[hit], at[hit]

    (rows_l, at_l), (rows_r, at_r) = cells(left), cells(right)
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(both), COLUMNS):
        wide = []
        for rows, at, many in ((rows_l, at_l, len(left)), (rows_r, at_r, len(right))):
            matrix = np.zeros((many, COLUMNS), np.float32)
            inside = (at >= start) & (at < start + COLUMNS)
            matrix[rows[inside], at[inside] - start] = 1
            wide.append(matrix)
        total += wide[0] @ wide[1].T
    return total.astype(np.int64)


def _verify(percent: int):
    """The links of each comparison: every member to the smallest it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_task(batches, "tokens"):
            left, right = _sides(rows)
            sets = [np.frombuffer(r[2], np.uint64) for r in rows]
            shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(x) for x in sets])
            linked = 100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared)
            ids = np.array([r[1] for r in rows])
            root = _spread(ids, left, right, linked)
            yield pa.RecordBatch.from_arrays([pa.array(ids[root != ids]), pa.array(root[root != ids])], ["a", "b"])

    return run


def linked_classes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that have a leader in common and are similar."""
    light = members.join(sets.select("class", "size"), "class")
    return _tasks(light, sets.select("class", "tokens")).mapInArrow(_verify(percent), "a long, b long")


def link_components(docs: DataFrame, n: int = 3, percent: int = 90, sketch_bits: int = 20) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least `percent` similarity), text_hash,
    root (one value for each component, null for an empty set)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(RANGES, size // RANGE_BYTES).bit_length() - 1
    scanned = stored(keyed.mapInArrow(_scan(n, bits), SCAN), "scan", "kind")
    rows = scanned.where("kind = 0").select("doc_id", "text_hash", "n_shingles", "class")
    left = open_classes(scanned.where("kind = 1"), percent)
    forget(scanned, "kind=1")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.min("text_hash").alias("any_hash"))
    wanted = left.join(classes, "class").select("class", F.col("doc_id").alias("own"), F.coalesce("text_hash", "any_hash").alias("own_hash"))
    texts = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash"))).select("class", "text")
    sets = stored(texts.mapInArrow(_sets(n), "class long, size long, tokens binary").dropDuplicates(["class"]), "sets")
    forget(left)
    sketch = stored(sets.select("tokens").mapInArrow(_sketch(sketch_bits), "block int, counts binary"), "sketch")
    level = levels(sketch, sketch_bits)
    forget(sketch)
    prefixes = sets.select("class", "tokens").mapInArrow(_prefixes(percent, level, 0), "class long, ord int, token long")
    first = leaders(prefixes, sets.select("class", "size"), percent)
    agreed = agreeing(first, sets, percent, level)
    roots = components(linked_classes(agreed, sets, percent))
    for done in (first, agreed, sets):
        forget(done)
    named = classes.select("class", "doc_id").join(roots, F.col("class") == F.col("node"), "left").select("class", F.coalesce("root", "class").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = named.select("class", "root").join(least, "root")
    return rows.join(found, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash", "root"
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without all but one document of each component: the smallest doc_id stays, then the smallest text hash. Rows that
    repeat a doc_id and its text are one document."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text"))
    found = link_components(docs, n, percent)
    linked = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    stay = linked.unionByName(found.where("root is null").select("doc_id", "text_hash"))
    (name,) = fresh(docs, "document_key")
    stay = stay.select(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), "text_hash").alias(name))
    return docs.withColumn(name, key).join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
