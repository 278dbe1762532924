"""Runs of words: maximal periodic stretches, from Lyndon arrays under both orders of the alphabet.

Phase one of Baier's suffix sorter keeps positions in groups by the Lyndon word that starts there and takes the groups from the highest down. A
group's positions, and rows of them, are swallowed by the position before, which moves to a group of its own above the one it was in. When a
group's turn comes its word is final: its length is the entry of the Lyndon array. The phase is run with the words' order and with its reverse; every run has a
root in one of the two (Bannai et al., 2017). Roots that repeat are extended to both sides by longest common extensions, which compare the words' numbers.

A document is worked on whole, in a task that holds about 200 bytes per word of the one at hand. Documents need no shuffle.

Nulls and empty texts have no words and no runs. Long texts are not cut. Repeated rows and rows without doc_id are rows like others. An empty table
gives no rows. Further columns are left out of the result and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
OUT_BYTES = 4_000_000  # text of a result batch


def lyndon_array(codes: list[int], letters: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position; `letters` lists the codes from the highest to the lowest."""
    n = len(codes)
    before, after = list(range(-1, n)), list(range(1, n + 2))  # the positions not yet swallowed, as a linked list
    out = [0] * n
    number = {c: g for g, c in enumerate(letters)}
    group = [number[c] for c in codes]
    group.append(-1)  # the end, and by index -1 the place before the start
    members: list[list[int]] = [[] for _ in letters]
    for i in range(n):
        members[group[i]].append(i)
    size = [len(m) for m in members]
    length = [1] * len(letters)
    above, below = list(range(-1, len(letters) - 1)), list(range(1, len(letters) + 1))
    below[len(letters) - 1 :] = [-1]
    g = 0 if letters else -1
    while g >= 0:
        word = length[g]
        if size[g] == 1:
            i = members[g][0] if len(members[g]) == 1 else next(x for x in members[g] if group[x] == g)
            out[i] = word
            p, q = before[i], after[i]
            before[q] = p
            if p >= 0:
                after[p] = q
                h = group[p]
                if size[h] == 1:
                    length[h] += word
                else:
                    new = len(members)
                    size[h] -= 1
                    group[p] = new
                    members.append([p])
                    size.append(1)
                    length.append(length[h] + word)
                    a = above[h]
                    above.append(a)
                    below.append(h)
                    below[a] = above[h] = new
        elif size[g]:
            moved: dict[tuple[int, int], list[int]] = {}
            for i in members[g]:
                if group[i] != g:
                    continue
                out[i] = word
                p = before[i]
                if p >= 0 and group[p] == g:
                    continue
                q, k = after[i], 1
                while group[q] == g:
                    q, k = after[q], k + 1
                before[q] = p
                if p >= 0:
                    after[p] = q
                    moved.setdefault((group[p], k), []).append(p)
            last, top = -1, -1
            for h, k in sorted(moved) if len(moved) > 1 else moved:
                if h != last:
                    last = top = h
                positions = moved[h, k]
                if len(positions) == size[h]:
                    # nobody stays, and whoever left h before is above: the group keeps its number, but has to follow the others of h
                    if top == h:
                        length[h] += k * word
                        continue
                new = len(members)
                size[h] -= len(positions)
                for p in positions:
                    group[p] = new
                members.append(positions)
                size.append(len(positions))
                length.append(length[h] + k * word)
                a = above[top]
                above.append(a)
                below.append(top)
                below[a] = above[top] = new
                top = new
        g = below[g]
    return out


def _extension(codes: np.ndarray, i: int, j: int) -> int:
    """How many numbers from i and from j (> i) on are equal."""
    most, at, step = len(codes) - j, 0, 32
    while at < most:
        size = min(step, most - at)
        differ = codes[i + at : i + at + size] != codes[j + at : j + at + size]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = at + size, step * 2
    return most


def runs(words: list[bytes], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `exponent` (2 or more) periods and `least` words, by start, then period."""
    n = len(words)
    number: dict[bytes, int] = {}
    listed = [number.setdefault(w, len(number)) for w in words]
    if n < max(least, exponent) or len(number) == n:
        return []
    codes, letters = np.array(listed), list(range(len(number)))
    flipped = codes[::-1]
    found: dict[int, list[tuple[int, int]]] = {}
    for order in (letters[::-1], letters):
        root = np.array(lyndon_array(listed, order))
        # a stretch of `exponent` periods holds exponent - 1 whole roots side by side, wherever it starts
        at = np.flatnonzero(np.arange(n) + root * max(exponent - 1, 1) <= n)
        for k in range(1, exponent - 1):
            at = at[root[at + k * root[at]] == root[at]]
            at = at[codes[at + k * root[at]] == codes[at]]
        done: dict[int, int] = {}  # period -> where its last run ends
        for i, p in zip(at.tolist(), root[at].tolist()):
            if i + p <= done.get(p, -1):
                continue
            right = _extension(codes, i, i + p) if i + p < n else 0
            left = _extension(flipped, n - i - p, n - i) if i else 0
            start, length = i - left, left + p + right
            done[p] = start + length
            if length >= max(least, exponent * p):
                found.setdefault(p, []).append((start, length))
    return sorted({(s, length, p) for p, rows in found.items() for s, length in rows}, key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], spans: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not spans:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in spans:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _found(exponent: int, least: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            rows, start, total = [], 0, 0
            for i in range(len(texts)):
                words = (texts[i].as_py() or b"").split()
                spans = runs(words, exponent, least)
                rows.append(([dict(zip(("start", "length", "period"), s)) for s in spans], collapsed(words, spans), len(words)))
                total += len(rows[-1][1])
                if total > OUT_BYTES or i == len(texts) - 1:
                    n_words, found, left = [r[2] for r in rows], [r[0] for r in rows], [r[1] for r in rows]
                    ids = batch.column("doc_id").slice(start, len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t.type) for c, t in zip((n_words, found, left), list(schema)[1:]))], schema=schema)
                    rows, start, total = [], i + 1, 0

    return run


def find(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in words), collapsed (the words outside repetitions) of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed binary"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    found = source.mapInArrow(_found(exponent, least, schema), ddl)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
