"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the list of its most frequent n-grams (one to three letters, counted inside words, with a blank at
each word's ends) over all training documents. A document's own most frequent n-grams are compared with each profile: an
n-gram costs the difference of its two ranks, or the full profile length if the profile lacks it. The smallest sum wins.

Rows: every row gives one row. A text that is null or has no letter is `und` with score 0, as is every text when nothing could
be learned. Ties of rank go to the smaller n-gram, ties of distance to the language that sorts first. Whole texts are used,
whatever their length; repeated rows are repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hourloom.llm.common import pieces, texts_of

UNKNOWN = "und"
BLANK = 32
BITS = np.int64(21)  # of a code point


@functools.cache
def letters() -> np.ndarray:
    """Code point to the code point of its lower-case letter; everything that is no letter becomes a blank."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def spelled(text: str) -> np.ndarray:
    """Letters of the text with single blanks between words and at both ends; empty if it has no letter."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = codes == BLANK
    if blank.all():
        return codes[:0].astype(np.int64)
    codes = np.concatenate([[BLANK], codes, [BLANK]]).astype(np.int64)
    blank = np.concatenate([[True], blank, [True]])
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return codes[keep]


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams as numbers: a letter, a pair that is not two words' border, three with no blank in the middle."""
    inner = codes != BLANK
    pairs = (codes[:-1] << BITS) | codes[1:]
    triples = ((codes[:-2] << (2 * BITS)) | (codes[1:-1] << BITS) | codes[2:])[inner[1:-1]]
    return np.concatenate([codes[inner], pairs, triples])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    values, counts = np.unique(grams(codes), return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:most]]


def profiles(training: DataFrame, most: int) -> DataFrame:
    """lang, gram, rank (from 0): the `most` most frequent n-grams of each language, counted over every training document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1_000_000):
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), texts_of(part), strict=True):
                    by_lang.setdefault(lang, []).append(spelled(text))
                for lang, found in by_lang.items():
                    values, counts = np.unique(np.concatenate([grams(x) for x in found if len(x)] or [np.zeros(0, np.int64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    counts = training.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = (F.col("n").desc(), F.col("gram"))
    # a language's n-grams are first cut down in salted parts, so that no task ranks all of them
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(64)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r") <= most)
    final = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < most)
    return final.select("lang", "gram", "rank")


class Profiles:
    """The profiles side by side: for each known n-gram, its rank in every language, or `most`."""

    def __init__(self, rows: list, most: int):
        self.most = most
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), most, np.int32)
        at = {lang: i for i, lang in enumerate(self.langs)}
        places = np.searchsorted(self.grams, np.array([r["gram"] for r in rows], np.int64))
        for place, r in zip(places, rows, strict=True):
            self.ranks[place, at[r["lang"]]] = r["rank"]

    def predict(self, text: str) -> tuple[str, float]:
        codes = spelled(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, self.most)
        places = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        places = np.where(self.grams[places] == own, places, len(self.grams))
        theirs = self.ranks[places]
        away = np.where(theirs == self.most, self.most, np.abs(theirs - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.most * len(own))


def learn(training: DataFrame, most: int = 300) -> Profiles:
    """Profiles of all languages of `training` (lang, text). Only the profiles come to the driver: `most` rows a language."""
    known = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return Profiles(profiles(known, most).collect(), most)


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, lang_pred, score: one minus the winning distance over the largest possible one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x) for x in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, model: Profiles, name: str) -> DataFrame:
    """The rows of `docs` with a column `name` for the predicted language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.predict(x)[0] for x in texts_of(batch)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())]))
