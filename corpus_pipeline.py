"""The corpus pipeline over `documents`: language, near duplicates, repeated spans, benchmark items, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of `documents`, whatever further columns those have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, contamination, jaccard, language, suffix
from hourloom.llm.common import fold, fresh, stored
from hourloom.llm.queries import table, vocabulary

SPAN_BYTES, SPAN_WORDS = 400, 51  # what goes has so many bytes or words at least
WINDOW_BYTES = 2 * SPAN_WORDS - 1  # no passage of so many words is shorter


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter, and so no language, go, whether or not profiles could be learned."""
    model = language.learn(docs.where(fold("doc_id", 4) != 2))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    (name,) = fresh(docs, "language")
    return language.with_language(docs, model, name).where(F.col(name) != language.UNKNOWN).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, one stays."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes, that earlier documents have are cut out. Documents of which nothing is left go."""
    cut = suffix.remove(docs, length=WINDOW_BYTES, keep="first", least_words=SPAN_WORDS, least_bytes=SPAN_BYTES)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(F.length(F.trim("text")) > 0)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 0.8 or more of the five-word shingles of a benchmark item go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"), percent=80)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.round_trip_digests(docs, vocabulary())


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("decontamination", decontaminated),
    ("encoding", encoded),
]

# SQL has no rank-order profiles and no BPE: the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
