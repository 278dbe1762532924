"""The queries of the operators over the given tables, and SQL where SQL can express one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, contamination, cotrain, jaccard, language, lm, packed, periodic, rules, sharding, suffix, warc, whitening
from hourloom.llm.common import fold, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary() -> str:
    """The vocabulary file: HOURLOOM_VOCABULARY, or the one of the installed package of public tokenizers."""
    given = os.environ.get("HOURLOOM_VOCABULARY")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op6_rank_order_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.learn(docs.where(fold("doc_id", 4) != 2))
    return language.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op7_prefix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, folder, "documents"), vocabulary())


@query
def op10_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch(spark, "packed")
    packed.write(table(spark, folder, "documents"), vocabulary(), files)
    return packed.summaries(packed.read(spark, files))


@query
def op9_order_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(table(spark, folder, "documents"), n=3, percent=90).drop("text_hash", "root")


@query
def op4_lpf_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.summaries(table(spark, folder, "documents"), length=400, keep="none", with_text=True)


def shingles_sql(source: str, key: str) -> str:
    return rf"""SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS g
        FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {source}) WHERE len(w) >= 5"""


@query
def op2_containment_search(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=80)


SQL["op2_containment_search"] = f"""
    WITH i AS ({shingles_sql("benchmark", "item_id")}), d AS ({shingles_sql("documents", "doc_id")}),
    sizes AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
    SELECT doc_id, item_id, n_shingles, count(*) AS n_shared
    FROM d JOIN i USING (g) JOIN sizes USING (item_id)
    GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""

@query
def op5_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch(spark, "warc")
    warc.write(table(spark, folder, "pages"), files, date="2024-01-01T00:00:00Z")
    return warc.summaries(warc.records(spark, files))


SQL["op5_warc_archive"] = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h, min(page_id) OVER (PARTITION BY sha256(b)) AS owner FROM p)
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
        CASE WHEN n >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 100 AND page_id <> owner THEN owner END AS refers_to
    FROM d
"""


@query
def op1_isolation_forest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, folder, "labels")))


@query
def op3_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return cotrain.score(docs, cotrain.fit(docs, table(spark, folder, "labels")))


@query
def op8_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), vocabulary(), fold("doc_id", 7) == 2)


@query
def op11_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Law `bytes`: an even first map of the slots, edited once by the bytes per slot; both versions are stored, the last one deals."""
    rows = sharding.records(table(spark, folder, "documents"))
    maps, sizes = scratch(spark, "slot-map"), sharding.slot_sizes(rows)
    first = sharding.SlotMap.even(24)
    first.store(spark, maps)
    first.rebalanced(sizes).store(spark, maps)
    dealt = sharding.assign(rows, sharding.SlotMap.load(spark, maps))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of the contract's input: documents whose h = crc32(decimal doc_id) ends in 0 repeat their words from word a on with period p.
    A document without doc_id stays as it is."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, marks = batch.column("text"), batch.column("h").to_pylist()
            out = texts
            if any(h is not None and h % 10 == 0 for h in marks):
                changed = texts.to_pylist()
                for i, h in enumerate(marks):
                    words = (changed[i] or b"").split() if h is not None and h % 10 == 0 else []
                    if words:
                        n, g = len(words), h // 10
                        a = g % n
                        p = 1 + (n - a) // (3 + g % 8)
                        unit = words[a : a + p]
                        changed[i] = b" ".join(words[:a] + (unit * ((n - a) // p + 1))[: n - a])
                out = pa.array(changed, texts.type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return marked.mapInArrow(run, f"doc_id {kind}, text binary")


@query
def op12_baier_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find(with_repeats(table(spark, folder, "documents")))
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(
        x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int"))
    best = F.try_element_at(longest, F.lit(1))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), text.alias("lines"), best.alias("best"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    blocks = whitening.packed(table(spark, folder, "embeddings"))
    model = whitening.fit(blocks, wanted=32)
    if model is None:
        none = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], none)
    return whitening.whiten(blocks, model).withColumns({
        "n": F.lit(model.n).cast("bigint"), "identity_error": F.lit(whitening.identity_error(blocks, model))})
