from pyspark.sql import functions as F

from hourloom.streaming import revisions as sr

SCHEMA = "id string, rev bigint, n int"


def stream(spark, tmp_path, batches, monkeypatch=None, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sr.newest_revisions(feed, "id", "rev", **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option(
        "path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def test_outdated_rows_go_where_keys_share_a_slot(spark, tmp_path):
    batches = [
        [("a", 2, 1), ("a", 2, 2), ("a", 1, 3), ("b", 5, 4), (None, 1, 5), ("", 9, 6), ("c", None, 7)],
        [("a", 1, 8), ("a", 3, 9), ("b", 5, 10), ("b", 4, 11), (None, 0, 12), (None, 2, 13), ("", 8, 14), ("c", 1, 15)],
        [("a", 2, 16), ("d", 0, 17), ("c", 0, 18), ("c", None, 19)]]
    got = stream(spark, tmp_path, batches, slots=1)
    assert {r[2] for r in got} == {1, 2, 4, 5, 6, 7, 9, 10, 13, 15, 17, 19} and len(got) == 12
    assert {r[2]: (r[0], r[1]) for r in got}[13] == (None, 2)


def test_many_keys_take_few_calls(spark, tmp_path):
    """40,000 keys in two batches: one state row a key took one call a key."""
    import time

    rows = spark.range(80_000).select((F.col("id") % 40_000).cast("string").alias("id"), F.floor(F.col("id") / 40_000).alias("rev"), F.lit(1).alias("n"))
    for rev in (1, 0):
        rows.where(F.col("rev") == rev).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t0 = time.time()
    got = stream(spark, tmp_path, [])
    assert len(got) == 40_000 and {r[1] for r in got} == {1}
    assert time.time() - t0 < 60
