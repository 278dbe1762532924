"""Sinks: tables and reports, resumable appends, snapshot replacement."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.session import ensure_checkpoint_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, visible to every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def made_once(df: DataFrame) -> DataFrame:
    """Write a frame that is read several times to a scratch folder and read it from there. Its shuffle files are deleted with the end of the write."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def write_tables(tables: dict[str, tuple[DataFrame, str]], folder: str) -> dict[str, str]:
    """Write each named frame in its format (parquet, csv, json); returns where they are."""
    paths = {}
    for name, (df, fmt) in tables.items():
        paths[name] = f"{folder}/{name}"
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        writer.save(paths[name])
    return paths


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def resume_append(todo: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the sink does not hold yet, one row for each key; running it again adds nothing. NULL is a key value like others."""
    done = read_or_empty(todo.sparkSession, path, todo.schema).select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    todo.dropDuplicates(keys).join(done, same, "left_anti").write.mode("append").parquet(path)


def replace_snapshot(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replace the whole snapshot, or (with `partition`) exactly the partitions present in `df`."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition)
    writer.parquet(path)
