"""Binds operator keys to the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register `fn(spark, folder)` under `key`; its result is put into the comparable form of `comparable`."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return comparable(fn(spark, folder), digits or {})

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return fn

    return wrap


def comparable(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Plain scalars that two engines print alike: instants and dates as text, flags as 0/1, rounded doubles."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            unit = float(10 ** digits.get(f.name, 6))
            c = F.floor(c.cast("double") * F.lit(unit) + F.lit(0.5003)) / F.lit(unit)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ";")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- the same forms in SQL text
def r(x: str, digits: int = 6) -> str:
    unit = f"1e{digits}"
    return f"(floor(({x}) * {unit} + 0.5003) / {unit})"


def t(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def d(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def b(x: str) -> str:
    return f"CAST(({x}) AS INTEGER)"
