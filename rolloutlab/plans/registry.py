"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where plain SQL can express it, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloutlab.plans.float_columns import FLOAT_COLUMNS

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
RAW_QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATOR_IDS: dict[str, list[str]] = {}
DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every top-level double column (and fold -0.0 into 0.0)."""
    cols = [(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def round_sql(sql: str, columns: list[str], digits: int = DIGITS) -> str:
    """The same rounding applied to an oracle query's output."""
    if not columns:
        return sql
    repl = ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in columns)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS q"


def _rounded(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(spark, sf_dir))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def register(name: str, ids: list[str], sql: str | None = None):
    """Register a query under ``name``, covering SURVEY operator ``ids``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        RAW_QUERIES[name] = fn
        QUERIES[name] = _rounded(fn)
        OPERATOR_IDS[name] = ids
        if sql is not None:
            ORACLES[name] = round_sql(sql, FLOAT_COLUMNS.get(name, []))
        return fn
    return deco
