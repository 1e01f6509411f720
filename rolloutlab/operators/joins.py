"""Join helpers shared by operators that join statistics back to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also pairs null keys (a null group is a group);
    the result keeps the left side's key columns."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def stand_in(dtype: T.DataType) -> Column:
    """Some value of the type, to stand where a key is null."""
    if isinstance(dtype, T.StructType):
        return F.struct(*(stand_in(f.dataType).alias(f.name) for f in dtype.fields))
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(dtype)
    return F.lit("" if isinstance(dtype, (T.StringType, T.BinaryType)) else 0).cast(dtype)


def plain_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with two more columns per key, never null: the key with a stand-in for null, and whether it is null.

    Grouping, windows and joins on these columns treat null as a group and all ask for the same partitioning, so one
    shuffle of a side serves them; a null-safe join shuffles by expressions of its own."""
    added = {}
    for i, k in enumerate(keys):
        added[f"_key{i}"] = F.coalesce(F.col(f"`{k}`"), stand_in(df.schema[k].dataType))
        added[f"_null{i}"] = F.col(f"`{k}`").isNull()
    return df.withColumns(added), list(added)


def with_statistics(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Every row with the aggregates of its group (null keys are a group): one partial aggregate and one join."""
    marked, plain = plain_keys(df, keys)
    return marked.join(marked.groupBy(*plain).agg(*aggregates), plain).drop(*plain)
