"""Result comparison and verify roll-up.

Vectors are ``array<double>`` columns; the per-row checks are higher-order
functions (row-local), the per-model roll-up is one ``groupBy`` with partial
aggregation, so a model with very many checks never gathers its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOL = 1e-2
RTOL = 1e-2
NON_NUMERIC_MSE = 1e9
N_CHECKS = 5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def element_close(x: Column, y: Column, atol: float = ATOL, rtol: float = RTOL) -> Column:
    """One element: ``|x-y| <= atol + rtol*|y|``; NaN never passes (Spark treats
    NaN = NaN and NaN as largest, so it is excluded explicitly); equal
    infinities pass."""
    finite_ok = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
    return ~F.isnan(x) & ~F.isnan(y) & ((x == y) | finite_ok)


def shape_ok(actual, expected, actual_dtype=None, expected_dtype=None) -> Column:
    """K2: same length (and dtype when given). Must be tested before K1, since
    ``zip_with`` pads the shorter side with nulls."""
    ok = F.size(_c(actual)) == F.size(_c(expected))
    if actual_dtype is not None and expected_dtype is not None:
        ok = ok & (_c(actual_dtype) == _c(expected_dtype))
    return F.coalesce(ok, F.lit(False))


def close(actual, expected, atol: float = ATOL, rtol: float = RTOL) -> Column:
    """K1: all elements close and shapes equal."""
    a, e = _c(actual), _c(expected)
    return shape_ok(a, e) & F.coalesce(
        F.forall(F.zip_with(a, e, lambda x, y: element_close(x, y, atol, rtol)), lambda b: b), F.lit(False))


def mse(actual, expected) -> Column:
    """A2: mean squared difference of two equal-length vectors; 1e9 when not comparable."""
    a, e = _c(actual), _c(expected)
    sq = F.aggregate(F.zip_with(a, e, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(shape_ok(a, e) & (F.size(a) > 0), sq / F.size(a)).otherwise(F.lit(NON_NUMERIC_MSE))


def mse_table(pairs: DataFrame, keys: list[str], actual: str = "actual", expected: str = "expected") -> DataFrame:
    """A2 over a long table of (keys, actual, expected) scalars: avg squared difference."""
    d = F.col(actual) - F.col(expected)
    return pairs.groupBy(*keys).agg(F.avg(d * d).alias("mse"))


def _flat(tensor: Column, dtype: T.DataType) -> Column:
    """The elements of an n-dimensional tensor in order."""
    while isinstance(dtype.elementType, T.ArrayType):
        tensor, dtype = F.flatten(tensor), dtype.elementType
    return tensor


def check_outcomes(checks: DataFrame, actual: str = "actual", expected: str = "expected",
                   atol: float = ATOL, rtol: float = RTOL, actual_dtype: str | None = None, expected_dtype: str | None = None) -> DataFrame:
    """Per check row: ``shape_ok``, ``passed`` and ``mse`` (only for shape-ok failures).

    Tensors of any number of dimensions need equal lengths at every level and, where the columns that name their element
    types are given, equal types (K2)."""
    dtype = checks.schema[expected].dataType
    ok = same_shape(F.col(actual), F.col(expected), dtype)
    if actual_dtype is not None and expected_dtype is not None:
        ok = ok & F.coalesce(F.col(actual_dtype) == F.col(expected_dtype), F.lit(False))
    a, e = _flat(F.col(actual), dtype), _flat(F.col(expected), dtype)
    return (checks.withColumn("shape_ok", ok).withColumn("passed", F.col("shape_ok") & close(a, e, atol, rtol))
            .withColumn("mse", F.when(F.col("shape_ok") & ~F.col("passed"), mse(a, e))))


def roll_up_checks(checks: DataFrame, key: str = "model_id", n: int = N_CHECKS,
                   actual: str = "actual", expected: str = "expected", actual_dtype: str | None = None,
                   expected_dtype: str | None = None) -> DataFrame:
    """A1: per model pass count, shape-ok count, verdict and avg MSE.

    Verdict: all ``n`` pass -> PASS; some pass -> PARTIAL_PASS; none pass but
    some shape-ok -> SHAPE_OK (avg MSE = summed failure MSE / shape-ok count);
    else FAIL. Missing check rows count as failed checks."""
    out = check_outcomes(checks, actual, expected, actual_dtype=actual_dtype, expected_dtype=expected_dtype)
    agg = out.groupBy(key).agg(
        F.count_if("passed").cast("long").alias("pass_count"),
        F.count_if("shape_ok").cast("long").alias("shape_ok_count"),
        F.coalesce(F.sum("mse"), F.lit(0.0)).alias("_total_mse"))
    verdict = (F.when(F.col("pass_count") == n, "PASS").when(F.col("pass_count") > 0, "PARTIAL_PASS")
               .when(F.col("shape_ok_count") > 0, "SHAPE_OK").otherwise("FAIL"))
    return (agg.withColumn("verdict", verdict)
            .withColumn("avg_mse", F.when(F.col("verdict") == "SHAPE_OK",
                                          F.col("_total_mse") / F.col("shape_ok_count")))
            .drop("_total_mse"))


def render_verify_log(pass_count="pass_count", shape_ok_count="shape_ok_count", avg_mse="avg_mse",
                      verdict="verdict", n: int = N_CHECKS) -> Column:
    """Summary line of a verify log for a roll-up row (input format of X10)."""
    p, s = _c(pass_count).cast("string"), _c(shape_ok_count).cast("string")
    v = _c(verdict)
    return (F.when(v == "PASS", F.lit("[PASS] verify success"))
            .when(v == "PARTIAL_PASS", F.concat(F.lit("[PARTIAL_PASS] "), p, F.lit(f"/{n} passed, "), s,
                                                F.lit(f"/{n} shape-correct")))
            .when(v == "SHAPE_OK", F.concat(F.lit("[SHAPE_OK] "), s, F.lit(f"/{n} shape-correct, AVG_MSE="),
                                            _c(avg_mse).cast("string")))
            .otherwise(F.lit("[FAIL] verify failed")))


# ------------------------------------------------------------------ nested values
def flatten_leaves(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, path, leaf) for every numeric leaf of a nested column (arrays by
    index, structs by field, maps by key). Schema-driven; only ``keys`` and the
    column are carried into the explode."""
    dtype = df.schema[col].dataType
    parts: list[DataFrame] = []

    def walk(frame: DataFrame, c: Column, path: Column, t: T.DataType):
        if isinstance(t, T.ArrayType):
            ex = frame.select(*keys, path.alias("_p"), F.posexplode_outer(c).alias("_i", "_v"))
            walk(ex, F.col("_v"), F.concat(F.col("_p"), F.lit("["), F.col("_i").cast("string"), F.lit("]")),
                 t.elementType)
        elif isinstance(t, T.MapType):
            ex = frame.select(*keys, path.alias("_p"), F.explode_outer(c).alias("_k", "_v"))
            walk(ex, F.col("_v"), F.concat(F.col("_p"), F.lit("{"), F.col("_k").cast("string"), F.lit("}")),
                 t.valueType)
        elif isinstance(t, T.StructType):
            for f in t.fields:
                walk(frame, c[f.name], F.concat(path, F.lit("." + f.name)), f.dataType)
        else:
            parts.append(frame.select(*keys, path.alias("path"), c.cast("double").alias("leaf")))

    walk(df, F.col(col), F.lit(col), dtype)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("path").isNotNull())


def pair_outputs(actual: DataFrame, expected: DataFrame, keys: list[str], extra_ok: bool = True) -> DataFrame:
    """Full outer join of two (keys, path, leaf) tables with a ``status`` column:
    ``matched``, ``missing`` (expected, not produced) or ``extra`` (produced, not
    expected; allowed when ``extra_ok``)."""
    a = actual.withColumnRenamed("leaf", "actual")
    e = expected.withColumnRenamed("leaf", "expected").withColumn("_e", F.lit(True))
    j = a.withColumn("_a", F.lit(True)).join(e, [*keys, "path"], "full_outer")
    status = (F.when(F.col("_a").isNotNull() & F.col("_e").isNotNull(), "matched")
              .when(F.col("_e").isNotNull(), "missing").otherwise("extra"))
    return (j.withColumn("status", status).withColumn("allowed", (F.col("status") != "extra") | F.lit(extra_ok))
            .drop("_a", "_e"))


def paired_leaves(actual: Column, expected: Column, dtype: T.DataType, in_actual: Column | None = None, in_expected: Column | None = None,
                  path: Column | None = None) -> Column:
    """J7 in the row: ``array<struct<path, status, actual, expected>>`` of the numeric leaves of two nested values.

    The pairing is compiled from the type: arrays pair by index, maps by key, structs by field; a leaf is ``matched``,
    ``missing`` (expected only) or ``extra`` (actual only). Nothing is exploded."""
    yes = F.lit(True)
    in_a, in_e = yes if in_actual is None else in_actual, yes if in_expected is None else in_expected
    path = F.lit("") if path is None else path
    if isinstance(dtype, T.ArrayType):
        na, ne = (F.when(there & c.isNotNull(), F.size(c)).otherwise(0) for there, c in ((in_a, actual), (in_e, expected)))
        longest = F.greatest(na, ne)
        places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, lambda i: paired_leaves(
            F.get(actual, i), F.get(expected, i), dtype.elementType, i < na, i < ne, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    if isinstance(dtype, T.MapType):
        ka, ke = (F.when(there & c.isNotNull(), F.map_keys(c)).otherwise(F.array().cast(T.ArrayType(dtype.keyType)))
                  for there, c in ((in_a, actual), (in_e, expected)))
        return F.flatten(F.transform(F.array_union(ka, ke), lambda k: paired_leaves(
            F.try_element_at(actual, k), F.try_element_at(expected, k), dtype.valueType, F.array_contains(ka, k), F.array_contains(ke, k),
            F.concat(path, F.lit("{"), k.cast("string"), F.lit("}")))))
    if isinstance(dtype, T.StructType):
        return F.concat(*(paired_leaves(actual[f.name], expected[f.name], f.dataType, in_a, in_e, F.concat(path, F.lit("." + f.name)))
                          for f in dtype.fields))
    status = F.when(in_a & in_e, "matched").when(in_e, "missing").otherwise("extra")
    return F.array(F.struct(path.alias("path"), status.alias("status"), actual.cast("double").alias("actual"), expected.cast("double").alias("expected")))


def _paired(actual: DataFrame, expected: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, leaves): one join on the keys, the leaves paired in its rows."""
    dtype = actual.schema[col].dataType
    a = actual.select(*keys, F.col(col).alias("_a"), F.lit(True).alias("_in_a"))
    e = expected.select(*keys, F.col(col).alias("_e"), F.lit(True).alias("_in_e"))
    there = lambda c: F.coalesce(c, F.lit(False))
    return a.join(e, keys, "full_outer").select(*keys, paired_leaves(
        F.col("_a"), F.col("_e"), dtype, there("_in_a"), there("_in_e"), F.lit(col)).alias("leaves")).where(F.size("leaves") > 0)


def pair_nested(actual: DataFrame, expected: DataFrame, keys: list[str], col: str, extra_ok: bool = True) -> DataFrame:
    """J7 of a nested column: (keys, path, status, actual, expected, allowed), one row per leaf; only keys are shuffled."""
    return (_paired(actual, expected, keys, col).select(*keys, F.inline("leaves"))
            .withColumn("allowed", (F.col("status") != "extra") | F.lit(extra_ok)))


def compare_nested(actual: DataFrame, expected: DataFrame, keys: list[str], col: str,
                   atol: float = ATOL, rtol: float = RTOL, extra_ok: bool = False) -> DataFrame:
    """K3: per key, counts of matched/missing/extra/close leaves and ``ok``:
    no missing leaf, no disallowed extra, every matched leaf close. One row of
    either side per key."""
    def count(wanted: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("leaves", wanted)).cast("long")

    n = _paired(actual, expected, keys, col).select(
        *keys, count(lambda x: x["status"] == "matched").alias("n_matched"), count(lambda x: x["status"] == "missing").alias("n_missing"),
        count(lambda x: x["status"] == "extra").alias("n_extra"),
        count(lambda x: (x["status"] == "matched") & element_close(x["actual"], x["expected"], atol, rtol)).alias("n_close"))
    return n.withColumn("ok", (F.col("n_missing") == 0) & (F.lit(extra_ok) | (F.col("n_extra") == 0)) & (F.col("n_close") == F.col("n_matched")))


def _is_tensor(t: T.DataType) -> bool:
    """Arrays (of arrays) of numbers are tensors; any other array is a list."""
    return isinstance(t, T.ArrayType) and (isinstance(t.elementType, T.NumericType) or _is_tensor(t.elementType))


def same_shape(actual: Column, expected: Column, dtype: T.DataType) -> Column:
    """K2 for tensors of any number of dimensions: equal lengths at every level."""
    ok = F.size(actual) == F.size(expected)
    inner = dtype.elementType
    if isinstance(inner, T.ArrayType):
        ok = ok & F.forall(F.zip_with(actual, expected, lambda x, y: same_shape(x, y, inner)), lambda b: b)
    return F.coalesce(ok, F.lit(False))


def equal_by_rule(actual: Column, expected: Column, actual_type: T.DataType, expected_type: T.DataType | None = None,
                  atol: float = ATOL, rtol: float = RTOL) -> Column:
    """K3 in the row, by type: tensors need the same shape and close elements; lists
    the same length and equal items; every expected map key must be there (others
    may be too); struct fields, strings and single numbers are compared exactly.
    Two nulls are equal, a null and a value are not. Different types are an
    error while the plan is built."""
    expected_type = expected_type or actual_type
    if actual_type.simpleString() != expected_type.simpleString():
        raise TypeError(f"cannot compare {actual_type.simpleString()} with {expected_type.simpleString()}")

    def rule(a: Column, e: Column, t: T.DataType, tensor: bool) -> Column:
        if isinstance(t, T.ArrayType):
            inner = tensor or _is_tensor(t)
            ok = (F.size(a) == F.size(e)) & F.forall(F.zip_with(a, e, lambda x, y: rule(x, y, t.elementType, inner)), lambda b: b)
        elif isinstance(t, T.MapType):
            ok = F.forall(F.map_keys(e), lambda k: F.map_contains_key(a, k) & rule(
                F.try_element_at(a, k), F.try_element_at(e, k), t.valueType, False))
        elif isinstance(t, T.StructType):
            ok = F.lit(True)
            for f in t.fields:
                ok = ok & rule(a[f.name], e[f.name], f.dataType, False)
        elif tensor:
            ok = element_close(a.cast("double"), e.cast("double"), atol, rtol)
        else:
            ok = a == e
        return F.when(a.isNull() | e.isNull(), a.isNull() & e.isNull()).otherwise(F.coalesce(ok, F.lit(False)))

    return rule(actual, expected, actual_type, False)


def map_leaves(col: Column, dtype: T.DataType, fn: Callable[[Column], Column]) -> Column:
    """K4: apply ``fn`` to every numeric leaf of a nested column, keeping its shape
    (``transform`` for arrays, ``transform_values`` for maps, ``struct`` rebuild)."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: map_leaves(x, dtype.elementType, fn))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: map_leaves(v, dtype.valueType, fn))
    if isinstance(dtype, T.StructType):
        return F.struct(*[map_leaves(col[f.name], f.dataType, fn).alias(f.name) for f in dtype.fields])
    if isinstance(dtype, T.NumericType):
        return fn(col)
    return col
