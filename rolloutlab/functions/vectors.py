"""Element-wise numerics (V1-V24) and per-vector normalisations.

Each element function maps a ``Column`` to a ``Column`` and is applied to a
vector column with ``transform`` (or to a scalar column directly) through
``map_column``; everything stays a built-in expression (JVM, no Python per
row). NaN rules follow the numeric definition: a ternary ``x > 0 ? a : b`` sends
NaN to ``b`` (Spark orders NaN above every number, so NaN is tested first).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fn = Callable[[Column], Column]
INF = float("inf")

# FIXED VALUES: Abramowitz & Stegun 7.1.26 rational approximation of erf
# (|error| < 1.5e-7); p, then a1..a5.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _pos(x: Column) -> Column:
    """``x > 0`` as a C ternary sees it (NaN is not positive)."""
    return (x > 0) & ~F.isnan(x)


def erf(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = t * (F.lit(ERF_A[0]) + t * (F.lit(ERF_A[1]) + t * (F.lit(ERF_A[2]) + t * (F.lit(ERF_A[3])
                                                                                     + t * F.lit(ERF_A[4])))))
    y = F.lit(1.0) - poly * F.exp(-z * z)
    return F.when(x < 0, -y).otherwise(y)


def relu(x): return F.when(_pos(x), x).otherwise(F.lit(0.0))                                      # V1
def gelu(x): return F.lit(0.5) * x * (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0))))                # V2
def silu(x): return x / (F.lit(1.0) + F.exp(-x))                                                  # V3
def sigmoid(x): return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))                                      # V4
def tanh(x): return F.tanh(x)                                                                     # V5
def elu(x): return F.when(_pos(x), x).otherwise(F.exp(x) - F.lit(1.0))                            # V6
def exp(x): return F.exp(x)                                                                       # V7


def log(x):                                                                                       # V8
    """ln x; 0 -> -inf and negative -> NaN as in C (Spark's ``ln`` gives null)."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(float("nan")))


def abs_(x): return F.abs(x)                                                                      # V9
def neg(x): return -x                                                                             # V10
def clamp(lo: float = -1.0, hi: float = 1.0) -> Fn:                                               # V11
    return lambda x: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def where(cond: Fn, other: Fn) -> Fn:                                                             # V12
    """``cond(x) ? x : other(x)``; a null condition takes ``other``."""
    return lambda x: F.when(F.coalesce(cond(x), F.lit(False)), x).otherwise(other(x))


def pow_(p: float = 2.0) -> Fn: return lambda x: F.pow(x, F.lit(p))                               # V13
def square(x): return x * x                                                                       # V13


def reciprocal(x):                                                                                # V14
    """1/x with 1/0.0 = +inf and 1/-0.0 = -inf (ANSI division would raise)."""
    at_zero = F.when(x.cast("string").startswith("-"), F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(x == 0, at_zero).otherwise(F.lit(1.0) / x)


def sign(x):                                                                                      # V15
    return F.when(_pos(x), F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def leaky_relu(alpha: float = 0.01) -> Fn:                                                        # V16
    return lambda x: F.when(_pos(x), x).otherwise(F.lit(alpha) * x)


def hardswish(x): return x * F.least(F.greatest(x + F.lit(3.0), F.lit(0.0)), F.lit(6.0)) / F.lit(6.0)   # V17
def hardsigmoid(x): return F.least(F.greatest(x / F.lit(6.0) + F.lit(0.5), F.lit(0.0)), F.lit(1.0))    # V18


def mish(x):                                                                                      # V19
    """x * tanh(softplus(x)); softplus(x) = x above 20 (no exp overflow)."""
    sp = F.when(x > 20, x).otherwise(F.ln(F.lit(1.0) + F.exp(x)))
    return x * F.tanh(sp)


def affine(scale: float = 0.5, shift: float = 0.1) -> Fn:                                        # V24
    return lambda x: x * F.lit(scale) + F.lit(shift)


UNARY: dict[str, Fn] = {
    "relu": relu, "gelu": gelu, "silu": silu, "sigmoid": sigmoid, "tanh": tanh, "elu": elu, "exp": exp,
    "log": log, "abs": abs_, "neg": neg, "clamp": clamp(), "where": where(lambda x: x > 0, lambda x: x * 0.5),
    "pow": pow_(3.0), "square": square, "reciprocal": reciprocal, "sign": sign, "leaky_relu": leaky_relu(),
    "hardswish": hardswish, "hardsigmoid": hardsigmoid, "mish": mish, "affine": affine(),
}


# Binary element-wise (V20-V23): (a, b) -> Column
def add(a, b): return a + b
def subtract(a, b): return a - b
def multiply(a, b): return a * b
def axpy(alpha: float = 2.0): return lambda a, b: F.lit(alpha) * a + b


BINARY = {"add": add, "subtract": subtract, "multiply": multiply, "axpy": axpy()}


def map_column(df: DataFrame, col: str, fn: Fn, out: str | None = None) -> DataFrame:
    """Apply an element function to a column: ``transform`` for an array
    column, the expression itself for a scalar column."""
    dt = df.schema[col].dataType
    expr = F.transform(col, fn) if isinstance(dt, T.ArrayType) else fn(F.col(col))
    return df.withColumn(out or col, expr)


def zip_columns(a, b, fn) -> Column:
    """Binary element function over two equal-length vector columns."""
    return F.zip_with(a, b, fn)


# ---------------------------------------------------------------- per-vector reductions
def _agg(arr: Column, zero: Column, op) -> Column:
    return F.aggregate(arr, zero, op)


def vec_sum(a): return _agg(a, F.lit(0.0), lambda s, x: s + x)
def vec_mean(a): return vec_sum(a) / F.size(a)
def vec_max(a): return F.array_max(a)
def vec_min(a): return F.array_min(a)
def vec_prod(a): return _agg(a, F.lit(1.0), lambda s, x: s * x)


REDUCE = {"sum": vec_sum, "mean": vec_mean, "max": vec_max, "min": vec_min, "prod": vec_prod}


def reduce_vector(a, kind: str = "sum") -> Column:
    """N1 (row form): reduce each vector to one number."""
    return REDUCE[kind](a)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    Expressions referenced inside a ``transform`` lambda are re-evaluated for
    every element; binding a per-vector statistic through a one-element array
    keeps a normalisation linear in the vector length."""
    return F.get(F.transform(F.array(value), body), 0)


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps), per vector, no affine."""
    return let(vec_mean(a), lambda m: let(
        _agg(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a),
        lambda var: F.transform(a, lambda x: (x - m) / F.sqrt(var + F.lit(eps)))))


def rms_norm(a: Column, eps: float = 1e-5, gamma: Column | None = None) -> Column:
    """X / sqrt(mean(x^2) + eps), optional per-element gamma."""
    y = let(_agg(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a),
            lambda ms: F.transform(a, lambda x: x / F.sqrt(ms + F.lit(eps))))
    return y if gamma is None else F.zip_with(y, gamma, lambda u, g: u * g)


def _softmax_parts(a: Column, body) -> Column:
    return let(F.array_max(a), lambda mx: let(
        _agg(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)), lambda s: body(mx, s)))


def softmax(a: Column) -> Column:
    """exp(x - max) / sum(exp(x - max)), per vector."""
    return _softmax_parts(a, lambda mx, s: F.transform(a, lambda x: F.exp(x - mx) / s))


def log_softmax(a: Column) -> Column:
    """X - max - log(sum(exp(x - max)))."""
    return _softmax_parts(a, lambda mx, s: F.transform(a, lambda x: x - mx - F.ln(s)))


def group_norm(a: Column, groups: int, eps: float = 1e-5) -> Column:
    """Layer norm inside each of ``groups`` contiguous feature groups of a
    vector. A length that ``groups`` does not divide is an error, as no group
    could take the rest. Row-local: no explode."""
    g = F.size(a) / F.lit(groups)

    def norm_group(j: Column) -> Column:
        return let(F.slice(a, (j * g + 1).cast("int"), g.cast("int")), lambda part: layer_norm(part, eps))
    normed = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), norm_group))
    return F.when(F.size(a) % F.lit(groups) == 0, normed).otherwise(
        F.raise_error(F.lit(f"vector length is not a multiple of {groups} groups")).cast("array<double>"))
