"""Small dimension tables: operator-name dictionaries, snippet texts, the
curriculum phase of each snippet key and the scalar type map.

All of them are bounded, fixed-size tables (at most a few hundred rows), which
is what makes broadcasting them, or embedding them as literals in a column
expression, safe at any data scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES. Operator name -> snippet key, in dictionary order. The order is
# meaningful: the fuzzy match (J2) picks the first entry that matches.
# Architecture "gfx1201" (93 entries).
# ---------------------------------------------------------------------------
OP_DICT_GFX1201: list[tuple[str, str]] = [
    ("relu", "_act_relu"), ("torch.relu", "_act_relu"), ("F.relu", "_act_relu"), ("nn.ReLU", "_act_relu"),
    ("elu", "_act_elu"), ("torch.elu", "_act_elu"), ("F.elu", "_act_elu"), ("nn.ELU", "_act_elu"),
    ("sigmoid", "_act_sigmoid"), ("torch.sigmoid", "_act_sigmoid"), ("F.sigmoid", "_act_sigmoid"),
    ("nn.Sigmoid", "_act_sigmoid"),
    ("silu", "_act_silu"), ("torch.silu", "_act_silu"), ("F.silu", "_act_silu"), ("nn.SiLU", "_act_silu"),
    ("gelu", "_act_gelu"), ("torch.gelu", "_act_gelu"), ("F.gelu", "_act_gelu"), ("nn.GELU", "_act_gelu"),
    ("tanh", "_act_tanh"), ("torch.tanh", "_act_tanh"), ("F.tanh", "_act_tanh"), ("nn.Tanh", "_act_tanh"),
    ("torch.abs", "_act_abs"), ("torch.neg", "_act_neg"),
    ("torch.exp", "_act_exp"), ("torch.log", "_act_log"),
    ("nn.BatchNorm1d", "_batchnorm"), ("nn.BatchNorm2d", "_batchnorm"), ("nn.BatchNorm3d", "_batchnorm"),
    ("batch_norm", "_batchnorm"), ("F.batch_norm", "_batchnorm"),
    ("nn.LayerNorm", "_layernorm"), ("layer_norm", "_layernorm"), ("F.layer_norm", "_layernorm"),
    ("nn.GroupNorm", "_groupnorm"), ("F.group_norm", "_groupnorm"),
    ("nn.RMSNorm", "_rmsnorm"),
    ("F.softmax", "_softmax"), ("nn.Softmax", "_softmax"), ("torch.softmax", "_softmax"),
    ("F.log_softmax", "_softmax"), ("nn.LogSoftmax", "_softmax"),
    ("nn.Linear", "_gemm"), ("F.linear", "_gemm"), ("torch.mm", "_gemm"), ("torch.matmul", "_gemm"),
    ("torch.bmm", "_gemm"), ("torch.addmm", "_gemm"),
    ("nn.Conv1d", "_conv"), ("nn.Conv2d", "_conv"), ("nn.Conv3d", "_conv"),
    ("F.conv1d", "_conv"), ("F.conv2d", "_conv"), ("F.conv3d", "_conv"),
    ("nn.ConvTranspose1d", "_conv"), ("nn.ConvTranspose2d", "_conv"),
    ("torch.sum", "_reduce"), ("torch.mean", "_reduce"), ("torch.max", "_reduce"),
    ("torch.min", "_reduce"), ("torch.prod", "_reduce"),
    ("nn.MaxPool2d", "_pool"), ("F.max_pool2d", "_pool"),
    ("nn.AvgPool2d", "_pool"), ("F.avg_pool2d", "_pool"),
    ("nn.AdaptiveAvgPool2d", "_pool"), ("F.adaptive_avg_pool2d", "_pool"),
    ("nn.AdaptiveMaxPool2d", "_pool"),
    ("torch.add", "_bin_add"), ("add", "_bin_add"),
    ("torch.mul", "_bin_multiply"), ("mul", "_bin_multiply"), ("torch.multiply", "_bin_multiply"),
    ("torch.sub", "_bin_subtract"), ("sub", "_bin_subtract"),
    ("torch.clamp", "_clamp"), ("torch.clip", "_clamp"), ("F.hardtanh", "_clamp"),
    ("torch.where", "_where"),
    ("torch.pow", "_pow"), ("torch.square", "_pow"),
    ("torch.reciprocal", "_reciprocal"),
    ("torch.sign", "_sign"),
    ("F.leaky_relu", "_act_leaky_relu"), ("nn.LeakyReLU", "_act_leaky_relu"),
    ("F.hardswish", "_act_hardswish"), ("nn.Hardswish", "_act_hardswish"),
    ("F.hardsigmoid", "_act_hardsigmoid"), ("nn.Hardsigmoid", "_act_hardsigmoid"),
    ("F.mish", "_act_mish"), ("nn.Mish", "_act_mish"),
]

# FIXED VALUES. Architecture "gfx1100" (63 entries), in dictionary order.
OP_DICT_GFX1100: list[tuple[str, str]] = [
    ("relu", "_relu"), ("torch.relu", "_relu"), ("F.relu", "_relu"), ("nn.ReLU", "_relu"),
    ("elu", "_elu"), ("torch.elu", "_elu"), ("F.elu", "_elu"), ("nn.ELU", "_elu"),
    ("sigmoid", "_sigmoid"), ("torch.sigmoid", "_sigmoid"), ("F.sigmoid", "_sigmoid"), ("nn.Sigmoid", "_sigmoid"),
    ("silu", "_silu"), ("torch.silu", "_silu"), ("F.silu", "_silu"), ("nn.SiLU", "_silu"),
    ("gelu", "_gelu"), ("torch.gelu", "_gelu"), ("F.gelu", "_gelu"), ("nn.GELU", "_gelu"),
    ("tanh", "_tanh"), ("torch.tanh", "_tanh"), ("F.tanh", "_tanh"), ("nn.Tanh", "_tanh"),
    ("torch.abs", "_abs"), ("torch.neg", "_neg"),
    ("torch.exp", "_exp"), ("torch.log", "_log"),
    ("nn.BatchNorm1d", "_layernorm"), ("nn.BatchNorm2d", "_layernorm"), ("nn.BatchNorm3d", "_layernorm"),
    ("batch_norm", "_layernorm"), ("F.batch_norm", "_layernorm"),
    ("nn.LayerNorm", "_layernorm"), ("layer_norm", "_layernorm"), ("F.layer_norm", "_layernorm"),
    ("nn.GroupNorm", "_layernorm"), ("F.group_norm", "_layernorm"),
    ("nn.RMSNorm", "_rmsnorm"),
    ("F.softmax", "_softmax"), ("nn.Softmax", "_softmax"), ("torch.softmax", "_softmax"),
    ("F.log_softmax", "_softmax"), ("nn.LogSoftmax", "_softmax"),
    ("nn.Linear", "_linear"), ("F.linear", "_linear"), ("torch.mm", "_linear"), ("torch.matmul", "_linear"),
    ("torch.bmm", "_linear"), ("torch.addmm", "_linear"),
    ("nn.Conv1d", "_linear"), ("nn.Conv2d", "_linear"), ("nn.Conv3d", "_linear"),
    ("F.conv1d", "_linear"), ("F.conv2d", "_linear"), ("F.conv3d", "_linear"),
    ("nn.ConvTranspose1d", "_linear"), ("nn.ConvTranspose2d", "_linear"),
    ("torch.clamp", "_clamp"), ("torch.clip", "_clamp"), ("F.hardtanh", "_clamp"),
    ("torch.sum", "_reduce"), ("torch.mean", "_reduce"),
]

OP_DICTS = {"gfx1201": OP_DICT_GFX1201, "gfx1100": OP_DICT_GFX1100}

# Per-architecture defaults of the reference-text job (J4): separator between
# snippets and whether a key without a snippet is skipped.
ARCH_JOIN = {"gfx1201": ("\n\n", True), "gfx1100": ("\n", False)}

# Our own snippet texts: a short numeric definition per snippet key. These are
# prompt content, not executable code; the numerics live in functions/vectors.py.
_DEFINITIONS = {
    "relu": "y = x > 0 ? x : 0",
    "elu": "y = x > 0 ? x : exp(x) - 1",
    "sigmoid": "y = 1 / (1 + exp(-x))",
    "silu": "y = x / (1 + exp(-x))",
    "gelu": "y = 0.5 * x * (1 + erf(x / sqrt(2)))",
    "tanh": "y = tanh(x)",
    "abs": "y = |x|",
    "neg": "y = -x",
    "exp": "y = exp(x)",
    "log": "y = log(x)",
    "batchnorm": "y = scale * (x - mean_c) / sqrt(var_c + eps) + bias, statistics per channel",
    "layernorm": "y = (x - mean) / sqrt(var + eps), statistics per row",
    "groupnorm": "y = (x - mean_g) / sqrt(var_g + eps), statistics per channel group",
    "rmsnorm": "y = x / sqrt(mean(x * x) + eps)",
    "softmax": "y = exp(x - max) / sum(exp(x - max))",
    "reduce": "y = sum(x) (mean, max, min, prod alike)",
    "gemm": "C[i][j] = sum_k A[i][k] * B[k][j]",
    "linear": "y[i][j] = sum_k x[i][k] * w[k][j] + b[j]",
    "conv": "y[c_out][p] = sum_c_in w[c_out][c_in] * x[c_in][p]",
    "pool": "y[b] = max (or mean) of x over block b",
    "add": "y = a + b",
    "subtract": "y = a - b",
    "multiply": "y = a * b",
    "clamp": "y = min(max(x, lo), hi)",
    "where": "y = cond ? a : b",
    "pow": "y = pow(x, p)",
    "reciprocal": "y = 1 / x",
    "sign": "y = (x > 0) - (x < 0)",
    "leaky_relu": "y = x > 0 ? x : alpha * x",
    "hardswish": "y = x * min(max(x + 3, 0), 6) / 6",
    "hardsigmoid": "y = min(max(x / 6 + 0.5, 0), 1)",
    "mish": "y = x * tanh(log(1 + exp(x)))",
}


def _definition_name(key: str) -> str:
    return key.removeprefix("_").removeprefix("act_").removeprefix("bin_")


def snippet_rows(arch: str = "gfx1201") -> list[tuple[str, str]]:
    """(key, snippet) for every key of the architecture's dictionary, in first-use order."""
    seen: list[str] = []
    for _, key in OP_DICTS[arch]:
        if key not in seen:
            seen.append(key)
    return [(k, f"// {_definition_name(k)}\n// {_DEFINITIONS[_definition_name(k)]}") for k in seen]


# Curriculum phase of a snippet key (D3): 1 element-wise, 2 reduction or
# normalisation, 3 convolution or matrix product.
_PHASE_BY_NAME = {
    "batchnorm": 2, "layernorm": 2, "groupnorm": 2, "rmsnorm": 2, "softmax": 2, "reduce": 2, "pool": 2,
    "gemm": 3, "linear": 3, "conv": 3,
}


def phase_of(key: str) -> int:
    return _PHASE_BY_NAME.get(_definition_name(key), 1)


# FIXED VALUES. Scalar parameter types of a kernel launcher and their host type.
SCALAR_TYPE_MAP: list[tuple[str, str]] = [
    ("float", "float"),
    ("double", "double"),
    ("int", "int64_t"),
    ("int32_t", "int64_t"),
    ("int64_t", "int64_t"),
    ("bool", "bool"),
    ("unsigned int", "int64_t"),
    ("size_t", "int64_t"),
]

DICT_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("map_op", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
])
SNIPPET_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("snippet", T.StringType(), False),
])


def op_dictionary(spark: SparkSession, arch: str = "gfx1201") -> DataFrame:
    """The ordered op dictionary as a small DataFrame ``(ord, map_op, key)``."""
    rows = [(i, op, key) for i, (op, key) in enumerate(OP_DICTS[arch])]
    return spark.createDataFrame(rows, DICT_SCHEMA)


def snippet_table(spark: SparkSession, arch: str = "gfx1201") -> DataFrame:
    return spark.createDataFrame(snippet_rows(arch), SNIPPET_SCHEMA)


def phase_table(spark: SparkSession, arch: str = "gfx1201") -> DataFrame:
    rows = [(k, phase_of(k)) for k, _ in snippet_rows(arch)]
    return spark.createDataFrame(rows, "key string, phase int")


def type_map_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCALAR_TYPE_MAP, "ctype string, host_type string")


def sql_values(rows: list[tuple], columns: list[str]) -> str:
    """Render rows as a SQL ``(VALUES ...) AS t(cols)`` fragment for the oracle."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ",\n    ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n    {body}) AS t({', '.join(columns)})"


# ---------------------------------------------------------------- literal tables in expressions
def sql_str(v: str) -> str:
    """A Spark SQL string literal (backslash escapes)."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def lit_map(pairs) -> Column:
    """A literal ``map`` built from one SQL expression (one driver call, not one
    per entry), for small fixed tables embedded in a plan."""
    body = ", ".join(f"{sql_str(k)}, {v if isinstance(v, int) else sql_str(v)}" for k, v in pairs)
    return F.expr(f"map({body})")


def lit_struct_array(rows, fields: tuple[str, ...]) -> Column:
    """A literal ``array<struct<fields>>`` built from one SQL expression."""
    items = ", ".join("named_struct(" + ", ".join(f"'{f}', {sql_str(v)}" for f, v in zip(fields, r)) + ")"
                      for r in rows)
    return F.expr(f"array({items})")
