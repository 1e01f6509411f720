"""Prompt rendering (P2-P5, P8, P9) and the system-text source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.functions.text import is_float_dtype, strip

# FIXED VALUES: user-message and weight-section formats.
INSTRUCTION = "Optimize this model with HIP kernels for {arch}. Output exactly 1 file.\n\n"
# The reference section header is a parameter; this is our default wording.
REF_HEADER = "Reference HIP kernels:"
WEIGHT_HEADER = ("\nWeight tensors (add as `const float*` params between `int size` and "
                 "`hipStream_t stream`):\n")
WEIGHT_LINE = "  - const float* {name}  shape=({shape})"
MAX_WEIGHT_TENSORS = 10
TOOL_NAME = "hip_kernel"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render_user_message(code, ref_text=None, weight_info=None, arch: str = "gfx1201",
                        ref_header: str = REF_HEADER) -> Column:
    """Instruction + fenced stripped code + optional snippet section + optional
    weight section."""
    ref = F.coalesce(_c(ref_text), F.lit("")) if ref_text is not None else F.lit("")
    weights = F.coalesce(_c(weight_info), F.lit("")) if weight_info is not None else F.lit("")
    ref_section = F.when(ref != "", F.concat(F.lit(f"\n\n{ref_header}\n```cpp\n"), ref, F.lit("\n```"))) \
        .otherwise(F.lit(""))
    return F.concat(F.lit(INSTRUCTION.format(arch=arch) + "```python\n"), strip(code), F.lit("\n```"),
                    ref_section, weights)


def assemble_chat(system, user) -> Column:
    """``array<struct<role,content>>`` of the system and user messages."""
    return F.array(F.struct(F.lit("system").alias("role"), _c(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), _c(user).alias("content")))


def pack_metadata(code, ops, data_source, name: str = TOOL_NAME) -> Column:
    """Compact JSON object; ``ops`` is re-encoded as JSON text inside it."""
    return F.to_json(F.struct(F.lit(name).alias("name"), _c(code).alias("model_code"),
                              F.to_json(_c(ops)).alias("ops"), _c(data_source).alias("data_source")))


def render_weight_spec(tensors: DataFrame, model_col: str = "model_id",
                       max_tensors: int = MAX_WEIGHT_TENSORS) -> DataFrame:
    """P5: (model, n_float, weight_info) of every model. Floating tensors only, in
    ``ord`` order; more than ``max_tensors`` (or none) gives ''.

    Counting happens first as a partial aggregation; only models at or under
    the limit are gathered, so no group collects more than ``max_tensors`` rows
    whatever the skew."""
    floats = tensors.where(is_float_dtype("dtype")).select(model_col, "ord", "name", "shape")
    counts = tensors.groupBy(model_col).agg(F.count_if(is_float_dtype("dtype")).alias("n_float"))
    small = counts.where(F.col("n_float") <= max_tensors)
    lines = (floats.join(small.select(model_col), model_col, "left_semi")
             .groupBy(model_col)
             .agg(F.sort_array(F.collect_list(F.struct(
                 "ord", F.regexp_replace("name", r"\.", "_").alias("c_name"),
                 F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape_s"))))
                 .alias("items")))
    text = F.concat(F.lit(WEIGHT_HEADER),
                    F.array_join(F.transform("items", lambda t: F.concat(
                        F.lit("  - const float* "), t["c_name"], F.lit("  shape=("), t["shape_s"], F.lit(")"))),
                        "\n"),
                    F.lit("\n"))
    return (counts.join(lines, model_col, "left")
            .select(model_col, F.col("n_float").cast("long").alias("n_float"),
                    F.when(F.col("items").isNull(), F.lit("")).otherwise(text).alias("weight_info")))


# FIXED VALUES: the feedback format.
def format_feedback(eager, compiled, candidate, reward) -> Column:
    """Profile feedback text. Rendered numbers follow Java rounding (T4):
    compare the numeric columns, not this text, across engines."""
    b, c, h = _c(eager), _c(compiled), _c(candidate)
    return F.format_string(
        "Torch Baseline: %.3fus, Torch Compile: %.3fus, HIP Extension: %.3fus | "
        "Speedup: %.2fx eager, %.2fx compile | Reward: %+.0f", b, c, h, b / h, c / h, _c(reward))


def next_turn_prompt(messages, feedback) -> Column:
    """Append the feedback as a new user message."""
    return F.array_append(_c(messages), F.struct(F.lit("user").alias("role"), _c(feedback).alias("content")))


def attach_text(df: DataFrame, spark: SparkSession, path: str, col_name: str = "system_text") -> DataFrame:
    """One whole text file as a column on every row.

    The file is read by Spark (``wholetext``) as a scalar subquery: nothing runs
    while the plan is built, no join is needed, and more than one file is an
    error."""
    return df.withColumn(col_name, spark.read.text(path, wholetext=True).select("value").scalar())
