"""Views that turn the driver tables into the shapes the operators consume.

Each view exists twice: a Spark builder and the equivalent DuckDB CTE used by
the SQL oracle. Every view keeps all rows of its source table (no id subsets,
no sampling) and uses whole texts, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.operators.sampling import ranked_within
from rolloutlab.sources.tables import read_table

# FIXED VALUES: the pool of operator names the sample view draws from. Covers
# exact hits, two names for one key, fuzzy hits both ways, case, and a miss.
OP_POOL = ["nn.ReLU", "torch.relu", "F.gelu", "nn.BatchNorm2d", "nn.LayerNorm", "nn.Conv2d",
           "torch.sum", "nn.Softmax", "F.softmax", "torch.clamp", "nn.relu6", "LAYER_NORM_v2",
           "torch.fft", "custom.tanh", "nn.Linear", "norm"]

HEADER = "**kernels/fused_kernel.hip**"
STOP = "<END_OF_OUTPUT>"
KERNEL_OPEN = "__global__ void fused_kernel(float* out) {\n// "


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _nl(sql_text: str) -> str:
    """Python text -> DuckDB string expression (newlines via chr(10))."""
    parts = sql_text.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


# --------------------------------------------------------------------------- samples
def v_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, code, data_source, ops array, ops_raw text) from ``documents``."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    pool = F.array(*[F.lit(p) for p in OP_POOL])
    n = (F.col("doc_id") % 5).cast("int")
    ops = F.transform(F.array_repeat(F.lit(0), n),
                      lambda _, j: F.element_at(pool, ((F.col("doc_id") * 7 + j * 13) % 16 + 1).cast("int")))
    m3 = F.col("sample_id") % 3
    return (docs.select(F.col("doc_id").alias("sample_id"), F.col("text").alias("code"),
                        F.col("source").alias("data_source"), ops.alias("ops"))
            .withColumn("ops_raw", F.when(m3 == 0, F.to_json("ops"))
                        .when(m3 == 1, F.coalesce(F.get("ops", 0), F.lit("")))))


V_SAMPLES_SQL = f"""v_samples AS (
  SELECT sample_id, code, data_source, ops,
         CASE sample_id % 3 WHEN 0 THEN CAST(to_json(ops) AS VARCHAR)
                            WHEN 1 THEN coalesce(ops[1], '') END AS ops_raw
  FROM (SELECT doc_id AS sample_id, text AS code, source AS data_source,
               CAST(list_transform(range(doc_id % 5),
                    lambda j: {_sql_list(OP_POOL)}[((doc_id * 7 + j * 13) % 16) + 1]) AS VARCHAR[]) AS ops
        FROM documents))"""


# --------------------------------------------------------------------------- completions
def _completion_text(body: Column, variant: Column, turn: Column) -> Column:
    lit = F.lit
    return (F.when(variant == 0, F.concat(lit(HEADER + "\n```cpp\n" + KERNEL_OPEN), body,
                                          lit("\n}\n```\n" + STOP)))
            .when(variant == 1, F.concat(lit("### kernels/fused_kernel.hip:\n\n```cpp\n" + KERNEL_OPEN), body,
                                         lit("\n}\n```")))
            .when(variant == 2, F.concat(lit("Kernel below.\n```cpp\n#include <hip/hip_runtime.h>\n"
                                             + KERNEL_OPEN), body, lit("\n}\n```")))
            .when(variant == 3, F.concat(lit(HEADER + "\n```cpp\n" + KERNEL_OPEN), body))
            .when(variant == 4, F.concat(lit("```python\n"), body, lit("\n```")))
            .when(variant == 5, body)
            .otherwise(F.regexp_replace(body, "[^.]", "")))


def v_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, generation, completion) from the assistant rows of ``conversations``."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    body = F.regexp_replace("text", "\n", " ")
    variant = (F.col("conv_id") + F.col("turn")) % 7
    return (conv.where(F.col("role") == "assistant")
            .select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("generation"),
                    _completion_text(body, variant, F.col("turn")).alias("completion")))


V_COMPLETIONS_SQL = f"""v_completions AS (
  SELECT conv_id AS prompt_id, turn AS generation,
    CASE (conv_id + turn) % 7
      WHEN 0 THEN {_nl(HEADER + chr(10) + "```cpp" + chr(10) + KERNEL_OPEN)} || replace(text, chr(10), ' ')
                  || {_nl(chr(10) + "}" + chr(10) + "```" + chr(10) + STOP)}
      WHEN 1 THEN {_nl("### kernels/fused_kernel.hip:" + chr(10) + chr(10) + "```cpp" + chr(10) + KERNEL_OPEN)}
                  || replace(text, chr(10), ' ') || {_nl(chr(10) + "}" + chr(10) + "```")}
      WHEN 2 THEN {_nl("Kernel below." + chr(10) + "```cpp" + chr(10) + "#include <hip/hip_runtime.h>" + chr(10)
                       + KERNEL_OPEN)} || replace(text, chr(10), ' ') || {_nl(chr(10) + "}" + chr(10) + "```")}
      WHEN 3 THEN {_nl(HEADER + chr(10) + "```cpp" + chr(10) + KERNEL_OPEN)} || replace(text, chr(10), ' ')
      WHEN 4 THEN {_nl("```python" + chr(10))} || replace(text, chr(10), ' ') || {_nl(chr(10) + "```")}
      WHEN 5 THEN replace(text, chr(10), ' ')
      ELSE regexp_replace(text, '[^.]', '', 'g') END AS completion
  FROM conversations WHERE role = 'assistant')"""


def v_prompt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt_id, turn, role, content): the user rows of each conversation; for an
    even ``conv_id`` the last user row is wrapped in a python fence."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    users = conv.where(F.col("role") == "user")
    last = users.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    wrap = (F.col("conv_id") % 2 == 0) & (F.col("turn") == F.col("last_turn"))
    return (users.join(last, "conv_id")
            .select(F.col("conv_id").alias("prompt_id"), "turn", "role",
                    F.when(wrap, F.concat(F.lit("```python\n"), "text", F.lit("\n```")))
                    .otherwise(F.col("text")).alias("content")))


V_PROMPT_TURNS_SQL = """v_prompt_turns AS (
  SELECT conv_id AS prompt_id, turn, role,
         CASE WHEN conv_id % 2 = 0 AND turn = max(turn) OVER (PARTITION BY conv_id)
              THEN '```python' || chr(10) || text || chr(10) || '```' ELSE text END AS content
  FROM conversations WHERE role = 'user')"""


# --------------------------------------------------------------------------- signatures
_EXTRA = {0: ", hipStream_t stream", 1: ", float alpha, hipStream_t stream",
          2: ", const float* w, int n, hipStream_t stream", 3: ", custom_t q, hipStream_t stream", 4: ""}
_LAUNCH_OPEN = '#include <hip/hip_runtime.h>\nextern "C" void launch_fused_kernel(\n    float* output, const float* input, int size'
_CTOR = {0: "def __init__(self):", 1: "def __init__(self, a: float = 1.0):",
         2: "def __init__(self, a: float = 1.0, b):"}


def v_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, kernel_code, model_code) from ``part``: launcher and constructor texts.

    The two narrow columns are dealt to the session's width first: the file of a million parts is a few MB, one or two
    scan tasks, and each row becomes two texts that are searched at length."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    m5 = F.col("p_partkey") % 5
    extra = F.when(m5 == 0, _EXTRA[0]).when(m5 == 1, _EXTRA[1]).when(m5 == 2, _EXTRA[2]) \
        .when(m5 == 3, _EXTRA[3]).otherwise(_EXTRA[4])
    s3 = F.col("p_size") % 3
    ctor = F.when(s3 == 0, _CTOR[0]).when(s3 == 1, _CTOR[1]).otherwise(_CTOR[2])
    return part.select(
        F.col("p_partkey").alias("model_id"),
        F.concat(F.lit(_LAUNCH_OPEN), extra, F.lit(") {\n}\n")).alias("kernel_code"),
        F.concat(F.lit("class Model(nn.Module):\n    "), ctor,
                 F.lit("\n        super().__init__()\n")).alias("model_code"))


V_SIGNATURES_SQL = f"""v_signatures AS (
  SELECT p_partkey AS model_id,
         {_nl(_LAUNCH_OPEN)} || CASE p_partkey % 5 WHEN 0 THEN '{_EXTRA[0]}' WHEN 1 THEN '{_EXTRA[1]}'
              WHEN 2 THEN '{_EXTRA[2]}' WHEN 3 THEN '{_EXTRA[3]}' ELSE '' END || ') {{' || chr(10) || '}}' || chr(10)
           AS kernel_code,
         'class Model(nn.Module):' || chr(10) || '    ' || CASE p_size % 3 WHEN 0 THEN '{_CTOR[0]}'
              WHEN 1 THEN '{_CTOR[1]}' ELSE '{_CTOR[2]}' END
           || chr(10) || '        super().__init__()' || chr(10) AS model_code
  FROM part)"""


# --------------------------------------------------------------------------- tensors
def v_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, ord, name, dtype, shape) weight specs from ``part``: models of 8 and
    of 16 tensors, so groups grow in number and fall on both sides of the
    10-tensor limit."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    k, r = F.floor(F.col("p_partkey") / 24).cast("long"), F.col("p_partkey") % 24
    ord_ = F.when(r < 8, r).otherwise(r - 8)
    return part.select(
        (k * 2 + F.when(r < 8, 0).otherwise(1)).alias("model_id"),
        ord_.cast("int").alias("ord"),
        F.concat(F.regexp_replace("p_name", " ", "."), F.lit("."), ord_.cast("string")).alias("name"),
        F.when(F.col("p_size") % 3 == 0, "int64").otherwise("float32").alias("dtype"),
        F.array(F.col("p_size").cast("int"), (F.col("p_partkey") % 7 + 1).cast("int")).alias("shape"))


V_TENSORS_SQL = """v_tensors AS (
  SELECT k * 2 + CASE WHEN r < 8 THEN 0 ELSE 1 END AS model_id, CAST(o AS INTEGER) AS ord,
         replace(p_name, ' ', '.') || '.' || CAST(o AS VARCHAR) AS name,
         CASE WHEN p_size % 3 = 0 THEN 'int64' ELSE 'float32' END AS dtype,
         [CAST(p_size AS INTEGER), CAST(p_partkey % 7 + 1 AS INTEGER)] AS shape
  FROM (SELECT *, CASE WHEN r < 8 THEN r ELSE r - 8 END AS o
        FROM (SELECT *, CAST(floor(p_partkey / 24) AS BIGINT) AS k, p_partkey % 24 AS r FROM part)))"""


# --------------------------------------------------------------------------- checks
def v_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, check_no, actual, expected) from ``embeddings``."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    exp = F.col("embedding").cast("array<double>")
    mid = F.floor(F.col("vec_id") / 5).cast("long")
    chk = (F.col("vec_id") % 5 + 1).cast("int")
    v = mid % 5
    shifted = lambda d: F.transform(exp, lambda x: x + F.lit(d))
    actual = (F.when(v == 0, exp).when(v == 1, shifted(0.001)).when(v == 2, shifted(0.5))
              .when(v == 3, F.when(chk > 2, shifted(0.5)).otherwise(exp))
              .otherwise(F.slice(exp, 1, 63)))
    return emb.select(mid.alias("model_id"), chk.alias("check_no"), actual.alias("actual"), exp.alias("expected"))


V_CHECKS_SQL = """v_checks AS (
  SELECT model_id, check_no,
         CASE model_id % 5 WHEN 0 THEN e
              WHEN 1 THEN list_transform(e, lambda x: x + 0.001::DOUBLE)
              WHEN 2 THEN list_transform(e, lambda x: x + 0.5::DOUBLE)
              WHEN 3 THEN CASE WHEN check_no > 2 THEN list_transform(e, lambda x: x + 0.5::DOUBLE) ELSE e END
              ELSE e[1:63] END AS actual,
         e AS expected
  FROM (SELECT CAST(floor(vec_id / 5) AS BIGINT) AS model_id, CAST(vec_id % 5 + 1 AS INTEGER) AS check_no,
               CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""


# --------------------------------------------------------------------------- timings
def v_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, variant, iteration, device, duration_us) from ``events``."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    variant = (F.when(F.col("event_type") == "view", "eager").when(F.col("event_type") == "click", "compiled")
               .when(F.col("event_type") == "purchase", "candidate").otherwise(F.col("event_type")))
    # iteration = position in time order per (user, event type), ranked per
    # hour with offsets so a busy user is not one window
    ranked = ranked_within(ev, ["user_id", "event_type"], F.date_trunc("hour", "ts"),
                           [F.col("ts"), F.col("event_id")])
    return ranked.select(
        F.col("user_id").alias("model_id"), variant.alias("variant"),
        (F.col("pos") + 1).cast("int").alias("iteration"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "cuda").otherwise("cpu").alias("device"),
        F.col("value").alias("duration_us"))


V_TIMINGS_SQL = """v_timings AS (
  SELECT user_id AS model_id,
         CASE event_type WHEN 'view' THEN 'eager' WHEN 'click' THEN 'compiled'
              WHEN 'purchase' THEN 'candidate' ELSE event_type END AS variant,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS iteration,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'cuda' ELSE 'cpu' END AS device,
         value AS duration_us
  FROM events)"""


# --------------------------------------------------------------------------- rollouts
def v_rollouts(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """One scored completion per event: (event_id, ts, run_id, step, generation,
    prompt_id, stage, reward, loss, kl, length, terminated) and the ``keep`` columns of ``events``."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    stage = (F.when(et == "error", "compile_error").when(et == "signup", "no_code")
             .when(et == "view", "verify_error").when(et == "click", "verify_partial")
             .when(et == "purchase", "profiled"))
    partial = F.least(F.lit(0.8), F.greatest(F.lit(0.05), F.lit(0.8) / (F.lit(1.0) + F.sqrt("value"))))
    reward = (F.when(et == "error", -0.5).when(et == "signup", -1.0).when(et == "view", 0.0)
              .when(et == "click", partial).when(et == "purchase", (F.col("event_id") % 3 + 1).cast("double")))
    length = (F.col("event_id") % 2048).cast("long")
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 4).alias("run_id"), F.floor(F.col("event_id") / 8).cast("long").alias("step"),
        (F.col("event_id") % 8).alias("generation"), F.floor(F.col("event_id") / 4).cast("long").alias("prompt_id"),
        stage.alias("stage"), reward.alias("reward"), F.col("value").alias("loss"),
        (F.col("value") * F.col("value") / 100.0).alias("kl"),
        length.alias("length"), (length < 1900).alias("terminated"), *keep)


V_ROLLOUTS_SQL = """v_rollouts AS (
  SELECT event_id, ts, user_id % 4 AS run_id, CAST(floor(event_id / 8) AS BIGINT) AS step,
         event_id % 8 AS generation, CAST(floor(event_id / 4) AS BIGINT) AS prompt_id,
         CASE event_type WHEN 'error' THEN 'compile_error' WHEN 'signup' THEN 'no_code'
              WHEN 'view' THEN 'verify_error' WHEN 'click' THEN 'verify_partial'
              WHEN 'purchase' THEN 'profiled' END AS stage,
         CASE event_type WHEN 'error' THEN -0.5::DOUBLE WHEN 'signup' THEN -1.0::DOUBLE
              WHEN 'view' THEN 0.0::DOUBLE
              WHEN 'click' THEN least(0.8::DOUBLE, greatest(0.05::DOUBLE, 0.8::DOUBLE / (1.0::DOUBLE + sqrt(value))))
              WHEN 'purchase' THEN CAST(event_id % 3 + 1 AS DOUBLE) END AS reward,
         value AS loss, value * value / 100.0::DOUBLE AS kl,
         CAST(event_id % 2048 AS BIGINT) AS length, event_id % 2048 < 1900 AS terminated
  FROM events)"""


# --------------------------------------------------------------------------- matrices
def v_matrix_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_quantity")
    return (li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k"))
            .agg(F.sum("l_quantity").alias("v")))


def v_matrix_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_discount")
    return (li.groupBy(F.col("l_partkey").alias("k"), F.col("l_linenumber").cast("long").alias("j"))
            .agg(F.sum("l_discount").alias("v")))


V_MATRIX_SQL = """v_matrix_a AS (
  SELECT l_suppkey AS i, l_partkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
v_matrix_b AS (
  SELECT l_partkey AS k, CAST(l_linenumber AS BIGINT) AS j, sum(l_discount) AS v FROM lineitem GROUP BY ALL)"""


# --------------------------------------------------------------------------- vectors / series / texts
def v_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x array<double>) from ``embeddings``."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return emb.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


V_VECTORS_SQL = """v_vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""


def v_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, seq, value): each user's event values in time order."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    return ev.select(F.col("user_id").alias("series_id"), "ts", F.col("event_id").alias("seq"), "value")


V_SERIES_SQL = """v_series AS (
  SELECT user_id AS series_id, ts, event_id AS seq, value FROM events)"""


STRUCT_NAME = "KernelArgs"


def v_struct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, text): C++-like text with two structs; the wanted one lists the
    words of ``p_name`` one per line."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    body = F.concat(F.lit("  float "), F.regexp_replace("p_name", " ", ";\n  float "), F.lit(";"))
    return part.select(
        F.col("p_partkey").alias("text_id"),
        F.concat(F.lit("struct Other {\n  int x;\n};\n\ntemplate <int N>\nstruct " + STRUCT_NAME + " : Base<N> {\n"),
                 body, F.lit("\n};\n")).alias("text"))


V_STRUCT_TEXTS_SQL = f"""v_struct_texts AS (
  SELECT p_partkey AS text_id,
         {_nl("struct Other {" + chr(10) + "  int x;" + chr(10) + "};" + chr(10) + chr(10) + "template <int N>" + chr(10)
              + "struct " + STRUCT_NAME + " : Base<N> {" + chr(10))}
         || '  float ' || replace(p_name, ' ', ';' || chr(10) || '  float ') || ';' || chr(10) || '}};' || chr(10) AS text
  FROM part)"""
