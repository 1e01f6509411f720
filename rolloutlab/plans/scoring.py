"""E2/E3 -- scoring rollouts and reporting on training history: queries for
K1-K4, A1-A4, A6-A8, J5-J7, R1-R5, W1-W5, X10, X11, P8, S5, S6."""

from __future__ import annotations

import uuid

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.functions.text import parse_profile_log, parse_verify_log, scorable
from rolloutlab.operators import checks as K
from rolloutlab.operators import history as H
from rolloutlab.operators import prompts as P
from rolloutlab.operators import rewards as R
from rolloutlab.operators import timing as TM
from rolloutlab.plans import sqlkit as S
from rolloutlab.plans.registry import register
from rolloutlab.session import checkpoint_dir
from rolloutlab.sources import fixtures as fx
from rolloutlab.sources import samples as src
from rolloutlab.sources.tables import read_table

WARMUP, ITERS, N_CHECKS = 5, 10, 5

# ---------------------------------------------------------------- shared SQL
_ELEM_OK = ("(NOT isnan(a[i]) AND NOT isnan(e[i]) AND (a[i] = e[i] OR abs(a[i] - e[i]) <= 0.01::DOUBLE + "
            "0.01::DOUBLE * abs(e[i])))")
CHECKS_SQL = f"""co AS (
  SELECT model_id, check_no, shape_ok, passed,
         CASE WHEN shape_ok AND NOT passed THEN
              list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - e[i]) * (a[i] - e[i]))) / len(a)
         END AS mse
  FROM (SELECT model_id, check_no, a, e, coalesce(len(a) = len(e), false) AS shape_ok,
               coalesce(len(a) = len(e), false) AND coalesce(list_bool_and(list_transform(range(1, len(a) + 1),
                 lambda i: {_ELEM_OK})), false) AS passed
        FROM (SELECT model_id, check_no, actual AS a, expected AS e FROM v_checks))),
ru AS (
  SELECT model_id, pass_count, shape_ok_count,
         CASE WHEN pass_count = {N_CHECKS} THEN 'PASS' WHEN pass_count > 0 THEN 'PARTIAL_PASS'
              WHEN shape_ok_count > 0 THEN 'SHAPE_OK' ELSE 'FAIL' END AS verdict, total_mse
  FROM (SELECT model_id, CAST(count_if(passed) AS BIGINT) AS pass_count,
               CAST(count_if(shape_ok) AS BIGINT) AS shape_ok_count, coalesce(sum(mse), 0.0) AS total_mse
        FROM co GROUP BY model_id)),
ver AS (
  SELECT model_id, pass_count, shape_ok_count, verdict,
         CASE WHEN verdict = 'SHAPE_OK' THEN total_mse / shape_ok_count END AS avg_mse FROM ru)"""

TIMING_SQL = f"""dt AS (
  SELECT model_id, variant, sum(duration_us) / count(DISTINCT iteration) AS device_us,
         CAST(count(DISTINCT iteration) AS BIGINT) AS n_iters
  FROM v_timings WHERE device = 'cuda' AND iteration > {WARMUP} AND iteration <= {WARMUP + ITERS}
  GROUP BY model_id, variant),
cv AS (
  SELECT model_id, eager_us, compiled_us, candidate_us,
         CASE WHEN candidate_us <> 0 THEN eager_us / candidate_us END AS speedup_eager,
         CASE WHEN candidate_us <> 0 THEN compiled_us / candidate_us END AS speedup_compile
  FROM (SELECT model_id, first(device_us) FILTER (WHERE variant = 'eager') AS eager_us,
               first(device_us) FILTER (WHERE variant = 'compiled') AS compiled_us,
               first(device_us) FILTER (WHERE variant = 'candidate') AS candidate_us
        FROM dt GROUP BY model_id))"""


def _r1_sql(partial: str, shape: str, mse: str) -> str:
    return (f"CASE WHEN coalesce({partial}, false) THEN 0.5::DOUBLE WHEN coalesce({shape}, false) THEN "
            f"CASE WHEN {mse} IS NOT NULL THEN least(0.8::DOUBLE, greatest(0.05::DOUBLE, 0.8::DOUBLE / "
            f"(1.0::DOUBLE + sqrt({mse})))) ELSE 0.3::DOUBLE END ELSE 0.0::DOUBLE END")


def _r2_sql(b: str, c: str, h: str) -> str:
    return (f"CASE WHEN {h} < {b} * 0.95::DOUBLE AND {h} < {c} * 0.95::DOUBLE THEN 3.0::DOUBLE "
            f"WHEN {h} < {b} * 0.95::DOUBLE THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")


def _py_sql(col: str) -> str:
    return (f"CASE WHEN regexp_matches({col}, '(?s)```python\\n(.*?)\\n```') "
            f"THEN regexp_extract({col}, '(?s)```python\\n(.*?)\\n```', 1) END")


# ---------------------------------------------------------------- checks
@register("close_checks", ["K1", "K2", "A2"], S.with_("v_checks", CHECKS_SQL,
          body="SELECT model_id, check_no, shape_ok, passed, mse FROM co"))
def q_close_checks(spark: SparkSession, sf: str) -> DataFrame:
    return K.check_outcomes(fx.v_checks(spark, sf)).select("model_id", "check_no", "shape_ok", "passed", "mse")


@register("roll_up_checks", ["A1"], S.with_("v_checks", CHECKS_SQL,
          body="SELECT model_id, pass_count, shape_ok_count, verdict, avg_mse FROM ver"))
def q_roll_up_checks(spark: SparkSession, sf: str) -> DataFrame:
    return K.roll_up_checks(fx.v_checks(spark, sf), n=N_CHECKS).select(
        "model_id", "pass_count", "shape_ok_count", "verdict", "avg_mse")


@register("parse_verify_log", ["X10", "A1"], S.with_("v_checks", CHECKS_SQL, f"""lg AS (
  SELECT model_id, CASE verdict WHEN 'PASS' THEN '[PASS] verify success'
    WHEN 'PARTIAL_PASS' THEN '[PARTIAL_PASS] ' || pass_count || '/{N_CHECKS} passed, ' || shape_ok_count || '/{N_CHECKS} shape-correct'
    WHEN 'SHAPE_OK' THEN '[SHAPE_OK] ' || shape_ok_count || '/{N_CHECKS} shape-correct, AVG_MSE=' || CAST(avg_mse AS VARCHAR)
    ELSE '[FAIL] verify failed' END AS log FROM ver)""",
    body="""SELECT model_id, contains(log, '[PASS] verify success') AS passed, contains(log, '[PARTIAL_PASS]') AS partial,
       contains(log, '[SHAPE_OK]') AS shape_ok,
       CASE WHEN regexp_matches(log, 'AVG_MSE=([0-9.eE+-]+)')
            THEN TRY_CAST(regexp_extract(log, 'AVG_MSE=([0-9.eE+-]+)', 1) AS DOUBLE) END AS avg_mse
FROM lg"""))
def q_parse_verify_log(spark: SparkSession, sf: str) -> DataFrame:
    ru = K.roll_up_checks(fx.v_checks(spark, sf), n=N_CHECKS)
    parsed = ru.select("model_id", parse_verify_log(K.render_verify_log(n=N_CHECKS)).alias("p"))
    return parsed.select("model_id", "p.passed", "p.partial", "p.shape_ok", "p.avg_mse")


@register("partial_reward", ["R1", "A1"], S.with_("v_checks", CHECKS_SQL,
          body=f"""SELECT model_id, verdict, {_r1_sql("verdict = 'PARTIAL_PASS'", "verdict = 'SHAPE_OK'", 'avg_mse')} AS reward
FROM ver"""))
def q_partial_reward(spark: SparkSession, sf: str) -> DataFrame:
    ru = K.roll_up_checks(fx.v_checks(spark, sf), n=N_CHECKS)
    return ru.select("model_id", "verdict", R.partial_reward(F.col("verdict") == "PARTIAL_PASS",
                                                             F.col("verdict") == "SHAPE_OK", "avg_mse").alias("reward"))


_LEAVES_SQL = """fa AS (SELECT model_id, check_no, '.' || CAST(i - 1 AS VARCHAR) AS path, actual[i] AS leaf
  FROM (SELECT *, unnest(range(1, len(actual) + 1)) AS i FROM v_checks)),
fe AS (SELECT model_id, check_no, '.' || CAST(i - 1 AS VARCHAR) AS path, expected[i] AS leaf
  FROM (SELECT *, unnest(range(1, len(expected) + 1)) AS i FROM v_checks)),
po AS (SELECT coalesce(fa.model_id, fe.model_id) AS model_id, coalesce(fa.check_no, fe.check_no) AS check_no,
         fa.leaf AS actual, fe.leaf AS expected,
         CASE WHEN fa.path IS NOT NULL AND fe.path IS NOT NULL THEN 'matched'
              WHEN fe.path IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
  FROM fa FULL OUTER JOIN fe ON fa.model_id = fe.model_id AND fa.check_no = fe.check_no AND fa.path = fe.path)"""


def _check_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.v_checks(spark, sf)
    made, wanted = (c.select("model_id", "check_no", F.col(x).alias("v")) for x in ("actual", "expected"))
    return K.pair_nested(made, wanted, ["model_id", "check_no"], "v")


@register("pair_outputs", ["J7"], S.with_("v_checks", _LEAVES_SQL,
          body="SELECT status, CAST(count(*) AS BIGINT) AS n, sum(coalesce(expected, actual)) AS leaf_sum FROM po GROUP BY status"))
def q_pair_outputs(spark: SparkSession, sf: str) -> DataFrame:
    p = _check_pairs(spark, sf)
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum(F.coalesce("expected", "actual")).alias("leaf_sum"))


@register("mse_table", ["A2", "J7"], S.with_("v_checks", _LEAVES_SQL, body="""SELECT model_id, check_no,
       avg((actual - expected) * (actual - expected)) AS mse FROM po WHERE status = 'matched' GROUP BY ALL"""))
def q_mse_table(spark: SparkSession, sf: str) -> DataFrame:
    """A2 table form: mean squared difference over paired leaves of a long table."""
    p = _check_pairs(spark, sf)
    return K.mse_table(p.where(F.col("status") == "matched"), ["model_id", "check_no"])


@register("compare_by_rule", ["K2", "K3"], S.with_("v_checks", body="""SELECT model_id, check_no,
       len(actual) = len(expected) AS same_shape,
       len(actual) = len(expected) AND check_no <> 5 AND len(list_filter(range(1, len(expected) + 1),
         lambda i: abs(actual[i] - expected[i]) > 0.01::DOUBLE + 0.01::DOUBLE * abs(expected[i]))) = 0 AS ok
FROM v_checks"""))
def q_compare_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Nested values: a two-row tensor, a number and a map with an extra (allowed) and, for check 5, a missing key."""
    def value(c: str, tags) -> Column:
        return F.struct(F.array(F.slice(c, 1, 32), F.slice(c, 33, 64)).alias("m"), F.col("check_no").alias("n"), tags.alias("tags"))

    name = F.concat(F.lit("model "), F.col("model_id").cast("string"))
    made = value("actual", F.create_map(F.lit("name"), name, F.lit("extra"), F.lit("yes")))
    key = F.when(F.col("check_no") == 5, "absent").otherwise("name")
    df = fx.v_checks(spark, sf).select("model_id", "check_no", made.alias("a"), value("expected", F.create_map(key, name)).alias("e"))
    t = df.schema["a"].dataType
    return df.select("model_id", "check_no", K.same_shape(F.col("a.m"), F.col("e.m"), t["m"].dataType).alias("same_shape"),
                     K.equal_by_rule(F.col("a"), F.col("e"), t).alias("ok"))


@register("roll_up_tensors", ["A1", "K2"], S.with_("v_checks", """t AS (SELECT *, len(actual) = len(expected) AND check_no <> 4 AS so,
         list_filter(range(1, len(expected) + 1), lambda i: NOT (abs(actual[i] - expected[i]) <= 0.01::DOUBLE + 0.01::DOUBLE * abs(expected[i]))) AS off
  FROM v_checks)""", body="""SELECT model_id, CAST(count_if(so AND len(off) = 0) AS BIGINT) AS pass_count, CAST(count_if(so) AS BIGINT) AS shape_ok_count
FROM t GROUP BY model_id"""))
def q_roll_up_tensors(spark: SparkSession, sf: str) -> DataFrame:
    """Two-row tensors whose element types are named; check 4 gives another type than was asked for."""
    two = lambda c: F.array(F.slice(c, 1, 32), F.slice(c, 33, 64))
    c = fx.v_checks(spark, sf).select("model_id", two("actual").alias("actual"), two("expected").alias("expected"), F.lit("float32").alias("want"),
                                      F.when(F.col("check_no") == 4, "float16").otherwise("float32").alias("got"))
    return K.roll_up_checks(c, actual_dtype="got", expected_dtype="want").select("model_id", "pass_count", "shape_ok_count")


@register("compare_nested", ["K3", "J7", "K1"], S.with_("v_checks", _LEAVES_SQL, body="""SELECT model_id, check_no,
       CAST(count_if(status = 'matched') AS BIGINT) AS n_matched, CAST(count_if(status = 'missing') AS BIGINT) AS n_missing,
       CAST(count_if(status = 'extra') AS BIGINT) AS n_extra,
       CAST(count_if(status = 'matched' AND NOT isnan(actual) AND NOT isnan(expected) AND (actual = expected OR
            abs(actual - expected) <= 0.01::DOUBLE + 0.01::DOUBLE * abs(expected))) AS BIGINT) AS n_close,
       count_if(status = 'missing') = 0 AND count_if(status = 'extra') = 0 AND
       count_if(status = 'matched' AND NOT isnan(actual) AND NOT isnan(expected) AND (actual = expected OR
            abs(actual - expected) <= 0.01::DOUBLE + 0.01::DOUBLE * abs(expected))) = count_if(status = 'matched') AS ok
FROM po GROUP BY model_id, check_no"""))
def q_compare_nested(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.v_checks(spark, sf)
    return K.compare_nested(c.select("model_id", "check_no", F.col("actual").alias("v")),
                            c.select("model_id", "check_no", F.col("expected").alias("v")),
                            ["model_id", "check_no"], "v")


@register("map_leaves", ["K4"], S.with_("v_vectors", body="""SELECT vec_id,
       list_sum(list_transform(x, lambda v: v * 2.0::DOUBLE + 1.0::DOUBLE)) AS arr_sum,
       x[1] * 2.0::DOUBLE + 1.0::DOUBLE AS first_leaf, x[len(x)] * 2.0::DOUBLE + 1.0::DOUBLE AS last_leaf,
       CAST(label AS DOUBLE) * 2.0::DOUBLE + 1.0::DOUBLE AS label_leaf
FROM v_vectors"""))
def q_map_leaves(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    nested = v.select("vec_id", F.struct(F.col("x").alias("arr"),
                                         F.create_map(F.lit("first"), F.get("x", 0), F.lit("last"),
                                                      F.element_at("x", -1)).alias("m"),
                                         F.col("label").cast("double").alias("s")).alias("n"))
    dtype = nested.schema["n"].dataType
    out = nested.select("vec_id", K.map_leaves(F.col("n"), dtype, lambda x: x * 2.0 + 1.0).alias("n"))
    return out.select("vec_id", F.aggregate("n.arr", F.lit(0.0), lambda a, b: a + b).alias("arr_sum"),
                      F.col("n.m")["first"].alias("first_leaf"), F.col("n.m")["last"].alias("last_leaf"),
                      F.col("n.s").alias("label_leaf"))


# ---------------------------------------------------------------- timings
@register("device_time", ["A3"], S.with_("v_timings", TIMING_SQL,
          body="SELECT model_id, variant, device_us, n_iters FROM dt"))
def q_device_time(spark: SparkSession, sf: str) -> DataFrame:
    return TM.device_time(fx.v_timings(spark, sf), WARMUP, ITERS)


@register("compare_variants", ["A4"], S.with_("v_timings", TIMING_SQL, body="SELECT * FROM cv"))
def q_compare_variants(spark: SparkSession, sf: str) -> DataFrame:
    return TM.compare_variants(TM.device_time(fx.v_timings(spark, sf), WARMUP, ITERS))


@register("speed_reward", ["R2", "A4"], S.with_("v_timings", TIMING_SQL, body=f"""SELECT model_id,
       {_r2_sql('eager_us', 'compiled_us', 'candidate_us')} AS reward
FROM cv WHERE eager_us IS NOT NULL AND compiled_us IS NOT NULL AND candidate_us IS NOT NULL"""))
def q_speed_reward(spark: SparkSession, sf: str) -> DataFrame:
    cv = TM.compare_variants(TM.device_time(fx.v_timings(spark, sf), WARMUP, ITERS)).dropna(
        subset=["eager_us", "compiled_us", "candidate_us"])
    return cv.select("model_id", R.speed_reward("eager_us", "compiled_us", "candidate_us").alias("reward"))


@register("parse_profile_log", ["X11", "A4"], S.with_("v_timings", TIMING_SQL, """pl AS (
  SELECT model_id, 'Torch Baseline: ' || CAST(eager_us AS VARCHAR) || 'us, Torch Compile: ' || CAST(compiled_us AS VARCHAR)
         || 'us, HIP Extension: ' || CAST(candidate_us AS VARCHAR) || 'us' AS log FROM cv)""",
    body="""SELECT model_id,
  CASE WHEN regexp_matches(log, 'Torch Baseline:\\s*([\\d.]+)us.*Torch Compile:\\s*([\\d.]+)us.*HIP Extension:\\s*([\\d.]+)us')
       THEN TRY_CAST(regexp_extract(log, 'Torch Baseline:\\s*([\\d.]+)us', 1) AS DOUBLE) END AS eager_us,
  CASE WHEN regexp_matches(log, 'Torch Baseline:\\s*([\\d.]+)us.*Torch Compile:\\s*([\\d.]+)us.*HIP Extension:\\s*([\\d.]+)us')
       THEN TRY_CAST(regexp_extract(log, 'Torch Compile:\\s*([\\d.]+)us', 1) AS DOUBLE) END AS compiled_us,
  CASE WHEN regexp_matches(log, 'Torch Baseline:\\s*([\\d.]+)us.*Torch Compile:\\s*([\\d.]+)us.*HIP Extension:\\s*([\\d.]+)us')
       THEN TRY_CAST(regexp_extract(log, 'HIP Extension:\\s*([\\d.]+)us', 1) AS DOUBLE) END AS candidate_us
FROM pl"""))
def q_parse_profile_log(spark: SparkSession, sf: str) -> DataFrame:
    cv = TM.compare_variants(TM.device_time(fx.v_timings(spark, sf), WARMUP, ITERS))
    p = cv.select("model_id", parse_profile_log(TM.render_profile_log()).alias("p"))
    return p.select("model_id", "p.eager_us", "p.compiled_us", "p.candidate_us")


@register("format_feedback", ["P8", "R2"], S.with_("v_timings", TIMING_SQL, body=f"""SELECT model_id,
       eager_us / candidate_us AS speedup_eager, compiled_us / candidate_us AS speedup_compile,
       {_r2_sql('eager_us', 'compiled_us', 'candidate_us')} AS reward, true AS text_holds_numbers
FROM cv WHERE eager_us IS NOT NULL AND compiled_us IS NOT NULL AND candidate_us IS NOT NULL"""))
def q_format_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Every number of the rendered text is parsed back: the reward is taken from it, and the three times and two
    speed-ups must be the columns' to the places shown (T4: Java and C may round ties differently in the text)."""
    cv = TM.compare_variants(TM.device_time(fx.v_timings(spark, sf), WARMUP, ITERS)).dropna(
        subset=["eager_us", "compiled_us", "candidate_us"])
    fb = cv.withColumn("reward", R.speed_reward("eager_us", "compiled_us", "candidate_us")).withColumn(
        "feedback", P.format_feedback("eager_us", "compiled_us", "candidate_us", "reward"))
    whole = (r"^Torch Baseline: (\d+\.\d{3})us, Torch Compile: (\d+\.\d{3})us, HIP Extension: (\d+\.\d{3})us \| "
             r"Speedup: (\d+\.\d{2})x eager, (\d+\.\d{2})x compile \| Reward: ([+-]\d+)$")
    shown = [F.try_to_number(F.regexp_extract("feedback", whole, i), F.lit("S999999999999.999")).cast("double") for i in range(1, 7)]
    eager, compiled = F.col("eager_us") / F.col("candidate_us"), F.col("compiled_us") / F.col("candidate_us")
    wanted = [("eager_us", 5.1e-4), ("compiled_us", 5.1e-4), ("candidate_us", 5.1e-4), (eager, 5.1e-3), (compiled, 5.1e-3)]
    holds = [F.coalesce(F.abs(x - (F.col(c) if isinstance(c, str) else c)) <= d, F.lit(False)) for x, (c, d) in zip(shown, wanted)]
    return fb.select("model_id", eager.alias("speedup_eager"), compiled.alias("speedup_compile"), shown[5].alias("reward"),
                     reduce(and_, holds).alias("text_holds_numbers"))


# ---------------------------------------------------------------- scoring job
def _turns_sql() -> str:
    return f"""code AS (SELECT prompt_id, arg_min(c, turn) AS model_code
  FROM (SELECT prompt_id, turn, {_py_sql('content')} AS c FROM v_prompt_turns WHERE role = 'user')
  WHERE c IS NOT NULL GROUP BY prompt_id)"""


def _kernel_sql(col: str) -> str:
    norm = (f"regexp_replace({col}, '(?m)^[ \\t*#`-]*(?:kernels/)?fused_kernel\\.hip[ \\t*#`:\\-()]*$', "
            f"'**kernels/fused_kernel.hip**', 'g')")
    named = ("'(?ms)^[ \\t]*\\*\\*kernels/fused_kernel\\.hip\\*\\*[ \\t]*\\n(?:[ \\t]*\\n)*[ \\t]*```[^\\n]*(?:\\n|\\z)"
             "(.*?)(?:^[ \\t]*```|\\z)'")
    fenced = "'(?s)```(\\w*)\\n(.*?)\\n```'"
    return f"""CASE WHEN regexp_matches(nt, {named}) THEN regexp_replace(regexp_extract(nt, {named}, 1), '\\n\\z', '')
     ELSE list_filter(list_transform(range(1, len(regexp_extract_all(nt, {fenced}, 1)) + 1),
            lambda i: {{'lang': regexp_extract_all(nt, {fenced}, 1)[i], 'body': regexp_extract_all(nt, {fenced}, 2)[i]}}),
          lambda b: b.lang IN ('cpp', 'c', 'c++', 'hip') AND (contains(b.body, '__global__') OR contains(b.body, 'hip_runtime')))[1].body
     END""", norm


#: Characters of a completion that stand for a second of each phase: longer texts go over the profile's, the verify's and the task's limit.
_PHASES = {"compile_s": 50.0, "verify_s": 40.0, "profile_s": 12.0}


def _score_sql(final_body: str, limits: bool = False) -> str:
    kexpr, norm = _kernel_sql("completion")
    over = {k: f"length(kt.completion) / {n}::DOUBLE > {R.LIMITS[k]}" if limits else "false" for k, n in _PHASES.items()}
    whole = " + ".join(f"length(kt.completion) / {n}::DOUBLE" for n in _PHASES.values()) + f" > {R.LIMITS['task_s']}" if limits else "false"
    return S.with_("v_completions", "v_prompt_turns", "v_checks", "v_timings", CHECKS_SQL, TIMING_SQL, _turns_sql(),
                   f"""kt AS (SELECT prompt_id, generation, completion, {kexpr} AS kernel
  FROM (SELECT *, {norm} AS nt FROM v_completions))""",
                   f"""tk AS (SELECT kt.prompt_id, kt.generation, kt.kernel,
         coalesce(length(trim(kt.completion, {S.WS})) >= 20, false) AND coalesce(code.model_code <> '', false) AND NOT ({whole}) AS evaluated,
         {over["verify_s"]} AS verify_over, {over["profile_s"]} AS profile_over, NOT ({over["compile_s"]}) AND
         coalesce(length(kt.kernel) - length(replace(kt.kernel, '{{', '')) = length(kt.kernel) - length(replace(kt.kernel, '}}', ''))
                  AND contains(kt.kernel, '__global__'), false) AS compile_ok
  FROM kt LEFT JOIN code USING (prompt_id))""",
                   f"""sc AS (SELECT tk.prompt_id, tk.generation, tk.evaluated,
    CASE WHEN tk.kernel IS NULL THEN 'no_code' WHEN NOT tk.compile_ok THEN 'compile_error'
         WHEN tk.verify_over THEN 'verify_error'
         WHEN coalesce(ver.verdict, 'FAIL') <> 'PASS' THEN
              CASE WHEN {_r1_sql("ver.verdict = 'PARTIAL_PASS'", "ver.verdict = 'SHAPE_OK'", 'ver.avg_mse')} > 0
                   THEN 'verify_partial' ELSE 'verify_error' END
         WHEN tk.profile_over OR cv.eager_us IS NULL OR cv.compiled_us IS NULL OR cv.candidate_us IS NULL THEN 'profile_error'
         ELSE 'profiled' END AS stage,
    CASE WHEN tk.kernel IS NULL THEN -1.0::DOUBLE WHEN NOT tk.compile_ok THEN -0.5::DOUBLE
         WHEN tk.verify_over THEN 0.0::DOUBLE
         WHEN coalesce(ver.verdict, 'FAIL') <> 'PASS' THEN {_r1_sql("ver.verdict = 'PARTIAL_PASS'", "ver.verdict = 'SHAPE_OK'", 'ver.avg_mse')}
         WHEN tk.profile_over OR cv.eager_us IS NULL OR cv.compiled_us IS NULL OR cv.candidate_us IS NULL THEN 1.0::DOUBLE
         ELSE {_r2_sql('cv.eager_us', 'cv.compiled_us', 'cv.candidate_us')} END AS reward
  FROM tk LEFT JOIN ver ON ver.model_id = tk.prompt_id LEFT JOIN cv ON cv.model_id = tk.prompt_id)""",
                   """fin AS (SELECT c.prompt_id, c.generation, sc.stage AS stage,
         coalesce(greatest(sc.reward, -1.0::DOUBLE), -1.0::DOUBLE) AS reward
  FROM v_completions c LEFT JOIN sc ON sc.prompt_id = c.prompt_id AND sc.generation = c.generation AND sc.evaluated)""",
                   body=final_body)


def _score(spark: SparkSession, sf: str, noise: float = 0.0) -> DataFrame:
    return R.score_rollouts(fx.v_completions(spark, sf), fx.v_prompt_turns(spark, sf), fx.v_checks(spark, sf),
                            fx.v_timings(spark, sf), noise=noise, seed=7, n_checks=N_CHECKS, warmup=WARMUP,
                            iters=ITERS)


@register("score_rollouts", ["R5", "R3", "R4", "J5", "J6", "W1", "X4", "X5", "F1", "A1", "A3", "A4"],
          _score_sql("SELECT prompt_id, generation, stage, reward FROM fin"))
def q_score_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    return _score(spark, sf).select("prompt_id", "generation", "stage", "reward")


@register("score_with_limits", ["R5", "R3"], _score_sql("SELECT prompt_id, generation, stage, reward FROM fin", limits=True))
def q_score_with_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Completions are message lists, of which the last one counts, and phases have time limits: one that takes too long
    fails its phase (a profile that did not end is the ladder's ``profile_error``), a task that does has the default."""
    c = fx.v_completions(spark, sf)
    took = c.select("prompt_id", "generation", *((F.length("completion") / F.lit(n)).alias(k) for k, n in _PHASES.items()))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    lists = c.withColumn("completion", F.array(message("assistant", F.lit("```cpp\n__global__ {")), message("assistant", F.col("completion"))))
    return R.score_rollouts(lists, fx.v_prompt_turns(spark, sf), fx.v_checks(spark, sf), fx.v_timings(spark, sf), n_checks=N_CHECKS, warmup=WARMUP,
                            iters=ITERS, durations=took).select("prompt_id", "generation", "stage", "reward")


@register("stage_and_reward", ["R3"], _score_sql(
    "SELECT stage, CAST(count(*) AS BIGINT) AS n, sum(reward) AS reward_sum FROM fin GROUP BY stage"))
def q_stage_and_reward(spark: SparkSession, sf: str) -> DataFrame:
    return _score(spark, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("reward_sum"))


@register("finalise_noise", ["R4"], _score_sql("""SELECT c.prompt_id, c.generation, sc.stage AS stage,
       CASE WHEN sc.prompt_id IS NULL THEN -1.0::DOUBLE
            ELSE greatest(sc.reward, -1.0::DOUBLE) + 0.01::DOUBLE * (2.0::DOUBLE * CAST(CAST('0x' || substr(
                 md5(concat_ws('|', '7', c.prompt_id, c.generation)), 1, 13) AS BIGINT) AS DOUBLE)
                 / 4503599627370496.0::DOUBLE - 1.0::DOUBLE) END AS reward
FROM v_completions c LEFT JOIN sc ON sc.prompt_id = c.prompt_id AND sc.generation = c.generation AND sc.evaluated"""))
def q_finalise_noise(spark: SparkSession, sf: str) -> DataFrame:
    """R4 with noise 0.01, drawn from md5 of (seed, prompt, generation)."""
    return _score(spark, sf, noise=0.01).select("prompt_id", "generation", "stage", "reward")


@register("group_advantage", ["W4", "R5"], _score_sql("""SELECT prompt_id, generation, reward,
       CASE WHEN count(*) OVER (PARTITION BY prompt_id) > 1 THEN
            (reward - avg(reward) OVER (PARTITION BY prompt_id)) /
            (coalesce(stddev_samp(reward) OVER (PARTITION BY prompt_id), 0.0) + 0.0001::DOUBLE)
       ELSE 0.0::DOUBLE END AS advantage
FROM fin"""))
def q_group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    scored = _score(spark, sf).select("prompt_id", "generation", "reward")
    return R.group_advantage(scored, materialize=True).select("prompt_id", "generation", "reward", "advantage")


@register("first_user_source", ["W1", "X5"], S.with_("v_prompt_turns", _turns_sql(),
          body="SELECT prompt_id, model_code FROM code"))
def q_first_user_source(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_user_source(fx.v_prompt_turns(spark, sf))


@register("first_user_source_messages", ["W1", "X5"], S.with_("v_prompt_turns", _turns_sql(),
          body="SELECT prompt_id, model_code FROM code"))
def q_first_user_source_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The array form: the prompt's turns as one message list."""
    said = fx.v_prompt_turns(spark, sf).groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))
    return said.select("prompt_id", R.first_user_source_of("messages").alias("model_code")).where("model_code IS NOT NULL")


@register("pair_completions", ["J6", "W1"], S.with_("v_completions", "v_prompt_turns", _turns_sql(), body="""SELECT
       c.prompt_id, c.generation, code.model_code IS NOT NULL AS has_model_code,
       CAST(length(code.model_code) AS BIGINT) AS model_code_chars
FROM v_completions c LEFT JOIN code USING (prompt_id)"""))
def q_pair_completions(spark: SparkSession, sf: str) -> DataFrame:
    p = R.pair_completions(fx.v_completions(spark, sf), R.first_user_source(fx.v_prompt_turns(spark, sf)))
    return p.select("prompt_id", "generation", F.col("model_code").isNotNull().alias("has_model_code"),
                    F.length("model_code").cast("long").alias("model_code_chars"))


@register("fill_missing", ["J5", "F1"], S.with_("v_completions", body=f"""SELECT prompt_id, generation,
       CASE WHEN coalesce(length(trim(completion, {S.WS})) >= 20, false) THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS reward
FROM v_completions"""))
def q_fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.v_completions(spark, sf)
    results = c.where(scorable("completion")).select("prompt_id", "generation", F.lit(0.0).alias("reward"),
                                                      F.lit("ok").alias("stage"))
    return R.fill_missing(c.select("prompt_id", "generation"), results, ["prompt_id", "generation"]).select(
        "prompt_id", "generation", "reward")


# ---------------------------------------------------------------- history
@register("stage_distribution", ["A6"], S.with_("v_rollouts", body="""SELECT stage, CAST(count(*) AS BIGINT) AS n,
       avg(reward) AS mean_reward, count(*) / sum(count(*)) OVER () AS share FROM v_rollouts GROUP BY stage"""))
def q_stage_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return H.stage_distribution(fx.v_rollouts(spark, sf))


@register("rate_by_step_window", ["A7"], S.with_("v_rollouts", body="""SELECT run_id, CAST(floor(step / 50) AS BIGINT) AS window,
       CAST(count(*) AS BIGINT) AS n, count_if(stage = 'compile_error') / count(*) AS error_rate,
       1.0 - count_if(stage = 'no_code') / count(*) AS compliance, CAST(floor(step / 50) AS BIGINT) * 50 AS first_step
FROM v_rollouts GROUP BY ALL"""))
def q_rate_by_step_window(spark: SparkSession, sf: str) -> DataFrame:
    return H.rate_by_step_window(fx.v_rollouts(spark, sf), 50, by=["run_id"])


@register("completion_lengths", ["A8"], S.with_("v_rollouts", body="""SELECT run_id, CAST(count(*) AS BIGINT) AS n,
       avg(length) AS mean_length, quantile_cont(length, 0.5) AS p50, quantile_cont(length, 0.9) AS p90,
       quantile_cont(length, 0.99) AS p99, count_if(NOT terminated) / count(*) AS clipped_share
FROM v_rollouts GROUP BY run_id"""))
def q_completion_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return H.completion_lengths(fx.v_rollouts(spark, sf), by=["run_id"])


@register("spikes", ["W5"], S.with_("v_rollouts", """ps AS (SELECT run_id, step, avg(loss) AS value FROM v_rollouts GROUP BY ALL)""",
    """sp AS (SELECT run_id, step, value,
         avg(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS trailing_mean
  FROM ps)""",
    """sk AS (SELECT *, coalesce(value > 1.5::DOUBLE * trailing_mean, false) AS is_spike FROM sp)""",
    body="""SELECT run_id, step, value, trailing_mean, is_spike,
       CASE WHEN min(CASE WHEN NOT is_spike THEN step END) OVER (PARTITION BY run_id ORDER BY step
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - step <= 250
            THEN min(CASE WHEN NOT is_spike THEN step END) OVER (PARTITION BY run_id ORDER BY step
                 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - step END AS recovery_steps
FROM sk QUALIFY is_spike"""))
def q_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return H.spikes(fx.v_rollouts(spark, sf), factor=1.5, window=20)


def _traj_turns(spark: SparkSession, sf: str) -> DataFrame:
    return fx.v_rollouts(spark, sf, "user_id").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), "reward",
        F.when(F.col("stage") == "no_code", F.lit("")).otherwise(F.lit("code")).alias("text"))


_TRAJ_TURNS_SQL = """tt AS (SELECT e.user_id AS conv_id, r.event_id AS turn, r.reward,
         CASE WHEN r.stage = 'no_code' THEN '' ELSE 'code' END AS text
  FROM v_rollouts r JOIN events e USING (event_id))"""


@register("trajectory", ["W3"], S.with_("v_rollouts", _TRAJ_TURNS_SQL, """it AS (SELECT *,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration FROM tt)""",
    """st AS (SELECT *, length(text) > 0 AND (reward >= 3.0 OR iteration >= 20) AS stop_here FROM it)""",
    """fs AS (SELECT conv_id, min(turn) FILTER (WHERE stop_here) AS stop_turn FROM st GROUP BY conv_id)""",
    body="""SELECT st.conv_id, st.turn, st.reward, st.text, CAST(st.iteration AS BIGINT) AS iteration,
       coalesce(st.turn = fs.stop_turn, false) AS should_stop
FROM st JOIN fs USING (conv_id) WHERE fs.stop_turn IS NULL OR st.turn <= fs.stop_turn"""))
def q_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return H.trajectory(_traj_turns(spark, sf), "conv_id", "turn", "reward", "text", max_iterations=20).select(
        "conv_id", "turn", "reward", "text", "iteration", "should_stop")


@register("last_assistant", ["W2"], body_sql := """WITH la AS (SELECT conv_id, arg_max(text, turn) AS t
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT k.conv_id, coalesce(la.t, '') AS last_assistant
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN la USING (conv_id)""")
def q_last_assistant(spark: SparkSession, sf: str) -> DataFrame:
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return H.last_assistant(conv)


@register("keep_latest", ["S6"], S.with_("v_rollouts", body="""SELECT run_id, step, event_id FROM v_rollouts
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC, event_id DESC) <= 3"""))
def q_keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.v_rollouts(spark, sf).select("run_id", "step", "event_id")
    return src.keep_latest(r, ["run_id"], F.struct("step", "event_id"), 3)


@register("quarantine", ["S5", "F1"], S.with_("v_completions", body=f"""SELECT prompt_id, generation FROM v_completions
WHERE coalesce(length(trim(completion, {S.WS})) >= 20, false)"""))
def q_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    side = f"{checkpoint_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    c = fx.v_completions(spark, sf)
    return src.quarantine(c, scorable("completion"), side).select("prompt_id", "generation")


