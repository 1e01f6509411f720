"""Reward computation (R1-R5), task pairing (J5, J6) and group advantage.

R5 joins every per-model input on the prompt key, so all joins share one hash
partitioning (no re-shuffle between them); per-group statistics are computed
with ``groupBy`` (partial aggregation) and joined back, never with a window
over an unbounded group.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloutlab.functions.text import kernel_source, python_source, scorable
from rolloutlab.operators.checks import roll_up_checks
from rolloutlab.operators.joins import join_null_safe, with_statistics
from rolloutlab.operators.timing import compare_variants, device_time

# FIXED VALUES: stage names and reward levels.
NO_CODE, COMPILE_ERROR, VERIFY_ERROR, VERIFY_PARTIAL, PROFILE_ERROR, PROFILED = (
    "no_code", "compile_error", "verify_error", "verify_partial", "profile_error", "profiled")
STAGES = (NO_CODE, "partial_files", COMPILE_ERROR, VERIFY_ERROR, VERIFY_PARTIAL, PROFILE_ERROR, PROFILED)
STAGE_REWARD = {NO_CODE: -1.0, "partial_files": -0.9, COMPILE_ERROR: -0.5, PROFILE_ERROR: 1.0}
#: Most seconds of each phase and of a whole task.
LIMITS = {"compile_s": 90.0, "verify_s": 30.0, "profile_s": 60.0, "task_s": 180.0}
SPEED_MARGIN = 0.95
DEFAULT_REWARD = -1.0
EPS = 1e-4


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def partial_reward(partial, shape_ok, avg_mse) -> Column:
    """0.5 for a partial pass; for shape-only, ``0.8/(1+sqrt(mse))`` clamped to
    [0.05, 0.8] (0.3 when the MSE is unknown); else 0."""
    m = _c(avg_mse)
    cont = F.least(F.lit(0.8), F.greatest(F.lit(0.05), F.lit(0.8) / (F.lit(1.0) + F.sqrt(m))))
    return (F.when(F.coalesce(_c(partial), F.lit(False)), F.lit(0.5))
            .when(F.coalesce(_c(shape_ok), F.lit(False)), F.when(m.isNotNull(), cont).otherwise(F.lit(0.3)))
            .otherwise(F.lit(0.0)))


def speed_reward(eager, compiled, candidate, margin: float = SPEED_MARGIN) -> Column:
    """R2: 3 if faster than ``margin`` x both baselines, 2 if only than eager, else 1 (strict)."""
    b, c, h = _c(eager), _c(compiled), _c(candidate)
    fast_b = h < b * F.lit(margin)
    fast_c = h < c * F.lit(margin)
    return F.when(fast_b & fast_c, F.lit(3.0)).when(fast_b, F.lit(2.0)).otherwise(F.lit(1.0))


def brace_balanced(kernel) -> Column:
    """Stand-in build check for tables without a compiler log: the kernel text
    has as many ``{`` as ``}`` and defines a ``__global__`` function."""
    k = _c(kernel)
    opens = F.length(k) - F.length(F.replace(k, F.lit("{"), F.lit("")))
    closes = F.length(k) - F.length(F.replace(k, F.lit("}"), F.lit("")))
    return F.coalesce((opens == closes) & k.contains("__global__"), F.lit(False))


def stage_and_reward(has_text, has_hip, compile_ok, verdict, partial_r, profile_ok, speed_r) -> Column:
    """struct(stage, reward) following the evaluation ladder."""
    v = _c(verdict)
    r1 = _c(partial_r)
    ladder = (F.when(~F.coalesce(_c(has_text), F.lit(False)), F.struct(F.lit(None).cast("string"), F.lit(-1.0)))
              .when(~F.coalesce(_c(has_hip), F.lit(False)), F.struct(F.lit(NO_CODE), F.lit(-1.0)))
              .when(~F.coalesce(_c(compile_ok), F.lit(False)), F.struct(F.lit(COMPILE_ERROR), F.lit(-0.5)))
              .when(F.coalesce(v, F.lit("FAIL")) != "PASS",
                    F.struct(F.when(r1 > 0, F.lit(VERIFY_PARTIAL)).otherwise(F.lit(VERIFY_ERROR)), r1))
              .when(~F.coalesce(_c(profile_ok), F.lit(False)), F.struct(F.lit(PROFILE_ERROR), F.lit(1.0)))
              .otherwise(F.struct(F.lit(PROFILED), _c(speed_r))))
    return ladder.cast("struct<stage:string,reward:double>")


def finalise(reward, evaluated, key: Column, noise: float = 0.01, seed: int = 0) -> Column:
    """``max(reward, -1)``, then uniform noise in [-noise, noise] for evaluated
    rows only.

    The noise is drawn from the row's key, not a random generator: the first 13
    hex digits of ``md5('<seed>|<key>')`` give a 52-bit integer, exact as a
    double, scaled to [0, 1). Reruns and retried tasks give the same value, and
    plain SQL can compute it too. ``key`` is a string column."""
    base = F.greatest(_c(reward), F.lit(DEFAULT_REWARD))
    if noise == 0:
        return base
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    return F.when(F.coalesce(_c(evaluated), F.lit(False)), base + F.lit(noise) * (u * 2 - 1)).otherwise(base)


def first_user_source(turns: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Per prompt the python code of the first user message (by turn) that
    has a python fence; ``min_by`` is a partial aggregate, safe for hot keys."""
    code = python_source("content")
    return (turns.where(F.col("role") == "user").withColumn("_code", code).where(F.col("_code").isNotNull())
            .groupBy(key).agg(F.min_by("_code", "turn").alias("model_code")))


def first_user_source_of(messages) -> Column:
    """W1 on a ``messages`` array: the python code of its first user message that has a python fence, else null."""
    source = F.transform(F.filter(_c(messages), lambda m: m["role"] == "user"), lambda m: python_source(m["content"]))
    return F.get(F.filter(source, lambda c: c.isNotNull()), 0)


def completion_text(completion, dtype: T.DataType) -> Column:
    """A completion's text: a message list counts with its last message."""
    c = _c(completion)
    return F.try_element_at(c, F.lit(-1))["content"] if isinstance(dtype, T.ArrayType) else c


def pair_completions(completions: DataFrame, prompts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Align each completion with its prompt (left equi join, so completions
    without a prompt stay and later score the default)."""
    return completions.join(prompts, key, "left")


def fill_missing(tasks: DataFrame, results: DataFrame, keys: list[str], default: float = DEFAULT_REWARD
                 ) -> DataFrame:
    """Every task row gets exactly one score; tasks without a result get
    ``default``, and of several results of one key the lowest reward counts."""
    r = results.groupBy(*keys).agg(F.min_by(F.struct("reward", "stage"), F.struct("reward", "stage")).alias("_x")).select(
        *keys, F.col("_x.reward").alias("_r"), F.col("_x.stage").alias("_s"))
    return (join_null_safe(tasks, r, keys, "left")
            .withColumn("reward", F.coalesce("_r", F.lit(default))).withColumn("stage", F.col("_s"))
            .drop("_r", "_s"))


def score_rollouts(completions: DataFrame, prompt_turns: DataFrame, checks: DataFrame, timings: DataFrame,
                   builds: DataFrame | None = None, noise: float = 0.0, seed: int = 0, n_checks: int = 5,
                   warmup: int = 5, iters: int = 10, key: str = "prompt_id", durations: DataFrame | None = None,
                   limits: dict[str, float] | None = None) -> DataFrame:
    """J6 -> F1 -> W1/X5 -> X4 -> build -> A1 -> A3/A4 -> R3 -> R4 -> J5.

    ``completions``: (prompt_id, generation, completion); ``checks``: verify
    checks keyed by ``model_id`` (= prompt_id); ``timings``: per model timing
    rows; ``builds``: optional (prompt_id, generation, compile_ok), else the
    brace-balance stand-in; ``durations``: optional (prompt_id, generation,
    compile_s, verify_s, profile_s), held against ``limits``: a phase over its
    limit has failed, and a task over ``task_s`` in all gets the default. A
    completion may be a message list. Returns (prompt_id, generation, stage, reward)."""
    text = completion_text("completion", completions.schema["completion"].dataType)
    completions = completions.withColumn("completion", text)
    code = first_user_source(prompt_turns, key).select(key, (F.col("model_code") != "").alias("has_code"))
    # only flags go through the joins, never a completion's or a prompt's text
    tasks = completions.withColumn("_k", kernel_source("completion")).select(
        key, "generation", scorable("completion").alias("scorable"), F.col("_k")["has_hip"].alias("has_hip"),
        brace_balanced(F.col("_k")["kernel"]).alias("compile_ok"))
    if builds is not None:
        tasks = join_null_safe(tasks.drop("compile_ok"), builds, [key, "generation"], "left")
    over = {p: F.lit(False) for p in LIMITS}
    if durations is not None:
        most = LIMITS | (limits or {})
        phases = [p for p in LIMITS if p != "task_s"]
        took = durations.select(key, "generation", *(F.coalesce(p, F.lit(0.0)).alias(f"_{p}") for p in phases))
        tasks = join_null_safe(tasks, took, [key, "generation"], "left")
        over = {p: F.coalesce(F.col(f"_{p}") > most[p], F.lit(False)) for p in phases}
        over["task_s"] = F.coalesce(reduce(add, (F.col(f"_{p}") for p in phases)) > most["task_s"], F.lit(False))
    verify = roll_up_checks(checks, "model_id", n_checks).select(
        F.col("model_id").alias(key), "verdict", "avg_mse")
    prof = compare_variants(device_time(timings, warmup, iters)).select(
        F.col("model_id").alias(key), "eager_us", "compiled_us", "candidate_us")
    j = pair_completions(tasks, code, key).join(verify, key, "left").join(prof, key, "left")
    r1 = partial_reward(F.col("verdict") == "PARTIAL_PASS", F.col("verdict") == "SHAPE_OK", F.col("avg_mse"))
    profile_ok = F.col("eager_us").isNotNull() & F.col("compiled_us").isNotNull() & F.col("candidate_us").isNotNull()
    sr = stage_and_reward(F.col("scorable"), F.col("has_hip"), F.col("compile_ok") & ~over["compile_s"], F.when(~over["verify_s"], F.col("verdict")),
                          F.when(over["verify_s"], F.lit(0.0)).otherwise(r1), profile_ok & ~over["profile_s"],
                          speed_reward("eager_us", "compiled_us", "candidate_us"))
    evaluated = F.col("scorable") & F.coalesce("has_code", F.lit(False)) & ~over["task_s"]
    noisy = finalise(sr["reward"], F.lit(True), F.concat_ws("|", F.col(key), F.col("generation")), noise, seed)
    # J5 row by row: every completion is still here, so what was not evaluated takes the default in place
    return j.select(key, "generation", F.when(evaluated, noisy).otherwise(F.lit(DEFAULT_REWARD)).alias("reward"),
                    F.when(evaluated, sr["stage"]).alias("stage"))


def group_advantage(rewards: DataFrame, group: str = "prompt_id", reward: str = "reward", eps: float = EPS,
                    materialize: bool = False) -> DataFrame:
    """(reward - group mean) / (group sample stddev + eps); a single-row
    group gets 0. Statistics come from a ``groupBy`` joined back on the key.

    The input is used twice (statistics and rows). When it is an expensive job
    (e.g. the scoring job), ``materialize`` deals its rows out once, evenly, by
    all their columns: both uses read that one exchange, so the job runs once,
    nothing runs while the plan is built, and a hot group is not gathered."""
    if materialize:
        rewards = rewards.repartition(*(F.col(f"`{c}`") for c in rewards.columns))
    adv = F.when(F.col("_n") > 1, (F.col(reward) - F.col("_mean")) / (F.coalesce(F.col("_std"), F.lit(0.0))
                                                                      + F.lit(eps))).otherwise(F.lit(0.0))
    known = with_statistics(rewards, [group], F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std"), F.count(F.lit(1)).alias("_n"))
    return known.withColumn("advantage", adv).drop("_mean", "_std", "_n")


def with_reward(df: DataFrame, fns: list, weights: list[float] | None = None, out: str = "reward") -> DataFrame:
    """Combine pluggable reward functions (Columns, or callables taking the
    DataFrame's columns and returning a Column, e.g. pandas UDFs) into one
    weighted score."""
    weights = weights or [1.0] * len(fns)
    terms = [(f if isinstance(f, Column) else f()) * F.lit(float(w)) for f, w in zip(fns, weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)
