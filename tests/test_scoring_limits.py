"""Time limits, message lists and the in-row pairing of nested values."""

from pyspark.sql import functions as F

from conftest import SF_MID
from rolloutlab.operators import checks as K
from rolloutlab.operators import rewards as R
from rolloutlab.plans.catalog import QUERIES

KERNEL = "```cpp\n__global__ void k() { }\n```\n```python\nload_inline()\n```"


def test_every_limit_has_its_stage(spark):
    ids = range(6)
    completions = spark.createDataFrame([(i, 0, [("assistant", "draft"), ("assistant", KERNEL)]) for i in ids],
                                        "prompt_id bigint, generation int, completion array<struct<role:string,content:string>>")
    turns = spark.createDataFrame([(i, 0, "user", "```python\nx = 1\n```") for i in ids], "prompt_id bigint, turn int, role string, content string")
    checks = spark.createDataFrame([(i, c, [1.0], [1.0]) for i in ids for c in range(5)], "model_id bigint, check_no int, actual array<double>, expected array<double>")
    plain = {r["prompt_id"]: (r["stage"], r["reward"]) for r in _score(spark, completions, turns, checks, None)}
    took = spark.createDataFrame([(1, 0, 91.0, 1.0, 1.0), (2, 0, 1.0, 31.0, 1.0), (3, 0, 1.0, 1.0, 61.0), (4, 0, 89.0, 29.0, 60.0), (5, 0, 90.0, 30.0, 60.5)],
                                 "prompt_id bigint, generation int, compile_s double, verify_s double, profile_s double")
    got = {r["prompt_id"]: (r["stage"], r["reward"]) for r in _score(spark, completions, turns, checks, took)}
    assert plain[0] == ("profiled", 3.0) and got[0] == got[4] == plain[0]                              # no row, and all within the limits
    assert got[1] == ("compile_error", -0.5) and got[2] == ("verify_error", 0.0) and got[3] == ("profile_error", 1.0)
    assert got[5] == (None, -1.0)                                    # the task as a whole took too long


def _score(spark, completions, turns, checks, durations):
    timings = spark.createDataFrame([(i, v, n, "cuda", t) for i in range(6) for v, t in (("eager", 10.0), ("compiled", 10.0), ("candidate", 5.0))
                                     for n in range(1, 16)], "model_id bigint, variant string, iteration int, device string, duration_us double")
    return R.score_rollouts(completions, turns, checks, timings, durations=durations).collect()


def test_a_row_of_the_query_reaches_the_missing_profile(spark):
    stages = {r["stage"] for r in QUERIES["score_with_limits"](spark, SF_MID).select("stage").distinct().collect()}
    assert "profile_error" in stages and None in stages


def test_first_user_source_of_a_message_list(spark):
    py = "```python\n{}\n```"
    lists = [(1, [("system", py.format("s")), ("user", "no code"), ("user", py.format("a")), ("user", py.format("b"))]), (2, [("assistant", py.format("c"))]),
             (3, []), (4, None)]
    df = spark.createDataFrame(lists, "id int, messages array<struct<role:string,content:string>>")
    assert {r["id"]: r["c"] for r in df.select("id", R.first_user_source_of("messages").alias("c")).collect()} == {1: "a", 2: None, 3: None, 4: None}


NESTED = "id int, v struct<x:array<array<double>>,m:map<string,double>,s:double>"


def test_pairs_in_the_row_equal_the_exploded_ones(spark):
    made = [(1, ([[1.0, 2.0], [3.0]], {"a": 1.0, "extra": 5.0}, 1.0)), (2, ([], {}, 2.0)), (3, (None, None, None)), (4, ([[1.0]], {"k": 2.0}, 3.0))]
    want = [(1, ([[1.0], [3.0, 4.0]], {"a": 1.001, "gone": 2.0}, 9.0)), (2, ([[7.0]], {}, 2.0)), (3, (None, None, None)), (5, ([[1.0]], {"k": 2.0}, 3.0))]
    a, e = spark.createDataFrame(made, NESTED), spark.createDataFrame(want, NESTED)
    old = K.pair_outputs(K.flatten_leaves(a, ["id"], "v"), K.flatten_leaves(e, ["id"], "v"), ["id"], False)
    new = K.pair_nested(a, e, ["id"], "v", False)
    columns = ["id", "path", "status", "actual", "expected", "allowed"]
    assert sorted(map(str, (tuple(r) for r in new.select(*columns).collect()))) == sorted(map(str, (tuple(r) for r in old.select(*columns).collect())))
    got = {r["id"]: tuple(r)[1:] for r in K.compare_nested(a, e, ["id"], "v").collect()}
    assert got == {1: (4, 2, 2, 3, False), 2: (1, 1, 0, 1, False), 3: (1, 0, 0, 0, False), 4: (0, 0, 3, 0, False), 5: (0, 3, 0, 0, False)}


def test_pairing_shuffles_keys_and_values_but_no_leaf(spark):
    p = QUERIES["compare_nested"](spark, SF_MID)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in p and p.count("Exchange hashpartitioning") <= 4


def test_tensor_checks_need_shape_at_every_level_and_type(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]], [[1.0, 2.0], [3.0, 4.0]], "f4"), (1, [[1.0, 2.0, 3.0], [4.0]], [[1.0, 2.0], [3.0, 4.0]], "f4"),
            (1, [[1.0, 2.0], [3.0, 4.0]], [[1.0, 2.0], [3.0, 4.0]], "f8"), (1, [[1.0, 2.0], [3.0, 6.0]], [[1.0, 2.0], [3.0, 4.0]], "f4")]
    df = spark.createDataFrame(rows, "model_id int, actual array<array<double>>, expected array<array<double>>, got string").withColumn("want", F.lit("f4"))
    out = K.check_outcomes(df, actual_dtype="got", expected_dtype="want").collect()
    assert [(r["shape_ok"], r["passed"], r["mse"]) for r in out] == [(True, True, None), (False, False, None), (False, False, None), (True, False, 1.0)]
