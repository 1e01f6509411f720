"""Null keys, repeated rows, odd line ends and other inputs outside the tidy fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from rolloutlab.functions import text as T
from rolloutlab.functions import vectors as V
from rolloutlab.operators import matching as M
from rolloutlab.operators import matrix as MX
from rolloutlab.operators import prompts as P
from rolloutlab.operators import rewards as R
from rolloutlab.operators import sampling as D
from rolloutlab.operators.udf import safe_apply
from rolloutlab.plans.catalog import QUERIES

HIP = "**kernels/fused_kernel.hip**\n{}```cpp\n__global__ void k() {{}}\n```\n<END_OF_OUTPUT>"


@pytest.mark.parametrize("gap", ["", "\n", " \t\n\n", "\n" * 100_000])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_named_block_survives_blank_runs_and_line_ends(spark, gap, end):
    df = spark.createDataFrame([(HIP.format(gap).replace("\n", end),)], "c string")
    r = df.select(T.named_block(T.normalise_header("c")).alias("b"), T.kernel_source("c").alias("k")).first()
    assert r.b.found and r.b.body == "__global__ void k() {}" and r.k.has_hip


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 2), ("a", 1.0, None), ("a", 5.0, 4)], "g string, v double, o int")
    ranked = D.ranked_within(df, ["g"], F.col("o"), [F.col("o")])
    assert sorted(rows(ranked, "g", "v", "pos"), key=repr) == [("a", 1.0, 0), ("a", 5.0, 1), (None, 1.0, 0), (None, 2.0, 1)]
    soft = MX.softmax_rows(df, ["g"], "v")
    assert soft.count() == 4 and all(abs(r.s - 1) < 1e-12 for r in soft.groupBy("g").agg(F.sum("softmax").alias("s")).collect())
    adv = R.group_advantage(df.withColumnRenamed("g", "prompt_id").withColumnRenamed("v", "reward"))
    assert adv.count() == 4
    assert MX.pool(df, ["g"], F.col("o"), [F.col("o")], "v", size=1).count() == 4


def test_fill_missing_gives_one_score_per_task(spark):
    tasks = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (None, 0)], "prompt_id long, generation int")
    results = spark.createDataFrame([(1, 0, 0.5, "a"), (1, 0, 0.2, "b"), (None, 0, 3.0, "c")],
                                    "prompt_id long, generation int, reward double, stage string")
    got = rows(R.fill_missing(tasks, results, ["prompt_id", "generation"]), "prompt_id", "reward", "stage")
    assert sorted(got, key=repr) == [(1, 0.2, "b"), (1, 0.2, "b"), (2, -1.0, None), (None, 3.0, "c")]


def test_group_norm_refuses_a_rest(spark):
    ok = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    assert len(ok.select(V.group_norm(F.col("x"), 2)).first()[0]) == 4
    with pytest.raises(Exception, match="not a multiple"):
        spark.createDataFrame([([1.0] * 10,)], "x array<double>").select(V.group_norm(F.col("x"), 4)).collect()


def test_reciprocal_of_signed_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (4.0,)], "x double")
    assert [r[0] for r in df.select(V.reciprocal(F.col("x"))).collect()] == [math.inf, -math.inf, 0.25]


def test_models_without_float_tensors_have_an_empty_spec(spark):
    t = spark.createDataFrame([(1, 0, "a", "int64", [1]), (2, 0, "b.c", "float32", [2, 3])],
                              "model_id long, ord int, name string, dtype string, shape array<int>")
    got = {r.model_id: (r.n_float, r.weight_info) for r in P.render_weight_spec(t).collect()}
    assert got[1] == (0, "") and got[2][0] == 1 and "b_c" in got[2][1]


def test_error_text_is_whole(spark):
    def fail(row):
        raise ValueError("x" * 3000)
    assert len(safe_apply(spark.range(1), fail).first().error) == 3000 + len("ValueError: ")


def test_a_large_dictionary_is_not_refused():
    assert M.key_lookup(entries=[(f"op{i}", f"k{i}") for i in range(6000)]) is not None


def test_a_key_without_a_snippet(spark):
    s = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "sample_id long, ops array<string>")
    d = spark.createDataFrame([(0, "a", "ka"), (1, "b", "kb")], "ord int, map_op string, key string")
    sn = spark.createDataFrame([("ka", "text a")], "key string, snippet string")
    strict = {r.sample_id: (r.ref_keys, r.ref_text) for r in M.reference_text_join(s, d, sn).collect()}
    loose = {r.sample_id: (r.ref_keys, r.ref_text) for r in M.reference_text_join(s, d, sn, require_available=False).collect()}
    assert strict == {1: ("ka", "text a")} and loose == {1: ("ka,kb", "text a\n\n"), 2: ("kb", "")}


def test_scoring_shuffles_no_text(spark):
    import re
    plan = QUERIES["score_rollouts"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Join" in line:
            assert not re.search(r"\b(completion|content|model_code)#", line)


def test_building_a_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    for name in ("exact_split", "batch_norm", "prepare_prompts", "read_chat"):
        QUERIES[name](spark, SF_SMALL)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_equal_by_rule(spark):
    from rolloutlab.operators import checks as K
    schema = "i int, a struct<t:array<array<double>>,s:string,x:double,m:map<string,double>,l:array<string>>, e struct<t:array<array<double>>,s:string,x:double,m:map<string,double>,l:array<string>>"
    base = ([[1.0, 2.0], [3.0, 4.0]], "s", 1.0, {"k": 1.0}, ["a"])
    def but(**kw):
        return tuple(kw.get(n, v) for n, v in zip("tsxml", base))
    cases = [(base, True), (but(t=[[1.005, 2.0], [3.0, 4.0]]), True), (but(t=[[1.5, 2.0], [3.0, 4.0]]), False), (but(t=[[1.0], [3.0]]), False),
             (but(x=1.005), False), (but(s="t"), False), (but(m={"k": 1.0, "more": 2.0}), True), (but(m={"other": 1.0}), False),
             (but(l=["a", "b"]), False), (but(l=None), False), (but(t=[[float("nan"), 2.0], [3.0, 4.0]]), False)]
    df = spark.createDataFrame([(i, c, base) for i, (c, _) in enumerate(cases)], schema)
    t = df.schema["a"].dataType
    got = {r.i: r.ok for r in df.select("i", K.equal_by_rule(F.col("a"), F.col("e"), t).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [ok for _, ok in cases]
    with pytest.raises(TypeError):
        K.equal_by_rule(F.col("a.s"), F.col("a.x"), t["s"].dataType, t["x"].dataType)
    shapes = df.select("i", K.same_shape(F.col("a.t"), F.col("e.t"), t["t"].dataType).alias("ok")).collect()
    assert [r.ok for r in sorted(shapes)] == [c[0] is not None and [len(x) for x in c[0]] == [2, 2] for c, _ in cases]


def test_streams_over_many_files_equal_batch(spark, tmp_path):
    """Four files out of time order, one per trigger, as a folder: the report equals the batch result."""
    from rolloutlab.streaming import jobs as ST
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder = tmp_path / "events.parquet"
    for i in (3, 0, 2, 1):
        ev.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(str(folder))
    out = ST.stream_scores(ST.rollouts_from_events(ST.event_stream(spark, str(tmp_path), max_files=1)))
    batch = (ST.rollouts_from_events(ev.withColumn("ts", F.col("ts").cast("timestamp")))
             .groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage")
             .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 9).alias("m")))
    got = out.select("window_start", "stage", "n", F.round("mean_reward", 9).alias("m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.agg(F.sum("n")).first()[0] == ev.count()


def test_an_event_in_two_files_counts_once(spark, tmp_path):
    """Every event again in a second file of a later trigger, and events without an id."""
    from rolloutlab.streaming import jobs as ST
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").limit(500).cache()
    loose = ev.limit(3).withColumn("event_id", F.lit(None).cast("bigint")).withColumn("event_type", F.lit("view"))
    for part in (ev, ev, loose):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))

    def report(files):
        out = ST.stream_scores(ST.rollouts_from_events(ST.event_stream(spark, str(tmp_path), max_files=files)))
        return sorted((r.window_start, r.stage, r.n, round(r.mean_reward, 9)) for r in out.collect())

    one_by_one = report(1)
    assert sum(r[2] for r in one_by_one) == 503 and one_by_one == report(None)
