"""Hand-written edge cases per operator."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from rolloutlab.dictionaries import op_dictionary, snippet_table
from rolloutlab.functions import text as TX
from rolloutlab.functions import vectors as V
from rolloutlab.operators import checks as K
from rolloutlab.operators import extraction as X
from rolloutlab.operators import matching as M
from rolloutlab.operators import matrix as MX
from rolloutlab.operators import rewards as R
from rolloutlab.operators import sampling as D
from rolloutlab.operators.udf import safe_apply
from rolloutlab.sources import fixtures as fx
from rolloutlab.sources import samples as src

H = "**kernels/fused_kernel.hip**"

NAMED_CASES = [
    (f"{H}\n```cpp\nA\nB\n```\n", True, "A\nB"),                                  # plain
    (f"  {H}  \n\n  \n   ```cpp\nA\n  ```", True, "A"),                            # blank lines, indents
    (f"{H}\n```\nA\nB\n", True, "A\nB"),                                          # unterminated
    (f"{H}\n```cpp\n```", True, ""),                                              # empty body
    (f"{H}\n```cpp", True, ""),                                                   # fence at end of text
    (f"{H}\ntext\n```cpp\nA\n```", False, ""),                                    # header without fence
    (f"{H}\nnope\n{H}\n```\nB\n```", True, "B"),                                  # later valid header
    (f"{H}\n```\nA\n```\n{H}\n```\nB\n```", True, "A"),                           # two blocks
    ("```cpp\nA\n```", False, ""),                                                # no header
    (f"{H}\n```\nA\n\n", True, "A\n"),                                            # trailing blank line
]


def test_named_block_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NAMED_CASES)], "i int, t string")
    got = {r["i"]: (r["f"], r["b"]) for r in df.select("i", TX.named_block("t")["found"].alias("f"),
                                                         TX.named_block("t")["body"].alias("b")).collect()}
    for i, (_, found, body) in enumerate(NAMED_CASES):
        assert got[i] == (found, body), (i, got[i])


def test_normalise_header(spark):
    df = spark.createDataFrame([("### kernels/fused_kernel.hip:",), ("`fused_kernel.hip`",),
                                ("**fused_kernel.hip** (v2)",), ("x\n- kernels/fused_kernel.hip\ny",)], "t string")
    got = [r[0] for r in df.select(TX.normalise_header("t")).collect()]
    assert got == [H, H, "**fused_kernel.hip** (v2)", f"x\n{H}\ny"]


def test_kernel_source_fallback(spark):
    df = spark.createDataFrame([("```python\nx\n```\n```hip\n__global__ void k()\n```",),
                                ("```cpp\nint main() {}\n```",),
                                ("```c++\n__global__ void k()\n```",)], "t string")
    got = [(r["k"]["has_hip"], r["k"]["kernel"]) for r in df.select(TX.kernel_source("t").alias("k")).collect()]
    # "c++" cannot be matched by the language pattern (word characters only)
    assert got == [(True, "__global__ void k()"), (False, None), (False, None)]


LAUNCH = "void launch_fused_kernel(float* output, const float* input, int size{x})"


@pytest.mark.parametrize("extra,expected", [
    (", float alpha, hipStream_t stream", [(0, "float", "alpha")]),
    (", const float * w, unsigned int n, hipStream_t stream", [(0, "const float *", "w"), (1, "unsigned int", "n")]),
    (", custom_t q, hipStream_t stream", []),
    (", hipStream_t stream", []),
    (", float alpha", []),
])
def test_signature_params(spark, extra, expected):
    df = spark.createDataFrame([(LAUNCH.format(x=extra),)], "t string")
    got = [(p["pos"], p["ctype"], p["name"]) for p in df.select(X.signature_params("t").alias("p")).first()["p"]]
    assert got == expected


def test_size_marker_is_case_insensitive_and_last_wins(spark):
    t = "void launch_fused_kernel(int size, float* w, int batch_SIZE, bool flag, hipStream_t s)"
    df = spark.createDataFrame([(t,)], "t string")
    got = [(p["ctype"], p["name"]) for p in df.select(X.signature_params("t").alias("p")).first()["p"]]
    assert got == [("bool", "flag")]


def test_init_params_and_arity(spark):
    df = spark.createDataFrame([("def __init__(self, a: int = 3, b=2, *, c):", 3), ("def __init__(self):", 2),
                                ("def __init__(self, a):", 0)], "m string, n int")
    ext = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda x: x.cast("string"))
    ext = F.when(F.col("n") > 0, ext).otherwise(F.array().cast("array<string>"))
    out = df.select(TX.init_params("m").alias("names"), X.arity_check(ext, TX.init_params("m")).alias("a")).collect()
    assert out[0]["names"] == ["a", "b", "*", "c"]
    assert out[0]["a"]["rejected"] is True           # 4 names vs 3 kernel parameters
    assert out[1]["names"] == [] and out[1]["a"]["args"] == []
    assert out[2]["a"]["rejected"] is False and out[2]["a"]["args"] == []


def test_truncate_and_predicates(spark):
    df = spark.createDataFrame([("abc<END_OF_OUTPUT>def",), ("x\n}\ny<END_OF_OUTPUT>",), ("none",), (None,)],
                               "t string")
    inc = df.select(TX.truncate_at_stop("t", ["<END_OF_OUTPUT>", "\n}\n"]).alias("r")).collect()
    exc = df.select(TX.truncate_at_stop("t", ["<END_OF_OUTPUT>"], include_stop=False).alias("r")).collect()
    assert [(r["r"]["text"], r["r"]["terminated"]) for r in inc] == [
        ("abc<END_OF_OUTPUT>", True), ("x\n}\n", True), ("none", False), (None, False)]
    assert exc[0]["r"]["text"] == "abc"
    sc = [r[0] for r in df.select(TX.scorable("t")).collect()]
    assert sc == [True, True, False, False]     # the second text is exactly 20 characters


def test_normalise_ops(spark):
    df = spark.createDataFrame([('["a","b"]',), ("relu",), ("",), (None,), ("[bad",)], "o string")
    got = [r[0] for r in df.select(TX.normalise_ops("o")).collect()]
    assert got == [["a", "b"], ["relu"], [], [], None]


def test_close_nan_inf_and_shape(spark):
    nan, inf = float("nan"), float("inf")
    data = [([1.0, nan], [1.0, nan]), ([inf], [inf]), ([1.0], [1.015]), ([0.0], [0.011]), ([1.0], [1.0, 2.0])]
    df = spark.createDataFrame(data, "a array<double>, e array<double>")
    assert [r[0] for r in df.select(K.close("a", "e")).collect()] == [False, True, True, False, False]
    assert [r[0] for r in df.select(K.shape_ok("a", "e")).collect()] == [True, True, True, True, False]


def test_element_rules(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (2.0,)], "x double")
    out = df.select(V.reciprocal(F.col("x")).alias("r"), V.log(F.col("x")).alias("l"), V.relu(F.col("x")).alias("u"),
                    V.sign(F.col("x")).alias("s")).collect()
    assert out[0]["r"] == math.inf and out[0]["l"] == -math.inf
    assert math.isnan(out[1]["l"]) and out[2]["u"] == 0.0 and out[2]["s"] == 0.0
    assert out[3]["r"] == 0.5 and out[3]["s"] == 1.0


def test_gelu_against_math_erf(spark):
    xs = [-3.0, -1.0, -0.1, 0.0, 0.4, 2.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(V.gelu(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert abs(g - 0.5 * x * (1 + math.erf(x / math.sqrt(2)))) < 1e-6


def test_exact_split_is_exact_and_partition_invariant(spark):
    base = fx.v_samples(spark, SF_SMALL).select("sample_id")
    n = base.count()
    results = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        results.append(sorted(rows(D.ranked_split(base, 0.29), "sample_id", "split", "rank")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    r = results[0]
    # the threshold form (no shuffle of the rows) gives the same split
    thr = sorted(rows(D.exact_split(base, 0.29), "sample_id", "split"))
    assert thr == [(a, b) for a, b, _ in r]
    assert len(r) == n and len({x[0] for x in r}) == n
    assert sum(1 for x in r if x[1] == "val") == math.floor(n * 0.29)
    assert sorted(x[2] for x in r) == list(range(1, n + 1))


def test_reference_text_forms_agree(spark):
    s = fx.v_samples(spark, SF_SMALL).withColumn("ops", TX.normalise_ops("ops_raw"))
    local = {r["sample_id"]: (r["ref_keys"], r["ref_text"]) for r in M.reference_text(s).collect() if r["n_ref"] > 0}
    join = {r["sample_id"]: (r["ref_keys"], r["ref_text"])
            for r in M.reference_text_join(s, op_dictionary(spark), snippet_table(spark)).collect()}
    assert local == join and len(local) > 0


def test_empty_op_matches_first_entry(spark):
    df = spark.createDataFrame([(1, [""]), (2, ["zzz"])], "sample_id long, ops array<string>")
    got = {r["sample_id"]: r["ref_keys"] for r in M.reference_text(df).collect()}
    assert got == {1: "_act_relu", 2: ""}


def test_noise_is_bounded_and_deterministic(spark):
    sf = SF_SMALL
    args = (fx.v_completions(spark, sf), fx.v_prompt_turns(spark, sf), fx.v_checks(spark, sf), fx.v_timings(spark, sf))
    clean = {(r[0], r[1]): r["reward"] for r in R.score_rollouts(*args).collect()}
    noisy = R.score_rollouts(*args, noise=0.01, seed=3)
    n1 = {(r[0], r[1]): r["reward"] for r in noisy.collect()}
    n2 = {(r[0], r[1]): r["reward"] for r in noisy.collect()}
    assert n1 == n2
    for k, v in clean.items():
        assert abs(n1[k] - v) <= 0.01 + 1e-12
        assert -1.01 <= n1[k] <= 3.01


def test_safe_apply_isolates_failures(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "fine")], "id long, t string")

    def fn(row):
        if row["t"] == "boom":
            raise RuntimeError("bad row")
        return len(row["t"])
    got = {r["id"]: (r["score"], r["error"]) for r in safe_apply(df, fn).collect()}
    assert got[1] == (2.0, None) and got[3] == (4.0, None)
    assert got[2][0] == -1.0 and "bad row" in got[2][1]


@pytest.mark.parametrize("digits", [1, 3, 5])
def test_exact_split_equals_the_ranked_split(spark, digits):
    base = spark.range(5000).withColumnRenamed("id", "sample_id")
    a = sorted(rows(D.exact_split(base, 0.37, digits=digits), "sample_id", "split"))
    b = sorted(rows(D.ranked_split(base, 0.37), "sample_id", "split"))
    assert a == b and sum(1 for x in a if x[1] == "val") == int(5000 * 0.37)


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.67, 1.0])
def test_exact_split_counts_null_and_repeated_ids(spark, ratio):
    ids = [(None, i) for i in range(7)] + [(1, i) for i in range(20)] + [(i, 0) for i in range(2, 15)]
    df = spark.createDataFrame(ids, "sample_id long, x int")
    out = rows(D.exact_split(df, ratio), "sample_id", "x", "split")
    assert len(out) == 40 and sum(r[2] == "val" for r in out) == int(40 * ratio)
    assert D.exact_split(df.limit(0), ratio).count() == 0


def test_write_split_with_empty_split(spark, tmp_path):
    df = spark.range(20).withColumnRenamed("id", "sample_id")
    out = str(tmp_path / "split")
    src.write_split(D.exact_split(df, 0.0).select("sample_id", "split"), out)
    back = spark.read.parquet(out)
    assert back.count() == 20 and {r[0] for r in back.select("split").distinct().collect()} == {"train"}


def test_ranked_within_matches_row_number(spark):
    from pyspark.sql.window import Window
    s = fx.v_series(spark, SF_SMALL)
    r = MX.ranked_within(s, ["series_id"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("seq")])
    w = Window.partitionBy("series_id").orderBy("ts", "seq")
    ref = s.withColumn("rn", F.row_number().over(w) - 1)
    a = sorted(rows(r, "seq", "pos"))
    b = sorted(rows(ref, "seq", "rn"))
    assert a == b


def test_group_advantage_single_row_group(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "prompt_id long, reward double")
    got = {(r["prompt_id"], r["reward"]): r["advantage"] for r in R.group_advantage(df).collect()}
    assert got[(2, 5.0)] == 0.0
    assert got[(1, 3.0)] == pytest.approx(1.0 / (math.sqrt(2.0) + 1e-4))


def test_map_leaves_keeps_shape(spark):
    df = spark.createDataFrame([([1.0, 2.0], {"a": 3.0}, 4)], "arr array<double>, m map<string,double>, i int")
    n = df.select(F.struct("arr", "m", "i").alias("n"))
    out = n.select(K.map_leaves(F.col("n"), n.schema["n"].dataType, lambda x: x * 10).alias("o")).first()["o"]
    assert out["arr"] == [10.0, 20.0] and out["m"] == {"a": 30.0} and out["i"] == 40




def test_trajectory_chunked_numbering_and_stop_rules(spark):
    from rolloutlab.operators import history as HI
    data = ([(1, t, 0.0, "code") for t in range(1, 10)]                       # stops at the cap (iteration 4)
            + [(2, t, 0.0, "") for t in range(1, 12)]                         # empty text never stops
            + [(3, 1, 0.0, "code"), (3, 2, 3.0, "code"), (3, 3, 3.0, "code")]  # stops on reward at 2
            + [(4, t, 0.0, "" if t in (4, 5) else "code") for t in range(1, 8)])  # cap lands on empties
    df = spark.createDataFrame(data, "conv_id long, turn long, reward double, text string")
    cols = ("conv_id", "turn", "iteration", "should_stop")
    chunked = sorted(rows(HI.trajectory(df, max_iterations=4, turn_chunk=3), *cols))
    windowed = sorted(rows(HI.trajectory(df, max_iterations=4, turn_chunk=None), *cols))
    assert chunked == windowed
    by = {}
    for c, t, i, s in chunked:
        by.setdefault(c, []).append((t, i, s))
    assert by[1] == [(1, 1, False), (2, 2, False), (3, 3, False), (4, 4, True)]
    assert len(by[2]) == 11 and not any(s for _, _, s in by[2])
    assert by[3] == [(1, 1, False), (2, 2, True)]
    assert by[4][-1] == (6, 6, True) and len(by[4]) == 6


def test_spikes_chunking_is_exact(spark):
    from rolloutlab.operators import history as HI
    log = fx.v_rollouts(spark, SF_SMALL)
    cols = ("run_id", "step", "value", "trailing_mean", "is_spike", "recovery_steps")
    one = sorted(rows(HI.spikes(log, factor=1.5, window=5, max_recovery=4), *cols))
    small = sorted(rows(HI.spikes(log, factor=1.5, window=5, max_recovery=4, chunk_rows=7), *cols))
    assert one == small and len(one) > 0


def test_xxhash_split(spark):
    base = spark.range(3000).withColumnRenamed("id", "sample_id")
    a = sorted(rows(D.exact_split(base, 0.2, method="xxhash64"), "sample_id", "split"))
    b = sorted(rows(D.ranked_split(base, 0.2, method="xxhash64"), "sample_id", "split"))
    assert a == b and sum(1 for x in a if x[1] == "val") == 600


def test_trajectory_timestamp_turns_are_chunked(spark):
    from rolloutlab.operators import history as HI
    ev = fx.v_rollouts(spark, SF_SMALL).select(
        (F.col("run_id")).alias("conv_id"), F.col("ts").alias("turn"), "reward",
        F.when(F.col("stage") == "no_code", F.lit("")).otherwise(F.lit("code")).alias("text"))
    ev = ev.dropDuplicates(["conv_id", "turn"])
    cols = ("conv_id", "turn", "iteration", "should_stop")
    a = sorted(rows(HI.trajectory(ev, max_iterations=20), *cols))
    b = sorted(rows(HI.trajectory(ev, max_iterations=20, turn_chunk=None), *cols))
    assert a == b and len(a) > 0


def test_trajectory_equals_a_plain_walk(spark):
    """Gaps, null conversations, empty texts, turns without a value, and a conversation with most of the rows."""
    import random

    from rolloutlab.operators import history as HI
    rng = random.Random(4)
    data = []
    for conv, size in [("hot", 600), (None, 40), ("never", 50), ("short", 3)] + [(f"c{i}", rng.randint(1, 30)) for i in range(25)]:
        for turn in rng.sample(range(-50, 5 * size), size):
            r = rng.choice([0.0, 0.5, 1.0, None]) if conv in ("hot", "never") else rng.choice([0.0, 1.0, 3.0, None])
            data.append((conv, turn, r, "" if conv == "never" else rng.choice(["x", "x", "", None])))
    data.append(("never", None, 3.0, "x"))
    want = []
    for conv in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == conv), key=lambda d: (d[1] is not None, d[1] or 0))
        stop = next((t for i, (_, t, r, x) in enumerate(mine, 1) if x and t is not None and ((r or 0) >= 3.0 or i >= 7)), None)
        want += [(conv, t, i, stop is not None and t == stop) for i, (_, t, _, _) in enumerate(mine, 1)
                 if stop is None or (t is not None and t <= stop)]
    df = spark.createDataFrame(data, "conv_id string, turn long, reward double, text string").repartition(5)
    for chunk in (5, 64, 4096, None):
        got = rows(HI.trajectory(df, max_iterations=7, turn_chunk=chunk), "conv_id", "turn", "iteration", "should_stop")
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_keys_of_any_type_join_their_nulls(spark):
    from rolloutlab.operators.joins import with_statistics
    for kind, values in [("string", ["", "a", None]), ("double", [0.0, 1.5, None]), ("date", ["1970-01-01", "2020-01-02", None]),
                         ("timestamp", ["1970-01-01 00:00:00", None]), ("boolean", [False, True, None]), ("binary", [b"", b"x", None]),
                         ("decimal(9,2)", [0, 3, None]), ("array<int>", [[], [1], None]), ("struct<a:int,b:string>", [(0, ""), (None, None), None])]:
        plain = kind.startswith(("date", "timestamp", "decimal"))
        df = spark.createDataFrame([(str(v) if plain and v is not None else v, i) for i, v in enumerate(values * 3)],
                                   f"k {'string' if plain else kind}, i int").withColumn("k", F.col("k").cast(kind))
        got = with_statistics(df, ["k"], F.count(F.lit(1)).alias("n")).collect()
        assert [r.n for r in got] == [3] * len(values) * 3, kind
