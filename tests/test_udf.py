"""Supervised row functions: errors, endless loops, hard exits and set-up."""

import os
import time

import pytest

from rolloutlab.operators.udf import safe_apply


def test_endless_loop_and_hard_exit_cost_only_their_rows(spark):
    def score(row):
        if row["id"] % 10 == 3:
            while True:
                pass
        if row["id"] % 10 == 5:
            os._exit(7)
        if row["id"] % 10 == 7:
            raise KeyError("gone")
        return row["id"] * 2

    began = time.time()
    got = {r["id"]: (r["score"], r["error"]) for r in safe_apply(spark.range(40).repartition(2), score, limit=0.5).collect()}
    assert time.time() - began < 60
    for i, (value, error) in got.items():
        want = {3: (-1.0, "TimeoutError: over 0.5 s"), 5: (-1.0, "ProcessError: exit code 7"), 7: (-1.0, "KeyError: 'gone'")}
        assert (value, error) == want.get(i % 10, (i * 2.0, None))


def test_setup_runs_once_per_worker_not_per_task(spark, tmp_path):
    def setup():
        with open(f"{tmp_path}/setups", "a") as f:
            f.write(f"{os.getpid()}\n")
        return 3

    def score(row, ctx):
        return ctx + row["id"]

    df = safe_apply(spark.range(64).repartition(32), score, setup=setup)
    assert sorted(r["score"] for r in df.collect()) == [3.0 + i for i in range(64)]
    starts = open(f"{tmp_path}/setups").read().split()
    assert len(starts) == len(set(starts)) <= 8                    # 32 tasks on 4 cores


def test_nulls_results_and_a_failing_setup(spark):
    df = spark.createDataFrame([(1, None), (2, "7.5"), (3, "x")], "id bigint, text string")
    got = {r["id"]: (r["score"], r["error"]) for r in safe_apply(df, lambda row: float(row["text"]), default=-2.0).collect()}
    assert got[2] == (7.5, None) and got[1][0] == got[3][0] == -2.0 and got[1][1].startswith("TypeError") and got[3][1].startswith("ValueError")
    with pytest.raises(Exception, match="setup failed: ZeroDivisionError"):
        safe_apply(spark.range(3), lambda row, ctx: 1.0, setup=lambda: 1 / 0).collect()


def test_empty_input(spark):
    assert safe_apply(spark.range(0), lambda row: 1.0).collect() == []
