"""Exact quantiles by selection, the repeatable side table, and lazy advantage plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from rolloutlab.operators import history as H
from rolloutlab.plans.catalog import QUERIES
from rolloutlab.sources import samples as src


@pytest.mark.parametrize("width", [1.0, 64.0, 1e9])
def test_quantiles_equal_numpy(spark, width):
    rng = random.Random(4)
    rows = [(g, None if rng.random() < 0.05 else float(rng.choice([rng.randrange(-200, 2000), rng.random() * 50, 7])))
            for g in ["a", "b", None] for _ in range(400)] + [("one", 3.5), ("none", None)]
    ps = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: [r[p] for p in ps] for r in H.exact_quantiles(df, ["g"], "x", ps, width).collect()}
    assert got.keys() == {"a", "b", None, "one"}
    for g, cuts in got.items():
        values = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(cuts, np.quantile(values, list(ps.values())))


def test_lengths_by_group_and_overall(spark):
    rows = [(g, n, n % 3 > 0) for g, top in (("s", 10), ("t", 500), (None, 3)) for n in range(top)]
    df = spark.createDataFrame(rows, "stage string, length int, terminated boolean")
    for by in (["stage"], []):
        for r in H.completion_lengths(df, by=by or None).collect():
            values = [n for g, n, _ in rows if not by or g == r["stage"]]
            assert (r["n"], r["p50"], r["p90"]) == (len(values), pytest.approx(np.quantile(values, 0.5)), pytest.approx(np.quantile(values, 0.9)))
    assert H.completion_lengths(df.limit(0)).count() == 0
    p = H.completion_lengths(df, by=["stage"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in p


def test_a_repeated_run_leaves_the_same_side_table(spark, tmp_path):
    df = spark.range(20).withColumn("x", F.when(F.col("id") % 7 > 0, F.col("id")))
    for _ in range(2):
        good = src.quarantine(df, F.col("x") % 2 == 0, str(tmp_path), "first")
    assert sorted(r["id"] for r in good.collect()) == [i for i in range(20) if i % 7 and i % 2 == 0]
    src.quarantine(df.where("id < 3"), F.col("x").isNotNull(), str(tmp_path), "second")
    side = sorted((r["run_id"], r["id"]) for r in src.quarantined(spark, str(tmp_path), df.schema).collect())
    assert side == sorted([("first", i) for i in range(20) if not (i % 7 and i % 2 == 0)] + [("second", 0)])
    # rows of a run that did not get into the ledger do not count
    df.write.parquet(f"{tmp_path}/rows/run_id=broken")
    assert len(src.quarantined(spark, str(tmp_path), "id bigint, x bigint").collect()) == len(side)


def test_advantages_run_no_job_while_the_plan_is_built(spark):
    spark.sparkContext.setJobGroup("advantage-plan", "")
    QUERIES["group_advantage"](spark, SF_SMALL)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("advantage-plan")) == []
