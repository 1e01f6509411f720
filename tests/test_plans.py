"""Physical-plan properties the design relies on at scale."""

import re

import pytest

from conftest import SF_SMALL
from rolloutlab.plans.catalog import QUERIES


def plan(spark, name: str) -> str:
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def scans(p: str) -> list[str]:
    return re.findall(r"FileScan parquet \[([^\]]*)\]", p)


def test_flagship_shuffles_only_the_boundary_bucket_and_prunes_columns(spark):
    p = plan(spark, "prepare_prompts")
    assert "Join" not in p
    for line in p.splitlines():            # counts per bucket, and the one bucket that holds the split's boundary
        if "Exchange" in line:
            assert "hashpartitioning(_b#" in line or "SinglePartition" in line or "hashpartitioning(0," in line, line
    for cols in scans(p):
        assert "lang" not in cols and "n_chars" not in cols


def test_reference_text_is_row_local(spark):
    p = plan(spark, "reference_text")
    assert "Exchange" not in p and "Join" not in p


def test_fuzzy_join_broadcasts_only_the_dictionary(spark):
    p = plan(spark, "match_fuzzy")
    assert "BroadcastNestedLoopJoin" in p
    # the nested-loop join builds (broadcasts) the dictionary side: the right
    # child, whose only source is the dictionary rows, never a parquet scan
    line = next(x for x in p.splitlines() if "BroadcastNestedLoopJoin" in x)
    assert "BuildRight" in line
    right = p.split("BroadcastExchange IdentityBroadcastMode")[1]
    assert "map_op" in right and "FileScan" not in right.split("Exchange")[0]


def test_keep_latest_limits_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "keep_latest")


@pytest.mark.parametrize("name", ["group_advantage", "roll_up_checks", "render_weight_spec"])
def test_group_statistics_use_aggregation_not_windows(spark, name):
    p = plan(spark, name)
    assert "HashAggregate" in p
    if name != "group_advantage":
        assert "Window" not in p


@pytest.mark.parametrize("name", ["layer_norm", "softmax", "group_norm", "vec_gelu"])
def test_vector_math_does_not_explode(spark, name):
    p = plan(spark, name)
    assert "Generate" not in p


def test_no_cartesian_products_anywhere(spark):
    skip = {"stream_scores", "stream_timeout_join", "stream_trajectory", "write_split", "quarantine"}
    for name in sorted(set(QUERIES) - skip):
        p = plan(spark, name)
        assert "CartesianProduct" not in p, name
        if "BroadcastNestedLoopJoin" in p:
            assert name in {"match_fuzzy", "attach_snippets", "reference_text_join", "curriculum"}, name


@pytest.mark.parametrize("name,exchanges,reads", [("trajectory", 4, 2), ("softmax_rows", 4, 4), ("prepare_prompts", 3, 3)])
def test_shuffles_and_scans_without_broadcasts(spark, name, exchanges, reads):
    """Shuffles planned, and scans outside the split's boundary (one subquery, which all its places share) plus its own."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    boundary = set(re.findall(r"Subquery (subquery#\d+), \[id=#\d+\]\n", p))
    assert len(boundary) <= 1
    copies = len(re.findall(r"\+- Subquery subquery#", p))
    inside = 1 if copies else 0                       # a boundary has one scan and one shuffle of its own
    assert len(scans(p)) - copies * inside + inside <= reads
    assert len(re.findall(r"Exchange hashpartitioning", p)) - copies * inside + inside <= exchanges
