"""Streaming jobs against batch brute force: one run, and runs that continue over files in any order."""

from datetime import timedelta

import duckdb
import pytest

from conftest import SF_SMALL
from rolloutlab.operators import history as H
from rolloutlab.streaming import jobs as ST

EVENTS = f"{SF_SMALL}/events.parquet"


def feed(folder, name, where):
    """Add a file of some events to the folder that the streams watch."""
    path = folder / "events.parquet"
    path.mkdir(exist_ok=True)
    duckdb.execute(f"COPY (SELECT * FROM '{EVENTS}' WHERE {where}) TO '{path}/{name}.parquet' (FORMAT parquet)")


def expected_pairs(within=timedelta(hours=6)):
    ev = duckdb.execute(f"SELECT event_id, ts, user_id, event_type, value FROM '{EVENTS}'").fetchall()
    views = {}
    for e in ev:
        if e[3] == "view":
            views.setdefault(e[2], []).append(e)
    out = {}
    for cid, cts, cu, kind, _ in ev:
        if kind == "click":
            cand = sorted((v[1], v[0], v[4]) for v in views.get(cu, ()) if cts <= v[1] <= cts + within)
            out[cid] = (cand[0][1], round(min(0.8, max(0.05, 0.8 / (1 + cand[0][2] ** 0.5))), 9)) if cand else (None, -1.0)
    return out


def pairs(df):
    rows = df.collect()
    assert len({r["sub_id"] for r in rows}) == len(rows)          # nothing comes out twice
    return {r["sub_id"]: (r["res_id"], round(r["reward"], 9)) for r in rows}


# by time, newest first, and dealt at random
SPLITS = {"in order": ["ts < TIMESTAMP '2024-01-10'", "ts >= TIMESTAMP '2024-01-10'"],
          "newest first": ["ts >= TIMESTAMP '2024-01-15'", "ts < TIMESTAMP '2024-01-05'", "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'"],
          "at random": [f"hash(event_id) % 3 = {k}" for k in range(3)]}


@pytest.mark.parametrize("order", SPLITS)
def test_timeout_join_continues_over_files(spark, tmp_path, order):
    want = expected_pairs()
    for k, where in enumerate(SPLITS[order]):
        feed(tmp_path, f"part-{k}", where)
        ev = ST.event_stream(spark, str(tmp_path), max_files=1)
        df = ST.stream_timeout_join(ST.submissions(ev), ST.results(ev), out=f"{tmp_path}/out", checkpoint=f"{tmp_path}/state")
        got = pairs(df)
    assert got == want
    emitted = [r["sub_id"] for r in spark.read.parquet(f"{tmp_path}/out/decided").collect()]
    assert len(emitted) == len(set(emitted)) and set(emitted) <= set(want)
    if order == "newest first":                                    # the older files are behind the watermark
        assert df.where("late").count() > 0


def test_timeout_join_without_finalising_leaves_only_the_tail(spark):
    ev = ST.event_stream(spark, SF_SMALL)
    got = pairs(ST.stream_timeout_join(ST.submissions(ev), ST.results(ev), finalise=False))
    want = expected_pairs()
    assert all(want[k] == v for k, v in got.items())
    ts = dict(duckdb.execute(f"SELECT event_id, ts FROM '{EVENTS}'").fetchall())
    newest = max(ts.values())
    assert all(ts[m] > newest - timedelta(hours=8) for m in set(want) - set(got))


@pytest.mark.parametrize("order", SPLITS)
def test_trajectory_continues_and_equals_the_batch_operator(spark, tmp_path, order):
    batch = ST.turns(spark.read.schema(ST.EVENT_SCHEMA).parquet(EVENTS))
    columns = ["conv_id", "turn", "reward", "text", "iteration", "should_stop"]
    want = sorted(tuple(r) for r in H.trajectory(batch, max_iterations=3).select(*columns).collect())
    for k, where in enumerate(SPLITS[order]):
        feed(tmp_path, f"part-{k}", where)
        df = ST.stream_trajectory(ST.turns(ST.event_stream(spark, str(tmp_path), max_files=1)), max_iterations=3, watermark="1000 days",
                                  out=f"{tmp_path}/out", checkpoint=f"{tmp_path}/state")
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want


def test_scores_continue_read_no_event_twice_and_count_ids_once(spark, tmp_path):
    def report():
        df = ST.stream_scores(ST.rollouts_from_events(ST.event_stream(spark, str(tmp_path), max_files=1)), out=f"{tmp_path}/out",
                              checkpoint=f"{tmp_path}/state")
        return {(r["window_start"], r["stage"]): (r["n"], round(r["mean_reward"], 9)) for r in df.collect()}

    feed(tmp_path, "part-0", "event_id % 2 = 0")
    report()
    feed(tmp_path, "part-1", "event_id % 3 = 0")                   # a sixth of the ids comes again
    feed(tmp_path, "part-2", "event_id % 2 = 1")
    got = report()
    assert got == report()                                          # nothing new: the same report
    batch = ST.rollouts_from_events(spark.read.schema(ST.EVENT_SCHEMA).parquet(EVENTS))
    want = {(str(r[0]), r[1]): (r[2], round(r[3], 9)) for r in batch.selectExpr("date_format(ts, 'yyyy-MM-dd 00:00:00') d", "stage", "reward")
            .groupBy("d", "stage").agg({"*": "count", "reward": "avg"}).selectExpr("d", "stage", "`count(1)`", "`avg(reward)`").collect()}
    assert got == want
    batches = [r["batch"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").select("batch").distinct().collect()]
    assert sorted(batches) == [0, 1, 2]                             # one batch a file over three calls


def test_folders_belong_together(spark):
    ev = ST.event_stream(spark, SF_SMALL)
    with pytest.raises(ValueError):
        ST.stream_scores(ST.rollouts_from_events(ev), out="/tmp/only-out")
