"""The time-out join's groups: slots of keys, not keys."""

from datetime import datetime, timedelta

from rolloutlab.streaming import jobs as ST

START = datetime(2024, 1, 1)


def test_timeout_join_groups_by_slots_of_keys(spark, tmp_path):
    """Ties, repeated rows, keys above 2^53 and null ones; the state has a row per slot, not per key."""
    big, subs, res = 2 ** 60, [], []
    for k in range(300):
        key = None if k == 7 else big + k
        subs += [(1000 + k, key, START + timedelta(minutes=k % 50))] * (1 + (k % 10 == 0))
        subs.append((5000 + k, key, START + timedelta(days=3, minutes=k)))
        if k % 3:
            at = START + timedelta(minutes=k % 50 + k % 7 * 55)
            res += [(2000 + k, key, at, float(k)), (2500 + k, key, at, 1.0), (3000 + k, key, at + timedelta(minutes=1), None)]
    want = {}
    for i, key, ts in subs:
        fit = sorted((r[2], r[0], r[3]) for r in res if r[1] == key and ts <= r[2] <= ts + timedelta(hours=6))
        want[i] = (fit[0][1], round(min(0.8, max(0.05, 0.8 / (1 + fit[0][2] ** 0.5))), 9)) if fit else (None, -1.0)
    rows = ([(i, ts, key, "click", 0.0, None) for i, key, ts in subs] + [(i, ts, key, "view", v, None) for i, key, ts, v in res])
    spark.createDataFrame(rows, ST.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    ev = ST.event_stream(spark, str(tmp_path))
    df = ST.stream_timeout_join(ST.submissions(ev), ST.results(ev), out=f"{tmp_path}/out", checkpoint=f"{tmp_path}/state")
    got = df.collect()
    assert {r["sub_id"]: (r["res_id"], round(r["reward"], 9)) for r in got} == want
    emitted = [r["sub_id"] for r in spark.read.parquet(f"{tmp_path}/out/decided").collect()]
    assert set(emitted) == {i for i, _, _ in subs if i < 5000} and len(emitted) == 330     # repeated rows come out as often
    first = spark.read.format("statestore").option("batchId", 0).load(f"{tmp_path}/state/decided")
    assert first.count() <= 5 * (ST.SLOTS + 1)                     # five time buckets; before: one row per key and bucket, over 900
