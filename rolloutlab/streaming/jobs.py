"""Streaming jobs (ST1-ST3): online scoring reports, time-out joins and
per-conversation trajectories with Structured Streaming.

Each job takes streaming DataFrames and, together, a folder ``out`` for its
results and a ``checkpoint`` folder for offsets and state. A later call with the
same two folders reads only what has arrived since and goes on from the stored
state; without them (both) a call has folders of its own below the shared
checkpoint folder. Event time is a ``timestamp`` (watermarks reject
``timestamp_ntz``). Batches write folders of their own, which a retried batch
overwrites, or use the exactly-once file sink.
"""

from __future__ import annotations

import uuid
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rolloutlab.session import checkpoint_dir

EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
                "props string")


def event_path(sf_dir: str) -> str:
    """The events table for a file stream: a glob matches one file as well as a folder of files."""
    return f"{sf_dir.rstrip('/')}/events.parque[t]"


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """File stream over the events table; ``max_files`` bounds the files of a micro-batch."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(event_path(sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))


def rollouts_from_events(ev: DataFrame) -> DataFrame:
    """Stage and reward per scored completion, as in the batch fixture."""
    et = F.col("event_type")
    partial = F.least(F.lit(0.8), F.greatest(F.lit(0.05), F.lit(0.8) / (F.lit(1.0) + F.sqrt("value"))))
    return ev.select(
        "event_id", "ts", "user_id",
        F.when(et == "error", "compile_error").when(et == "signup", "no_code").when(et == "view", "verify_error")
        .when(et == "click", "verify_partial").when(et == "purchase", "profiled").alias("stage"),
        F.when(et == "error", -0.5).when(et == "signup", -1.0).when(et == "view", 0.0).when(et == "click", partial)
        .when(et == "purchase", (F.col("event_id") % 3 + 1).cast("double")).alias("reward"))


def submissions(ev: DataFrame) -> DataFrame:
    """The click events as submissions: sub_id, key, ts."""
    return ev.where(F.col("event_type") == "click").select(F.col("event_id").alias("sub_id"), F.col("user_id").alias("key"), "ts")


def results(ev: DataFrame) -> DataFrame:
    """The view events as results: res_id, key, ts, value."""
    return ev.where(F.col("event_type") == "view").select(F.col("event_id").alias("res_id"), F.col("user_id").alias("key"), "ts", "value")


def turns(ev: DataFrame) -> DataFrame:
    """The scored events as conversation turns: conv_id, turn, ts, reward, text."""
    return rollouts_from_events(ev).select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), "ts", "reward",
        F.when(F.col("stage") == "no_code", F.lit("")).otherwise(F.lit("code")).alias("text"))


def _folders(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    if (out is None) != (checkpoint is None):
        raise ValueError("out and checkpoint belong together: the results of one checkpoint are in one folder")
    if out is None:
        out, checkpoint = (f"{checkpoint_dir(spark)}/{name}-{kind}-{uuid.uuid4().hex}" for kind in ("out", "state"))
    return out.rstrip("/"), checkpoint.rstrip("/")


def _drain(writer, checkpoint: str) -> None:
    """Run a query over everything that has arrived."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _by_batch(stream: DataFrame, out: str, schema: str, checkpoint: str) -> DataFrame:
    """Write every micro-batch's updated rows to ``out/batch=<number>`` with their ``batch``; return them all."""
    spark = stream.sparkSession

    def write(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _drain(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint)
    schema = f"{schema}, batch long"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/none")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(out)


def stream_scores(rollouts: DataFrame, window: str = "1 day", delay: str | None = None, out: str | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """ST1: per event-time window and stage, completion count and mean reward of a
    streaming DataFrame (event_id, ts, stage, reward).

    The stream keeps the state: ids that came already (an id that comes again, in
    the same or a later file, does not count; events without an id all count) and
    the count and sum of every window and stage. A batch writes the windows it
    changed, and the report takes each window's latest row, so no event is read
    twice. Without ``delay`` no row is too late and all ids are kept; with it, ids
    are kept and windows open until the watermark has passed them."""
    out, checkpoint = _folders(rollouts.sparkSession, "st1", out, checkpoint)
    rows = rollouts.select(F.coalesce(F.col("event_id").cast("string"), F.expr("uuid()")).alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                           "stage", F.col("reward").cast("double").alias("reward"))
    once = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"]) if delay else rows.dropDuplicates(["id"])
    counts = (once.groupBy(F.window("ts", window).alias("w"), "stage")
              .agg(F.count(F.lit(1)).alias("n"), F.count("reward").alias("n_reward"), F.sum("reward").alias("total"))
              .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "stage", "n", "n_reward", "total"))
    every = _by_batch(counts, out, "window_start string, stage string, n long, n_reward long, total double", checkpoint)
    last = every.groupBy("window_start", "stage").agg(F.max_by(F.struct("n", "n_reward", "total"), "batch").alias("s"))
    return last.select("window_start", "stage", "s.n", (F.col("s.total") / F.when(F.col("s.n_reward") > 0, F.col("s.n_reward"))).alias("mean_reward"))


SLOTS = 16             # groups of keys per time bucket; a checkpoint holds for one number
_OPEN = "sub_key array<long>, sub_ms array<long>, sub_id array<long>, res_key array<long>, res_ms array<long>, res_id array<long>, res_value array<double>"


def _decide_fn(within_ms: int):
    """Holds the open submissions of one (slot of keys, time bucket) and emits each once: with its key's earliest result as
    soon as no earlier one can come, or without one when its time has passed. All keys of a slot are decided together, by
    one sort and one search, as a call per key costs far more than its few rows."""

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [[]] * 7
        cols = [[np.array(c, "float64" if i == 6 else "int64")] for i, c in enumerate(held)]
        if not state.hasTimedOut:
            for pdf in pdfs:
                is_result = pdf["is_result"].to_numpy(bool)
                for i, name in enumerate(("key", "ms", "id")):
                    column = pdf[name].to_numpy("int64")
                    cols[i].append(column[~is_result])
                    cols[3 + i].append(column[is_result])
                cols[6].append(pdf["value"].to_numpy("float64")[is_result])
        sub_key, sub_ms, sub_id, res_key, res_ms, res_id, res_value = (np.concatenate(c) for c in cols)
        # (key, time) as one number: the rank of the key, then the time within the two buckets of the group
        rank = np.unique(np.concatenate([sub_key, res_key]), return_inverse=True)[1]
        times = np.concatenate([sub_ms, res_ms])
        place = rank * (np.ptp(times) + 1) + times - times.min() if len(times) else times
        sub_place, res_place = place[:len(sub_key)], place[len(sub_key):]
        order = np.lexsort((res_id, res_place))
        res_key, res_ms, res_id, res_value = res_key[order], res_ms[order], res_id[order], res_value[order]
        found, until = np.zeros(len(sub_key), bool), sub_ms + within_ms
        if len(res_key):
            first = np.searchsorted(res_place[order], sub_place)
            best = np.minimum(first, len(res_key) - 1)
            found = (first < len(res_key)) & (res_key[best] == sub_key) & (res_ms[best] <= until)
            until = np.where(found, res_ms[best], until)
        now = state.getCurrentWatermarkMs()
        done = until < now                        # nothing that is not late can change it
        kept = res_ms >= now                      # an earlier one is the first of no submission that waits or may still come
        if not done.all() or kept.any():
            state.update(tuple(c.tolist() for c in (sub_key[~done], sub_ms[~done], sub_id[~done], res_key[kept], res_ms[kept], res_id[kept], res_value[kept])))
            state.setTimeoutTimestamp(max(int(until[~done].min() if not done.all() else res_ms[kept].max()), now) + 1)
        else:
            state.remove()
        if done.any():
            with_result = found[done]
            res, value = np.zeros(len(with_result), "int64"), np.full(len(with_result), np.nan)
            if with_result.any():
                at = best[done][with_result]
                res[with_result], value[with_result] = res_id[at], res_value[at]
            yield pd.DataFrame({"sub_id": sub_id[done], "res_id": pd.arrays.IntegerArray(res, ~with_result), "res_value": value})

    return fn


def earliest_result(subs: DataFrame, res: DataFrame, within_s: int) -> DataFrame:
    """sub_id, res_id, res_value: each submission's earliest result of its key within the time, by a running window per
    key and time bucket (a result stands in its own bucket and the one before), never by pairs."""
    bucket = F.floor(F.unix_micros("ts") / F.lit(within_s * 1_000_000)).cast("long")
    left = subs.select("key", bucket.alias("b"), "ts", "sub_id", F.lit(None).cast("struct<ts:timestamp,res_id:bigint,res_value:double>").alias("r"))
    right = res.select("key", F.explode(F.array(bucket, bucket - 1)).alias("b"), "ts", F.lit(None).cast("long").alias("sub_id"),
                       F.struct("ts", "res_id", F.col("value").alias("res_value")).alias("r"))
    # from the latest on; at one time the results come first, the smallest id last
    order = Window.partitionBy("key", "b").orderBy(F.desc("ts"), F.col("r").isNull().asc(), F.desc("r.res_id")).rowsBetween(Window.unboundedPreceding, 0)
    near = left.unionAll(right).withColumn("next", F.last("r", True).over(order)).where("sub_id IS NOT NULL")
    return near.select("sub_id", F.when(F.col("next.ts") <= F.col("ts") + F.expr(f"INTERVAL {within_s} SECONDS"), F.col("next")).alias("n")).select(
        "sub_id", "n.res_id", "n.res_value")


def stream_timeout_join(subs: DataFrame, res: DataFrame, within_s: int = 6 * 3600, default: float = -1.0, delay: str = "1 hour",
                        out: str | None = None, checkpoint: str | None = None, finalise: bool = True) -> DataFrame:
    """ST2: each submission (sub_id, key, ts) is paired with the earliest result (res_id, key, ts, value) of its key that
    comes within ``within_s`` seconds; submissions without one get ``default``.

    State holds the open submissions per time bucket of that length and slot of keys (``SLOTS`` of them), so a busy key is
    spread over many groups, and the number of groups grows with the time that the input spans, not with its keys. A
    submission is emitted once: with its result when the watermark has passed that, or without when its time is over;
    event-time timers do both. Rows behind the watermark (``delay``) do not reach the state; all rows are also written
    to ``out/seen``, from which submissions that got none, or never came out, are looked up again: ``late`` marks a
    result that came too late for the stream, and a submission that was itself late.

    On a finite input the last submissions wait for a watermark that never comes (T6). With ``finalise`` they are
    returned too, with the result seen so far or ``default`` (``late`` is false)."""
    spark = subs.sparkSession
    out, checkpoint = _folders(spark, "st2", out, checkpoint)
    both = subs.select(F.lit(False).alias("is_result"), F.col("sub_id").alias("id"), "key", "ts", F.lit(None).cast("double").alias("value")).unionAll(
        res.select(F.lit(True), F.col("res_id"), "key", "ts", "value"))
    schema = "is_result boolean, id bigint, key bigint, ts timestamp, value double"
    bucket = F.floor(F.unix_micros("ts") / F.lit(within_s * 1_000_000)).cast("long")
    # rows without a key stand together, in a slot of their own
    slot = F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int"))
    dealt = (both.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")).withColumn("slot", slot).withColumn("key", F.coalesce("key", F.lit(0)))
             .withColumn("b", F.explode(F.when(F.col("is_result"), F.array(bucket, bucket - 1)).otherwise(F.array(bucket)))))
    decided = dealt.groupBy("slot", "b").applyInPandasWithState(_decide_fn(within_s * 1000), "sub_id long, res_id long, res_value double", _OPEN,
                                                               "append", GroupStateTimeout.EventTimeTimeout)
    for name, stream in (("decided", decided), ("seen", both)):
        _drain(stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/{name}"), f"{checkpoint}/{name}")
    done = spark.read.schema("sub_id long, res_id long, res_value double").parquet(f"{out}/decided")
    seen = spark.read.schema(schema).parquet(f"{out}/seen")
    all_subs = seen.where("NOT is_result").select(F.col("id").alias("sub_id"), "key", "ts")
    all_res = seen.where("is_result").select(F.col("id").alias("res_id"), "key", "ts", "value")
    found = done.where("res_id IS NOT NULL").withColumn("late", F.lit(False))
    none = done.where("res_id IS NULL").select("sub_id", F.lit(True).alias("timed_out"))
    # looked up again: timed-out submissions, and those that never came out (still open, or themselves late)
    rest = all_subs.join(found.select("sub_id"), "sub_id", "left_anti").join(none, "sub_id", "left")
    last = seen.agg(F.max("ts") - F.expr(f"INTERVAL {delay}")).scalar()
    again = (earliest_result(rest, all_res, within_s).join(rest.select("sub_id", "ts", "timed_out"), "sub_id")
             .withColumn("open", F.col("timed_out").isNull() & (F.col("ts") + F.expr(f"INTERVAL {within_s} SECONDS") >= last)))
    if not finalise:
        again = again.where("NOT open")
    again = again.select("sub_id", "res_id", "res_value", (~F.col("open") & (F.col("res_id").isNotNull() | F.col("timed_out").isNull())).alias("late"))
    return found.unionByName(again).select(
        "sub_id", "res_id", F.when(F.col("res_id").isNull(), F.lit(default))
        .otherwise(F.least(F.lit(0.8), F.greatest(F.lit(0.05), F.lit(0.8) / (1 + F.sqrt("res_value"))))).alias("reward"), "late")


TRAJ_OUT = "conv_id long, turn long, reward double, text string, iteration long, should_stop boolean"
TRAJ_STATE = "turns array<struct<turn:long,reward:double,text:string>>"


def _trajectory_fn(max_iterations: int, stop_reward: float, idle_ms: int):
    """Keeps a conversation's first turns up to the stop; turns behind the stop can never matter and are let go.

    A turn that comes late moves the stop to an earlier turn at most, so whatever the order of arrival the turns kept
    are those of the batch operator. The batch's rows are taken as they come, never gathered."""

    def cut(rows: list) -> list:
        for i, (_, reward, text) in enumerate(rows):
            if text and (reward is not None and reward >= stop_reward or i + 1 >= max_iterations):
                return rows[:i + 1]
        return rows

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [tuple(x) for x in state.get[0]] if state.exists else []
        known, last = {r[0] for r in rows}, 0
        stopped = bool(rows) and _is_stop(rows[-1], len(rows), max_iterations, stop_reward)
        changed = False
        for pdf in pdfs:
            last = max(last, int(pdf["ms"].max()))
            for turn, reward, text in zip(pdf["turn"], pdf["reward"], pdf["text"]):
                if turn in known or stopped and turn > rows[-1][0]:
                    continue
                insort(rows, (int(turn), None if pd.isna(reward) else float(reward), text), key=lambda r: r[0])
                rows = cut(rows)
                known, changed = {r[0] for r in rows}, True
                stopped = _is_stop(rows[-1], len(rows), max_iterations, stop_reward)
        state.update(([list(r) for r in rows],))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        if changed:
            yield pd.DataFrame([(key[0], *r, i + 1, stopped and i + 1 == len(rows)) for i, r in enumerate(rows)],
                               columns=["conv_id", "turn", "reward", "text", "iteration", "should_stop"])

    return fn


def _is_stop(row: tuple, n: int, max_iterations: int, stop_reward: float) -> bool:
    return bool(row[2]) and (row[1] is not None and row[1] >= stop_reward or n >= max_iterations)


def stream_trajectory(turns: DataFrame, max_iterations: int = 20, stop_reward: float = 3.0, idle_hours: int = 24 * 365,
                      watermark: str = "30 days", out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """ST3: keyed iteration count and stop rule per conversation over a streaming DataFrame (conv_id, turn, ts, reward, text).

    State is the conversation's turns up to its stop (about ``max_iterations`` of them), kept until it has been idle for
    ``idle_hours`` of event time. A batch writes the conversations that it changed, whole, and the result takes each
    one's latest version, so turns may come in any order over any number of files, and again. Rows behind the
    ``watermark`` are dropped. Batch twin: ``history.trajectory``."""
    out, checkpoint = _folders(turns.sparkSession, "st3", out, checkpoint)
    rows = turns.withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    kept = rows.groupBy("conv_id").applyInPandasWithState(_trajectory_fn(max_iterations, stop_reward, idle_hours * 3_600_000), TRAJ_OUT, TRAJ_STATE,
                                                          "update", GroupStateTimeout.EventTimeTimeout)
    every = _by_batch(kept, out, TRAJ_OUT, checkpoint)
    last = every.groupBy("conv_id").agg(F.max("batch").alias("batch")).select(F.col("conv_id").alias("_c"), F.col("batch").alias("_b"))
    return every.join(last, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("batch") == F.col("_b"))).drop("_c", "_b", "batch")
