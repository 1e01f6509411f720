"""Conversation and training-history operators.

Windows always have a ``partitionBy``. Where a group could be very large (a
conversation, a run), rows are first reduced with a partial aggregate or a
per-group top-k (``WindowGroupLimit``), so the ordered window only sees a
bounded number of rows per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rolloutlab.operators.joins import join_null_safe, plain_keys
from rolloutlab.operators.sampling import ranked_within

ERROR_STAGE = "compile_error"
NO_CODE_STAGE = "no_code"
MAX_ITERATIONS = 20
STOP_REWARD = 3.0
TURN_CHUNK = 4096
CHUNK_ROWS = 65536


def last_assistant(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                   content: str = "text") -> DataFrame:
    """Per conversation the content of the last assistant message, '' if none:
    one aggregate in which other roles have no order value and so never win."""
    said = F.max_by(content, F.when(F.col(role) == "assistant", F.col(order)))
    return turns.groupBy(key).agg(F.coalesce(said, F.lit("")).alias("last_assistant"))


def trajectory(turns: DataFrame, key: str = "conv_id", order: str = "turn", reward: str = "reward",
               text: str = "text", max_iterations: int = MAX_ITERATIONS, stop_reward: float = STOP_REWARD,
               turn_chunk: int | None = TURN_CHUNK) -> DataFrame:
    """Keep each conversation's turns up to and including the first stop and
    number them (``iteration``); ``should_stop`` marks the stop row.

    A turn stops when its text is non-empty and (reward >= ``stop_reward`` or
    iteration >= ``max_iterations``); empty text never stops but counts.
    A prefix combine over chunks: turns are dealt to chunks of ``turn_chunk`` turn
    values (an hour for a timestamp column; one chunk where ``order`` is neither
    integral nor a timestamp) and numbered inside theirs. A chunk is summed up in
    one row: its turns, its first stopping reward, and its first non-empty turns,
    of which only the first ``max_iterations`` places matter. A scan over a
    conversation's chunk rows adds the counts up and takes the first stop, so one
    task never holds a long conversation. Rows are shuffled once, by conversation
    and chunk. Null conversations are one conversation; a turn without an order
    value comes first, never stops, and goes where there is a stop."""
    dtype = turns.schema[order].dataType
    chunk = F.lit(0)
    if turn_chunk and isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        chunk = F.floor(F.col(order) / F.lit(turn_chunk))
    elif turn_chunk and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        chunk = F.date_trunc("hour", F.col(order))
    marked, plain = plain_keys(turns.withColumn("_chunk", chunk), [key, "_chunk"])
    owner, place = plain[:2], plain[2:]
    placed = marked.withColumn("_rn", F.row_number().over(Window.partitionBy(*plain).orderBy(order)))
    said = F.coalesce(F.length(F.col(text)) > 0, F.lit(False)) & F.col(order).isNotNull()
    early = F.col("_rn") <= max_iterations
    chunks = placed.groupBy(*plain).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(said & (F.col(reward) >= stop_reward), F.col(order))).alias("_won"),
        F.collect_list(F.when(said & early, F.struct("_rn", F.col(order).alias("at")))).alias("_early"),
        F.min(F.when(said & ~early, F.col(order))).alias("_late"))
    before = Window.partitionBy(*owner).orderBy(F.desc(place[1]), place[0]).rowsBetween(Window.unboundedPreceding, -1)
    scan = chunks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    full = F.array_min(F.transform(F.filter("_early", lambda t: t["_rn"] + F.col("_off") >= max_iterations), lambda t: t["at"]))
    stops = scan.withColumn("_stop", F.least("_won", "_late", full)).select(
        *plain, "_off", F.min("_stop").over(Window.partitionBy(*owner)).alias("_stop"))
    return (placed.join(stops, plain).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
            .withColumn("iteration", (F.col("_off") + F.col("_rn")).cast("long"))
            .withColumn("should_stop", F.coalesce(F.col(order) == F.col("_stop"), F.lit(False)))
            .drop("_stop", "_off", "_rn", "_chunk", *plain))


def stage_distribution(log: DataFrame, stage: str = "stage", reward: str = "reward") -> DataFrame:
    """Count, share and mean reward per stage (share from a window over the
    handful of stage rows, not over the log)."""
    agg = log.groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean_reward"))
    return agg.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def rate_by_step_window(log: DataFrame, width: int = 500, step: str = "step", stage: str = "stage",
                        by: list[str] | None = None) -> DataFrame:
    """Per window of ``width`` steps: rows, error rate (compile errors) and
    format compliance (share of rows that produced code)."""
    keys = [*(by or []), F.floor(F.col(step) / width).cast("long").alias("window")]
    return (log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col(stage) == ERROR_STAGE) / F.count(F.lit(1))).alias("error_rate"),
        (F.lit(1.0) - F.count_if(F.col(stage) == NO_CODE_STAGE) / F.count(F.lit(1))).alias("compliance"))
        .withColumn("first_step", F.col("window") * width))


def exact_quantiles(df: DataFrame, by: list[str], value: str, ps: dict[str, float], width: float = 64.0) -> DataFrame:
    """Per group the exact quantiles (linear between neighbours) by distributed selection.

    Rows become a histogram per group and value; values lie in buckets of ``width`` whose running offsets are added to the
    running counts inside each bucket, so every value knows the ranks it covers and a group is spread over its buckets.
    All quantiles come from one pass; a null value has no rank."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    seen = seen.withColumn("_b", F.floor(F.col("_v") / F.lit(width)))
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    buckets = (seen.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))
               .select(*by, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), F.sum("_s").over(whole).alias("_n")))
    last = F.sum("_c").over(inside)
    ranked = join_null_safe(seen.withColumn("_hi", last), buckets, [*by, "_b"]).withColumns(
        {"_to": F.col("_off") + F.col("_hi"), "_from": F.col("_off") + F.col("_hi") - F.col("_c")})   # ranks from 0, end open

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    place = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in ps.items()}
    parts = ranked.groupBy(*by).agg(F.first("_n").alias("_n"), *(e for name, x in place.items() for e in (
        at(F.floor(x)).alias(f"_lo_{name}"), at(F.ceil(x)).alias(f"_up_{name}"))))
    return parts.select(*by, *((F.col(f"_lo_{name}") + (x - F.floor(x)) * (F.col(f"_up_{name}") - F.col(f"_lo_{name}"))).alias(name)
                               for name, x in place.items()))


def completion_lengths(log: DataFrame, length: str = "length", terminated: str = "terminated",
                       by: list[str] | None = None) -> DataFrame:
    """Mean, exact percentiles (50/90/99) and share clipped (not terminated)."""
    keys = [*(by or []), "_g"]
    log = log.withColumn("_g", F.lit(0))
    stats = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean_length"),
        (F.count_if(~F.col(terminated)) / F.count(F.lit(1))).alias("clipped_share"))
    cuts = exact_quantiles(log, keys, length, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return join_null_safe(stats, cuts, keys, "left").select(*(by or []), "n", "mean_length", "p50", "p90", "p99", "clipped_share")


def spikes(log: DataFrame, factor: float = 3.0, window: int = 50, run: str = "run_id", step: str = "step",
           metric: str = "loss", max_recovery: int = 250, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per run and step the mean ``metric``; a spike is a step whose value
    exceeds ``factor`` x the trailing mean of the previous ``window`` steps.
    ``recovery_steps`` = steps until the next non-spike step (null if none
    within ``max_recovery``).

    The log is first reduced to one row per (run, step) by a partial
    aggregate. Each run's steps are then cut into chunks of ``chunk_rows``
    positions; a chunk also receives the ``window`` rows before it (for the
    trailing mean) and, in a second pass, the ``max_recovery`` rows after it
    (steps increase, so a recovery within that many steps lies within that
    many rows). Every window therefore holds at most about ``chunk_rows`` rows,
    however long a run is, and the result equals an unchunked window."""
    chunk_rows = max(chunk_rows, window + 1, max_recovery + 1)   # context comes from one neighbour only
    per_step = log.groupBy(run, step).agg(F.avg(metric).alias("value"))
    ranked = ranked_within(per_step, [run], F.floor(F.col(step) / F.lit(chunk_rows)), [F.col(step)])
    home = ranked.withColumn("_chunk", F.floor(F.col("pos") / F.lit(chunk_rows)).cast("long"))
    off = F.col("pos") - F.col("_chunk") * chunk_rows

    # pass 1: trailing mean, with the previous `window` rows as context. A row
    # near the end of its chunk is emitted twice (shift 0 and +1) by one explode,
    # so the per-step aggregate is computed once (a union would re-run it)
    shifts = F.when(off >= chunk_rows - window, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ctx = (home.withColumn("_shift", F.explode(shifts))
           .withColumn("_home", F.col("_shift") == 0).withColumn("_chunk", F.col("_chunk") + F.col("_shift"))
           .drop("_shift"))
    w1 = Window.partitionBy(run, "_chunk").orderBy("pos")
    flagged = (ctx.withColumn("trailing_mean", F.avg("value").over(w1.rowsBetween(-window, -1)))
               .where("_home").drop("_home")
               .withColumn("is_spike", F.coalesce(F.col("value") > F.lit(factor) * F.col("trailing_mean"),
                                                  F.lit(False))))

    # pass 2: next non-spike step, with the next `max_recovery` rows as context;
    # a running min in descending order (incremental frame)
    off2 = F.col("pos") - F.col("_chunk") * chunk_rows
    shifts2 = F.when(off2 < max_recovery, F.array(F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))
    ctx2 = (flagged.withColumn("_shift", F.explode(shifts2))
            .withColumn("_home", F.col("_shift") == 0).withColumn("_chunk", F.col("_chunk") + F.col("_shift"))
            .drop("_shift"))
    w2 = Window.partitionBy(run, "_chunk").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.min(F.when(~F.col("is_spike"), F.col(step))).over(w2)
    rec = nxt - F.col(step)
    return (ctx2.withColumn("recovery_steps", F.when(F.col("is_spike") & (rec <= max_recovery), rec))
            .where(F.col("_home") & F.col("is_spike"))
            .select(run, step, "value", "trailing_mean", "is_spike", "recovery_steps"))
