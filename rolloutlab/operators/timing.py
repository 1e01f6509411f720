"""Timing aggregation (A3, A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANTS = ("eager", "compiled", "candidate")
WARMUP = 5
ITERS = 10


def device_time(timings: DataFrame, warmup: int = WARMUP, iters: int = ITERS, key: str = "model_id",
                device: str = "cuda") -> DataFrame:
    """A3: per (model, variant) the summed device duration of the measured
    iterations (after ``warmup``, at most ``iters``) divided by the number of
    measured iterations present. Host events are dropped before the shuffle."""
    measured = timings.where((F.col("device") == device) & (F.col("iteration") > warmup)
                             & (F.col("iteration") <= warmup + iters))
    return (measured.groupBy(key, "variant")
            .agg((F.sum("duration_us") / F.count_distinct("iteration")).alias("device_us"),
                 F.count_distinct("iteration").cast("long").alias("n_iters")))


def compare_variants(device_times: DataFrame, key: str = "model_id") -> DataFrame:
    """A4: one row per model with the three variant times (pivot over a fixed
    value list: no extra job to discover values) and two speed-ups."""
    wide = device_times.groupBy(key).pivot("variant", list(VARIANTS)).agg(F.first("device_us"))
    return (wide.select(key, F.col("eager").alias("eager_us"), F.col("compiled").alias("compiled_us"),
                        F.col("candidate").alias("candidate_us"))
            .withColumn("speedup_eager", F.try_divide("eager_us", "candidate_us"))
            .withColumn("speedup_compile", F.try_divide("compiled_us", "candidate_us")))


def render_profile_log(eager="eager_us", compiled="compiled_us", candidate="candidate_us"):
    """Profile log line (input format of X11); numbers in shortest round-trip form."""
    c = [F.col(x) if isinstance(x, str) else x for x in (eager, compiled, candidate)]
    return F.when(c[0].isNotNull() & c[1].isNotNull() & c[2].isNotNull(), F.concat(
        F.lit("Torch Baseline: "), c[0].cast("string"), F.lit("us, Torch Compile: "), c[1].cast("string"),
        F.lit("us, HIP Extension: "), c[2].cast("string"), F.lit("us")))
