"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line with seconds per query.

Each query is forced to completion with the ``noop`` sink (every row is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rolloutlab.plans.catalog import QUERIES  # noqa: E402
from rolloutlab.session import get_spark  # noqa: E402

HEADLINE = [
    "prepare_prompts", "prepare_dataset", "reference_text", "reference_text_join", "render_user_message", "exact_split",
    "curriculum", "assign_batches", "score_rollouts", "group_advantage", "roll_up_checks", "compare_nested",
    "compare_variants", "kernel_source", "signature_params", "argument_calls", "slice_lines", "trajectory",
    "spikes", "completion_lengths", "stage_distribution", "layer_norm", "batch_norm", "softmax_rows",
    "matmul", "conv1x1", "max_pool", "vec_gelu", "safe_apply", "stream_scores", "stream_timeout_join",
    "stream_trajectory", "compare_by_rule", "pair_outputs", "argument_table", "group_norm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="rolloutlab-bench",
                      extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # warm-up: JVM, Python workers and codegen caches
    QUERIES["normalise_ops"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
