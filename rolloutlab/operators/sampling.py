"""Deterministic shuffles, exact splits, curricula and batch plans (D1-D3, G1, A5),
and the rank helpers they share.

* ``exact_split`` needs only the boundary: rows are counted per hex prefix of
  the key, all buckets but one are decided in place, and only the rows of the
  bucket that holds the boundary are ranked.
* ``bucketed_rank`` gives every row its global position when an operator
  needs it (G1, D3): uniform hash buckets (``digits`` hex digits of the key),
  offsets from the bounded count table, ``row_number`` inside each bucket.
* ``ranked_within`` gives positions inside a group by coarse order chunks
  plus offsets, so one large group is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rolloutlab.dictionaries import OP_DICTS, lit_map, phase_of, snippet_rows
from rolloutlab.operators.joins import plain_keys
from rolloutlab.operators.matching import key_lookup

HEX_DIGITS = 3  # default: 16**3 = 4,096 buckets; more digits for more rows


def shuffle_key(id_col: str = "sample_id", seed: int = 42, method: str = "md5") -> Column:
    """Deterministic sort key, ties broken by the id.

    ``md5`` -- ``md5('<seed>|<id>')`` as 32 hex digits, the same value in
    DuckDB (used by the oracle). ``xxhash64`` -- a cheaper 64-bit hash as 16
    upper-case hex digits (two's complement, so text order is unsigned order);
    no SQL twin. Both are hex strings, so hex-prefix bucketing applies."""
    if method == "xxhash64":
        return F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(id_col))), 16, "0")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str = "sample_id", seed: int = 42, method: str = "md5") -> DataFrame:
    """Adds ``shuffle_key``; ``orderBy`` on it is a distributed range sort."""
    return df.withColumn("shuffle_key", shuffle_key(id_col, seed, method))


def bucketed_rank(df: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """Adds ``rank`` (1-based global position by ``bucket`` then ``order``) and ``n_total``.

    ``bucket`` must be a coarse prefix of the ordering with a bounded number of
    values (here at most a few tens of thousands)."""
    keyed, plain = plain_keys(df.withColumn("_bucket", bucket), ["_bucket"])
    counts = keyed.groupBy(*plain).agg(F.count(F.lit(1)).alias("_n"))
    # bounded table (one row per bucket): a single small window is fine here; a null bucket comes first
    w_all = Window.orderBy(F.desc("_null0"), "_key0")
    offsets = counts.select(
        *plain,
        F.coalesce(F.sum("_n").over(w_all.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("n_total"))
    w = Window.partitionBy(*plain).orderBy(*order)
    return (keyed.join(offsets, plain).withColumn("rank", (F.col("_off") + F.row_number().over(w)).cast("long"))
            .drop("_bucket", "_off", *plain))


def shuffled_rank(df: DataFrame, id_col: str = "sample_id", seed: int = 42, method: str = "md5",
                  digits: int = HEX_DIGITS) -> DataFrame:
    """Rank in seeded-shuffle order (1-based), plus ``shuffle_key`` and ``n_total``.
    A ranking task holds about n / 16^digits rows."""
    keyed = seeded_shuffle(df, id_col, seed, method)
    return bucketed_rank(keyed, F.substring("shuffle_key", 1, digits), [F.col("shuffle_key"), F.col(id_col)])


def ranked_within(df: DataFrame, group: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Adds ``pos`` (0-based position of a row inside its group by ``order``) and
    ``group_n``. ``bucket`` is a coarse, order-preserving prefix of ``order``
    (e.g. the hour of a timestamp): rows are counted per (group, bucket), the
    small count table gives each bucket its offset, and ``row_number`` runs per
    (group, bucket). A hot group is therefore spread over many tasks."""
    # null groups and null order keys are groups of their own
    keyed, plain = plain_keys(df.withColumn("_bk", bucket), [*group, "_bk"])
    owner, place = plain[:-2], plain[-2:]
    counts = keyed.groupBy(*plain).agg(F.count(F.lit(1)).alias("_n"))
    wg = Window.partitionBy(*owner).orderBy(F.desc(place[1]), place[0])
    offs = counts.select(*plain,
                         F.coalesce(F.sum("_n").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                         .alias("_off"),
                         F.sum("_n").over(Window.partitionBy(*owner)).alias("group_n"))
    w = Window.partitionBy(*plain).orderBy(*order)
    return (keyed.join(offs, plain)
            .withColumn("pos", (F.col("_off") + F.row_number().over(w) - 1).cast("long"))
            .drop("_bk", "_off", *plain))


def exact_split(df: DataFrame, ratio: float = 0.1, id_col: str = "sample_id", seed: int = 42,
                method: str = "md5", digits: int = HEX_DIGITS) -> DataFrame:
    """Exactly ``floor(n * ratio)`` rows get ``split='val'`` (the first in
    seeded-shuffle order), the rest 'train'. Null and repeated ids count like any
    other row; ties are broken by the whole row's hash.

    Rows are counted per hex prefix of the key (``16 ** digits`` buckets, partial
    aggregation on the key alone). A bucket wholly before or after the boundary
    decides its rows in place; only the one bucket that holds the boundary is
    ranked, so wide rows are not shuffled beyond that bucket. Take more
    ``digits`` for more rows: the ranked bucket holds about n / 16^digits."""
    names = df.columns
    keyed = df.withColumn("_k", shuffle_key(id_col, seed, method)).withColumn("_b", F.substring("_k", 1, digits))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_b")
    bounds = counts.select("_b", F.sum("_n").over(running).alias("_end"), "_n",
                           F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    bounds = bounds.select("_b", (F.col("_end") - F.col("_n")).alias("_off"), "_end",
                           F.floor(F.col("_total") * F.lit(float(ratio))).alias("_val"))
    # one array of (bucket, rows of it in val) for the buckets that are not wholly train
    val_table = bounds.where("_off < _val").agg(
        F.max_by("_b", "_end").alias("last"), F.max_by(F.col("_val") - F.col("_off"), "_end").alias("take")).select(
        F.struct("last", "take").alias("v"))
    marked = keyed.withColumn("_at", val_table.scalar()).withColumn("_last", F.col("_at.last"))
    clear = marked.where(~F.col("_b").eqNullSafe(F.col("_last"))).select(
        *names, F.when(F.col("_b") < F.col("_last"), "val").otherwise("train").alias("split"))
    order = Window.partitionBy("_b").orderBy("_k", id_col, F.xxhash64(*names))
    edge = (marked.where(F.col("_b").eqNullSafe(F.col("_last"))).withColumn("_rank", F.row_number().over(order))
            .select(*names, F.when(F.col("_rank") <= F.col("_at.take"), "val").otherwise("train").alias("split")))
    return clear.unionAll(edge)


def ranked_split(df: DataFrame, ratio: float = 0.1, id_col: str = "sample_id", seed: int = 42,
                 method: str = "md5") -> DataFrame:
    """D2 with the global rank of every row (bucketed rank; shuffles the rows)."""
    ranked = shuffled_rank(df, id_col, seed, method)
    n_val = F.floor(F.col("n_total") * F.lit(float(ratio)))
    return ranked.withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train"))


def op_phase(ops_col: str = "ops", arch: str = "gfx1201") -> Column:
    """Curriculum phase of a sample: the highest phase among its matched ops
    (1 element-wise, 2 reduction/normalisation, 3 convolution/matmul); 1 when
    nothing matches. Row-local with literal tables."""
    lookup = key_lookup(arch)
    phases = lit_map([(k, phase_of(k)) for k, _ in snippet_rows(arch)])
    keys = F.transform(F.coalesce(F.col(ops_col), F.array().cast("array<string>")), lookup)
    return F.coalesce(F.array_max(F.transform(keys, lambda k: F.try_element_at(phases, k))), F.lit(1))


def curriculum(samples: DataFrame, id_col: str = "sample_id", ops_col: str = "ops", seed: int = 42,
               arch: str = "gfx1201") -> DataFrame:
    """D3: adds ``phase`` and ``rank`` = position when ordered by phase then the
    seeded shuffle key (buckets = phase x 4,096 hash prefixes)."""
    keyed = seeded_shuffle(samples.withColumn("phase", op_phase(ops_col, arch).cast("int")), id_col, seed)
    bucket = F.concat(F.col("phase").cast("string"), F.lit(":"), F.substring("shuffle_key", 1, HEX_DIGITS))
    return bucketed_rank(keyed, bucket, [F.col("shuffle_key"), F.col(id_col)])


def assign_batches(samples: DataFrame, batch: int = 1, accum: int = 8, generations: int = 4, epochs: int = 1,
                   id_col: str = "sample_id", seed: int = 42) -> DataFrame:
    """G1: one row per (sample, epoch, generation) with ``step`` and ``slot``.

    Effective batch = batch x accum prompts per optimiser step; a sample at
    0-based shuffled position r lands in step ``epoch*steps + r // eff`` (the
    tail beyond ``steps*eff`` forms a final partial step, ``partial=true``).
    The generation batch is max(batch, generations) rounded down to a multiple
    of ``generations``."""
    eff = batch * accum
    gen_batch = max(batch, generations)
    gen_batch -= gen_batch % generations
    r = shuffled_rank(samples.select(id_col), id_col, seed)
    steps = F.floor(F.col("n_total") / F.lit(eff)).cast("long")
    pos = F.col("rank") - 1
    return (r.select(id_col, "rank", "n_total",
                     F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
            .select(id_col, F.col("epoch").cast("long").alias("epoch"),
                    F.explode(F.sequence(F.lit(0), F.lit(generations - 1)).cast("array<bigint>")).alias("generation"),
                    (F.col("epoch") * steps + F.floor(pos / F.lit(eff))).cast("long").alias("step"),
                    (pos % F.lit(eff)).cast("long").alias("slot"),
                    (pos >= steps * F.lit(eff)).alias("partial"),
                    F.lit(gen_batch).alias("generation_batch")))


def dataset_plan(samples: DataFrame, val_ratio: float = 0.1, batch: int = 1, accum: int = 8, epochs: int = 2,
                 max_steps: int = -1) -> DataFrame:
    """A5: one row: n, val, train, effective batch, steps per epoch (train // eff),
    total steps (or ``max_steps`` when >= 0)."""
    eff = batch * accum
    n = F.count(F.lit(1))
    val = F.floor(n * F.lit(float(val_ratio)))
    train = n - val
    spe = F.floor(train / F.lit(eff))
    total = spe * F.lit(epochs) if max_steps < 0 else F.lit(max_steps)
    return samples.agg(n.cast("long").alias("n"), val.cast("long").alias("n_val"), train.cast("long").alias("n_train"),
                       F.lit(eff).cast("long").alias("effective_batch"), spe.cast("long").alias("steps_per_epoch"),
                       total.cast("long").alias("total_steps"))


__all__ = ["shuffle_key", "seeded_shuffle", "bucketed_rank", "shuffled_rank", "exact_split", "op_phase",
           "curriculum", "assign_batches", "dataset_plan", "OP_DICTS"]
