"""Row-group numerics and matrix work on long (COO) tables.

Matrices are ``(i, k, v)`` / ``(k, j, v)`` tables: a product is an equi-join on
the shared index and a ``groupBy`` sum, so it scales with the number of
non-zero cells, and adaptive execution splits a skewed join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlab.operators.joins import plain_keys
from rolloutlab.operators.sampling import ranked_within


# ---------------------------------------------------------------- group reductions
ROW_REDUCE = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "prod": F.product}


def reduce_rows(df: DataFrame, group: list[str], value: str, kinds=("sum", "mean", "max", "min", "prod")
                ) -> DataFrame:
    """N1 (group form): one partial aggregation per group for each reduction."""
    return df.groupBy(*group).agg(*[ROW_REDUCE[k](value).alias(f"{value}_{k}") for k in kinds])


def softmax_rows(df: DataFrame, group: list[str], value: str, out: str = "softmax",
                 log_out: str | None = None) -> DataFrame:
    """N4/N5 (group form): softmax (and, with ``log_out``, log-softmax) of a scalar
    column within each group of rows.

    Group max and sum come from ``groupBy`` (partial aggregation) joined back on
    the group key; both outputs come from the same two statistics. The rows are
    shuffled by the key once for both joins, and once more, with the value alone,
    for the sum."""
    marked, plain = plain_keys(df, group)
    mx = marked.groupBy(*plain).agg(F.max(value).alias("_mx"))
    e = marked.join(mx, plain).withColumn("_e", F.exp(F.col(value) - F.col("_mx")))
    s = e.groupBy(*plain).agg(F.sum("_e").alias("_s"))
    res = e.join(s, plain).withColumn(out, F.col("_e") / F.col("_s"))
    if log_out:
        res = res.withColumn(log_out, F.col(value) - F.col("_mx") - F.ln("_s"))
    return res.drop("_mx", "_e", "_s", *plain)


def feature_stats(df: DataFrame, col: str) -> DataFrame:
    """One row (m, v): per-feature mean and population variance over all rows of a
    vector column, as arrays by position.

    The explode keeps only (position, value); partial aggregation reduces it to
    one row per feature, and the arrays are as long as the vectors."""
    stats = (df.select(F.posexplode(col).alias("pos", "x")).groupBy("pos")
             .agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")))
    both = stats.agg(F.sort_array(F.collect_list(F.struct("pos", "m", "v"))).alias("s"))
    return both.select(F.col("s.m").alias("m"), F.col("s.v").alias("v"))


def batch_norm(df: DataFrame, col: str, eps: float = 1e-5, scale: float = 1.0, bias: float = 0.0,
               stats: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """scale*(x - mean_f)/sqrt(var_f + eps) + bias with statistics per feature f
    over all rows. The statistics (a one-row table, by default of ``df`` itself)
    enter as a scalar subquery, so nothing runs while the plan is built and the
    normalisation itself is a row-local ``transform``."""
    one = (stats if stats is not None else feature_stats(df, col)).select(F.struct("m", "v").alias("s"))
    s = F.col("_stats")
    norm = F.transform(col, lambda x, i: F.lit(scale) * (x - F.get(s["m"], i)) / F.sqrt(F.get(s["v"], i) + F.lit(eps)) + F.lit(bias))
    return df.withColumn("_stats", one.scalar()).withColumn(out or col, norm).drop("_stats")


# ---------------------------------------------------------------- matrices
BLOCK = 4096           # rows of a key that one task takes from either side of a product


def _dedupe(m: DataFrame, keys: list[str]) -> DataFrame:
    return m.groupBy(*keys).agg(F.sum("v").alias("v"))


def block_join(a: DataFrame, b: DataFrame, keys: list[str], a_rest: list[str], b_rest: list[str], block: int = BLOCK) -> DataFrame:
    """Inner join on ``keys`` in which no task meets more than about ``block`` rows of a key from either side.

    Rows are counted per key. A key with more rows than a block is dealt to a grid: its rows of ``a`` to row blocks
    (by ``a_rest``), each copied to every column block, and its rows of ``b`` the other way round, so every pair meets in
    exactly one cell of the grid. All other keys are one cell."""
    na, nb = (m.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(n)) for m, n in ((a, "_ra"), (b, "_rb")))
    heavy = na.join(nb, keys).where("_ra > 1 OR _rb > 1")

    def dealt(m: DataFrame, rest: list[str], own: str, other: str) -> DataFrame:
        m = m.join(heavy, keys, "left")
        place = F.pmod(F.xxhash64(*rest), F.coalesce(own, F.lit(1))).cast("int")
        return m.withColumn(f"{own}_at", place).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop(own, other)

    return dealt(a, a_rest, "_ra", "_rb").join(dealt(b, b_rest, "_rb", "_ra"), [*keys, "_ra_at", "_rb_at"]).drop("_ra_at", "_rb_at")


def matmul(a: DataFrame, b: DataFrame, batch: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """M1: C[i,j] = sum_k A[i,k] B[k,j] on COO tables (``batch`` keys for bmm).
    Duplicate coordinates are summed first, so the join sees one row per cell; a
    heavy k is a block product."""
    batch = batch or []
    a1 = _dedupe(a, [*batch, "i", "k"]).withColumnRenamed("v", "_a")
    b1 = _dedupe(b, [*batch, "k", "j"]).withColumnRenamed("v", "_b")
    return (block_join(a1, b1, [*batch, "k"], ["i"], ["j"], block).groupBy(*batch, "i", "j")
            .agg(F.sum(F.col("_a") * F.col("_b")).alias("v")))


def addmm(c: DataFrame, a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """M1 (addmm): beta*C + alpha*A@B; a cell missing on one side counts as 0."""
    ab = matmul(a, b).withColumnRenamed("v", "_ab")
    c1 = _dedupe(c, ["i", "j"]).withColumnRenamed("v", "_c")
    j = ab.join(c1, ["i", "j"], "full_outer")
    return j.select("i", "j", (F.lit(beta) * F.coalesce("_c", F.lit(0.0))
                               + F.lit(alpha) * F.coalesce("_ab", F.lit(0.0))).alias("v"))


def linear(x: DataFrame, w: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """M1 (linear): x@W + b, ``bias`` as (j, v); ``bias`` is one row per output
    feature and joins on ``j``."""
    y = matmul(x, w)
    if bias is None:
        return y
    return y.join(bias.withColumnRenamed("v", "_bias"), "j", "left").select(
        "i", "j", (F.col("v") + F.coalesce("_bias", F.lit(0.0))).alias("v"))


def conv1x1(x: DataFrame, w: DataFrame, block: int = BLOCK) -> DataFrame:
    """M2: y[b, c_out, p] = sum_{c_in} w[c_out, c_in] * x[b, c_in, p]: a matrix
    product over the channel index at every (batch, position); a heavy channel is
    a block product."""
    x1 = x.groupBy("batch", "c_in", "p").agg(F.sum("v").alias("_x"))
    w1 = w.groupBy("c_out", "c_in").agg(F.sum("v").alias("_w"))
    return (block_join(x1, w1, ["c_in"], ["batch", "p"], ["c_out"], block).groupBy("batch", "c_out", "p")
            .agg(F.sum(F.col("_x") * F.col("_w")).alias("v")))


# ---------------------------------------------------------------- ordered series
def pool(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: str, kind: str = "max",
         size: int | None = None, blocks: int | None = None) -> DataFrame:
    """M3: max or avg pooling over an ordered series per group, either in fixed
    blocks of ``size`` consecutive rows or adaptively into ``blocks`` near-equal
    contiguous blocks (the first ``n mod blocks`` one row longer)."""
    r = ranked_within(df, group, bucket, order)
    if size is not None:
        blk = F.floor(F.col("pos") / F.lit(size))
    else:
        q = F.floor(F.col("group_n") / F.lit(blocks))
        rem = F.col("group_n") - q * F.lit(blocks)
        big = rem * (q + 1)
        blk = F.when(F.col("pos") < big, F.floor(F.col("pos") / (q + 1))).otherwise(
            rem + F.floor((F.col("pos") - big) / q))
    agg = F.max(value) if kind == "max" else F.avg(value)
    return (r.withColumn("block", blk.cast("long")).groupBy(*group, "block")
            .agg(agg.alias(f"{kind}_pool"), F.count(F.lit(1)).alias("block_n")))
