"""Operator 7 - embedding near-duplicates by an exact metric range join.

Vectors of one label are scaled to unit length, where cosine >= c is the same
as distance <= r = sqrt(2 - 2c). Pivots (vectors drawn by hash) cut a label
into cells: a vector's home is the cell of its nearest pivot. If x and y are
within r, the segment between them crosses the plane halfway between their
pivots, so y lies within r of that plane; a vector is therefore copied to every
cell whose plane it lies within r of, and each cell can be joined on its own:
home members against all members. Identical vectors are one member with a
weight. A cell is joined in blocks of bounded size by matrix products; a block
returns link counts and a spanning forest, never pairs.

With data spread evenly over many dimensions most vectors lie near every plane,
and the join compares nearly all pairs of a label; it stays exact and its
memory bounded.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing (their component is
their own id); vectors of different lengths are not compared; rows that repeat
an id are vectors of their own, of which the id's links count each other one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlab.llm.common import components, stored, table

MIN_COSINE = 0.93
CELL = 4096         # members a cell aims at
BLOCK = 2048        # members of one side of a block
MAX_PIVOTS = 1024   # pivots sent to every task, over all labels (bounds the broadcast)


def classes_of(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors: label, h1, h2, cid (a number given when they are written), class_id (its smallest id), weight, v."""
    usable = rows.where("label IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"
                        " AND exists(v, x -> x <> 0)")
    return usable.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"),
                                                   F.any_value("v").alias("v")).withColumn("cid", F.monotonically_increasing_id())


def pick_pivots(classes: DataFrame, cell: int, limit: int) -> dict[tuple[int, int], np.ndarray]:
    """Unit pivots of every label (and vector length) that needs several cells, at most ``limit`` in all."""
    big = (classes.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
           .orderBy(F.desc("n"), "label", "dim").limit(limit // 2).collect())
    wanted, left = [], limit
    for r in big:
        k = min(-(-r["n"] // cell), left)
        if k >= 2:
            wanted.append((r["label"], r["dim"], k))
            left -= k
    if not wanted:
        return {}
    need = classes.sparkSession.createDataFrame(wanted, "label int, dim int, k int")
    drawn = Window.partitionBy("label", "dim").orderBy(F.xxhash64(F.lit("pivot"), "h1", "h2"), "h1", "h2")
    rows = (classes.withColumn("dim", F.size("v")).join(F.broadcast(need), ["label", "dim"])
            .withColumn("r", F.row_number().over(drawn)).where(f"r <= {limit} AND r <= k").select("label", "dim", "r", "v").collect())
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["r"]):
        out.setdefault((r["label"], r["dim"]), []).append(r["v"])
    return {k: unit(np.array(v, np.float64)) for k, v in out.items()}


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps extreme values finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(classes: DataFrame, pivots: dict, radius: float) -> DataFrame:
    """One row per class and cell that holds it: label, dim, cell, home, cid, weight, v."""
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            label = batch.column(0).to_pylist()
            values = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            dims = np.diff(offsets)
            groups: dict = {}
            for i, key in enumerate(zip(label, dims.tolist())):
                groups.setdefault(key, []).append(i)
            for (lab, dim), at in groups.items():
                at = np.array(at)
                x = unit(values[offsets[at][:, None] + np.arange(dim)])
                p = pivots.get((lab, dim))
                if p is None:
                    row, cell, home = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                else:
                    d2 = np.maximum(2 - 2 * (x @ p.T), 0)
                    own = d2.argmin(axis=1)
                    gap = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
                    plane = (d2 - d2[np.arange(len(at)), own][:, None]) <= 2 * (radius + 1e-9) * gap[own] + 1e-12
                    plane[np.arange(len(at)), own] = True
                    row, cell = np.nonzero(plane)
                    home = own[row] == cell
                for lo in range(0, len(row), 2048):
                    cut = slice(lo, lo + 2048)
                    idx = pa.array(at[row[cut]])
                    yield pa.record_batch([batch.column(0).take(idx), pa.array(np.full(len(idx), dim, np.int32)), pa.array(cell[cut].astype(np.int32)),
                                           pa.array(home[cut]), *(batch.column(k).take(idx) for k in (1, 2, 3))],
                                          names=["label", "dim", "cell", "home", "cid", "weight", "v"])

    return classes.select("label", "cid", "weight", "v").mapInArrow(
        run, f"label int, dim int, cell int, home boolean, cid bigint, weight bigint, v {kind}")


def join_blocks(members: DataFrame, min_cosine: float, block: int) -> DataFrame:
    """Join every cell in blocks: cid, n_links (weight of linked other classes), root (of the block's forest)."""
    sizes = members.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    m = members.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    spread = m.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    left = spread.where("home").select("label", "dim", "cell", F.col("part").alias("i"), F.col("other").alias("j"), F.lit(True).alias("row"),
                                       "cid", "weight", "v")
    right = spread.select("label", "dim", "cell", F.col("other").alias("i"), F.col("part").alias("j"), F.lit(False).alias("row"),
                          "cid", "weight", "v")

    def run(t: pa.Table) -> pa.Table:
        row = t["row"].combine_chunks().to_numpy(zero_copy_only=False)
        ids = t["cid"].to_numpy()
        weight = t["weight"].to_numpy()
        v = unit(t["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(row), -1))
        a, b = np.flatnonzero(row), np.flatnonzero(~row)
        linked = (v[a] @ v[b].T >= min_cosine) & (ids[a][:, None] != ids[b][None, :])
        n = linked @ weight[b]
        root_a, root_b = ids[a].copy(), ids[b].copy()
        top = np.iinfo(np.int64).max
        while len(a) and len(b):                     # smallest id of the block's component
            new_a = np.minimum(root_a, np.where(linked, root_b[None, :], top).min(axis=1))
            new_b = np.minimum(root_b, np.where(linked, new_a[:, None], top).min(axis=0))
            if (new_a == root_a).all() and (new_b == root_b).all():
                break
            root_a, root_b = new_a, new_b
        touched = linked.any(axis=0) if len(a) else np.zeros(len(b), bool)
        return pa.table({"cid": np.concatenate([ids[a], ids[b][touched]]),
                         "n_links": np.concatenate([n.astype(np.int64), np.zeros(int(touched.sum()), np.int64)]),
                         "root": np.concatenate([root_a, root_b[touched]])})

    return left.unionAll(right).groupBy("label", "dim", "cell", "i", "j").applyInArrow(run, "cid bigint, n_links bigint, root bigint")


def link_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, cell: int = CELL, block: int = BLOCK, max_pivots: int = MAX_PIVOTS,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("int").alias("label"))
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x)) if
                           rows.schema["v"].dataType.elementType.typeName() == "float" else
                           F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = stored(classes_of(rows), "vector-classes")
    pivots = pick_pivots(classes, cell, max_pivots)
    members = cells_of(classes, pivots, float(np.sqrt(2 - 2 * min_cosine)))
    found = stored(join_blocks(members, min_cosine, block), "vector-links")
    links = found.groupBy("cid").agg(F.sum("n_links").alias("others"))
    comps = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")), "vector-components")
    per_class = (classes.select("label", "h1", "h2", "cid", "class_id", "weight").join(links, "cid", "left")
                 .join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    smallest = per_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    per_class = (per_class.join(smallest, "component")
                 .select("label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    return (rows.select("vec_id", "label", "h1", "h2").join(per_class, ["label", "h1", "h2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, reach.c FROM reach JOIN l ON reach.id = l.a),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.component_id, x.vec_id = least.component_id AS kept
FROM embeddings x JOIN least ON x.vec_id = least.id LEFT JOIN n ON n.a = x.vec_id"""
