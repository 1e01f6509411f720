"""Operator 13 - approximate nearest neighbours by HNSW graphs per shard.

1. Equal vectors are one node that carries its smallest ids, as many as a result
   can hold, so a group of copies of any size is one entry of a graph.
2. Nodes are dealt by hash to shards of about ``shard`` nodes. A task builds one
   shard's hierarchical navigable small-world graph: every node draws a top
   layer from its hash; layers are built from the top down, each in batches that
   double (a batch is searched for in the graph so far and compared with
   itself); neighbours are chosen by the diversity rule and links go both ways,
   with full lists chosen anew.
3. A shard is one row of flat arrays: ids, vectors, and per layer its nodes and
   a fixed-width table of neighbour positions. The index is written as a table.
4. Queries go to every shard of their vector length, in blocks. A task walks the
   layers for a whole block at once and scores the nodes found by the cosine in
   double precision of the original vectors. Shard results are merged by rank.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, as query or candidate; vectors of different lengths are
not compared; rows with the same id and vector are one row, different vectors
under one id are candidates of their own and queries of their own, and a query
never finds its own id; a row without an id is a candidate (null id, last among
ties) but no query; fewer candidates than ``k`` are all returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolloutlab.llm.common import shuffle_width, stored, table
from rolloutlab.llm.vectext import mix

K = 5
SHARD = 8192           # nodes a shard aims at
LINKS = 16             # neighbours of a node in upper layers; twice as many in the lowest
BUILD_BEAM = 64        # nodes a search keeps while the graph is built
SEARCH_BEAM = 192      # nodes a search keeps for a query
QUERY_BLOCK = 4096     # queries that a task searches one shard for
EVERY = 50             # the query set: ids that this divides
_LOT = 512             # walks made at a time

INDEX_SCHEMA = "dim int, shard int, ids array<array<bigint>>, vectors binary, layers array<struct<nodes:binary,links:binary>>"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps extreme values finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def walk(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for many queries at once.

    ``links`` (n, width) holds positions, -1 where free; ``entry`` (q, e) holds
    start positions. Returns positions and similarities (q, beam), best first,
    -1 where fewer were met."""
    q, n = len(queries), len(vectors)
    pos = np.full((q, beam), -1, np.int64)
    sim = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True                              # where free list places (-1) land
    at = np.arange(q)
    fresh = entry
    active = at
    while len(active):
        here = ~seen[active[:, None], fresh]
        seen[active[:, None], fresh] = True
        if fresh.shape[1] > 1:                     # a place given twice in one list counts once
            order = np.sort(fresh, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():
                for row in np.flatnonzero(((order[:, 1:] == order[:, :-1]) & (order[:, 1:] >= 0)).any(axis=1)).tolist():
                    first = np.zeros(fresh.shape[1], bool)
                    first[np.unique(fresh[row], return_index=True)[1]] = True
                    here[row] &= first
        here &= fresh >= 0
        s = np.where(here, np.einsum("qmd,qd->qm", vectors[fresh], queries[active]), np.float32(-np.inf))
        every_s = np.concatenate([sim[active], s], axis=1)
        every_p = np.concatenate([pos[active], np.where(here, fresh, -1)], axis=1)
        every_d = np.concatenate([done[active], ~here], axis=1)
        best = np.argpartition(-every_s, beam - 1, axis=1)[:, :beam]
        rows = np.arange(len(active))[:, None]
        sim[active], pos[active], done[active] = every_s[rows, best], every_p[rows, best], every_d[rows, best]
        open_sim = np.where(done[active], np.float32(-np.inf), sim[active])
        pick = open_sim.argmax(axis=1)
        alive = open_sim[np.arange(len(active)), pick] > -np.inf
        active, pick = active[alive], pick[alive]
        done[active, pick] = True
        fresh = links[pos[active, pick]]
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(pos, order, 1), np.take_along_axis(sim, order, 1)


def diverse(vectors: np.ndarray, found: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none), up to ``width`` neighbours.

    A candidate is taken if it is nearer to the node than to any neighbour taken
    before it; places left over go to the best of the rest."""
    out = np.full((len(found), width), -1, np.int64)
    for lo in range(0, len(found), 256):
        f, s = found[lo:lo + 256], sim[lo:lo + 256]
        v = vectors[f]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(f.shape, bool)
        for c in range(f.shape[1]):
            nearer = np.where(taken, between[:, c, :], -np.inf).max(axis=1)
            taken[:, c] = (f[:, c] >= 0) & (s[:, c] > nearer) & (taken.sum(axis=1) < width)
        # taken ones first, then the others, both best first; empty places last
        rank = np.where(f < 0, 2, np.where(taken, 0, 1)) * f.shape[1] + np.arange(f.shape[1])
        order = np.argsort(rank, axis=1)[:, :width]
        out[lo:lo + 256, :order.shape[1]] = np.take_along_axis(f, order, 1)
    return out


def link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, width: int) -> None:
    """Adds the links from neighbours back to the ``new`` nodes; a list that gets too long is chosen anew."""
    source = np.repeat(new, links.shape[1])
    target = links[new].ravel()
    keep = target >= 0
    source, target = source[keep], target[keep]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(nodes), 512):
        t, f, c = nodes[lo:lo + 512], first[lo:lo + 512], count[lo:lo + 512]
        more = np.full((len(t), int(c.max())), -1, np.int64)
        for i, (a, m) in enumerate(zip(f.tolist(), c.tolist())):
            more[i, :m] = source[a:a + m]
        more[(more[:, :, None] == links[t][:, None, :]).any(axis=2)] = -1     # linked already
        both = np.concatenate([links[t], more], axis=1)
        sim = np.where(both >= 0, np.einsum("tmd,td->tm", vectors[both], vectors[t]), np.float32(-np.inf))
        order = np.argsort(-sim, axis=1, kind="stable")
        both, sim = np.take_along_axis(both, order, 1), np.take_along_axis(sim, order, 1)
        over = (both >= 0).sum(axis=1) > width
        links[t[~over]] = both[~over][:, :width]
        if over.any():
            links[t[over]] = diverse(vectors, both[over][:, :4 * width], sim[over][:, :4 * width], width)


def build_layer(vectors: np.ndarray, entry: np.ndarray | None, first: int, width: int, beam: int) -> np.ndarray:
    """Neighbour table (n, width) of one layer.

    The first ``first`` nodes also stand in the layer above; ``entry`` gives each
    node its start among them (none in the top layer)."""
    n = len(vectors)
    links = np.full((n, width), -1, np.int64)
    done = 0
    while done < n:
        hi = min(n, max(first, 64) if done == 0 else done + min(done, 1024))
        new = np.arange(done, hi)
        x = vectors[new]
        inner = x @ x.T
        np.fill_diagonal(inner, -np.inf)
        m = min(beam, len(new))
        near = np.argpartition(-inner, m - 1, axis=1)[:, :m]
        found, sim = new[near], np.take_along_axis(inner, near, 1)
        found = np.where(np.isneginf(sim), -1, found)
        if done:
            start = np.minimum(entry[new], done - 1)[:, None] if entry is not None else np.zeros((len(new), 1), np.int64)
            walked = [walk(vectors[:done], links[:done], x[lo:lo + _LOT], start[lo:lo + _LOT], beam) for lo in range(0, len(x), _LOT)]
            found = np.concatenate([np.concatenate([w[0] for w in walked]), found], axis=1)
            sim = np.concatenate([np.concatenate([w[1] for w in walked]), sim], axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        links[new] = diverse(vectors, np.take_along_axis(found, order, 1), np.take_along_axis(sim, order, 1), width)
        link_back(vectors, links, new, width)
        done = hi
    return links


def build(vectors: np.ndarray, draw: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The order of the nodes in the index, and per layer from the lowest (nodes, links).

    ``draw`` holds a random 64-bit number of each node; nodes are ordered by layer
    from the top, so those of a layer are a prefix of those of the layer below."""
    u = (draw >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
    level = np.floor(-np.log1p(-u) / math.log(links)).astype(np.int64)
    order = np.lexsort((draw, -level))
    x, level = vectors[order].astype(np.float32), level[order]
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    above = 0
    for at in range(int(level.max(initial=0)), -1, -1):
        n = int((level >= at).sum())
        if at and n < 2:
            continue
        entry = None
        if layers:                                   # a node's nearest one of the layer above
            entry = descend(x, layers, x[:n])[:, 0]
        table_ = build_layer(x[:n], entry, above, links if at else 2 * links, beam)
        layers.insert(0, (np.arange(n), table_))
        above = n
    return order, layers


def descend(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int = 4) -> np.ndarray:
    """Entry places (q, 1) for the layer below the given ones, walking from the topmost."""
    entry = np.zeros((len(queries), 1), np.int64)
    for nodes, links in reversed(layers):
        n = len(nodes)
        entry = np.concatenate([walk(vectors[:n], links, queries[lo:lo + _LOT], entry[lo:lo + _LOT], beam)[0][:, :1]
                                for lo in range(0, len(queries), _LOT)]) if len(queries) else entry
    return entry


def search(vectors: np.ndarray, layers: list, queries: np.ndarray, beam: int) -> np.ndarray:
    """Places (q, beam) of the nodes met nearest to each query, -1 where fewer."""
    q = queries.astype(np.float32)
    entry = descend(vectors, layers[1:], q) if len(layers) > 1 else np.zeros((len(q), 1), np.int64)
    out = [walk(vectors, layers[0][1], q[lo:lo + _LOT], entry[lo:lo + _LOT], min(beam, len(vectors)))[0] for lo in range(0, len(q), _LOT)]
    return np.concatenate(out)


def matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """dim, v, ids: distinct usable vectors with their k + 1 smallest ids (null last)."""
    each = rows.groupBy("v", "vec_id").agg(F.size("v").alias("dim"))
    first = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = each.withColumn("r", F.row_number().over(first)).where(f"r <= {k + 1}")
    return few.groupBy("v").agg(F.first("dim").alias("dim"), F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))),
                                                                        lambda s: s["vec_id"]).alias("ids"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part (-0.0 is 0.0)."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    return rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))


def build_index(vectors: DataFrame, k: int = K, shard: int = SHARD, links: int = LINKS, beam: int = BUILD_BEAM, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """One row per shard (INDEX_SCHEMA), written in the shared folder."""
    nodes = stored(nodes_of(usable(vectors, id_col, vector_col), k), "ann-nodes")
    sizes = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = (nodes.join(sizes, "dim").withColumn("draw", F.xxhash64("v"))
             .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "draw"), "shards").cast("int")))

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        v = matrix(t["v"], dim)
        order, layers = build(unit(v), mix(t["draw"].to_numpy().view(np.uint64)), links, beam)
        rows = pa.array(order)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([t["shard"][0].as_py()], pa.int32()),
                         "ids": pa.array([t["ids"].take(rows).to_pylist()], pa.list_(pa.list_(pa.int64()))),
                         "vectors": pa.array([v[order].tobytes()], pa.binary()),
                         "layers": pa.array([[{"nodes": n.astype(np.int32).tobytes(), "links": e.astype(np.int32).tobytes()} for n, e in layers]],
                                            pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])))})

    # a shard is few bytes and much work: a fixed number of partitions keeps adaptive execution from giving many to one task
    graphs = (dealt.select("dim", "shard", "ids", "v", "draw").repartition(shuffle_width(vectors.sparkSession), "dim", "shard")
              .groupBy("dim", "shard").applyInArrow(run, INDEX_SCHEMA))
    return stored(graphs, "ann-index")


def load(row: dict) -> tuple[np.ndarray, np.ndarray, list]:
    """(vectors, unit vectors, layers) of an index row."""
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    layers = []
    for layer in row["layers"]:
        nodes = np.frombuffer(layer["nodes"], np.int32)
        layers.append((nodes, np.frombuffer(layer["links"], np.int32).astype(np.int64).reshape(len(nodes), -1)))
    return v, unit(v).astype(np.float32), layers


def nearest(index: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row."""
    rows = usable(queries, id_col, vector_col).where("vec_id IS NOT NULL").distinct().withColumn("dim", F.size("v"))
    blocks = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    asked = (rows.join(blocks, "dim").join(shards, "dim")
             .select("dim", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"), "vec_id", "v"))
    graphs = index.join(blocks, "dim").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks")

    def run(graph: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "h": [], "vec_id": [], "score": []}
        if graph.num_rows and asked.num_rows:
            row = graph.to_pylist()[0]
            ids = row["ids"]
            v, units, layers = load(row)
            wanted = asked["vec_id"].to_pylist()
            q = unit(matrix(asked["v"], row["dim"]))
            exact = unit(v)
            marks = asked["h"].to_pylist()
            places = search(units, layers, q, max(beam, k + 1))
            for i, found in enumerate(places):
                found = found[found >= 0]
                score = (exact[found] * q[i]).sum(axis=1)
                best = sorted(((-s, x is None, x) for p, s in zip(found.tolist(), score.tolist()) for x in ids[p] if x != wanted[i]),
                              key=lambda c: c[:2] if c[2] is None else (*c[:2], c[2]))[:k]
                out["query_id"] += [wanted[i]] * len(best)
                out["h"] += [marks[i]] * len(best)
                out["vec_id"] += [b[2] for b in best]
                out["score"] += [-b[0] for b in best]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "h": pa.array(out["h"], pa.int64()),
                         "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ("dim", "shard", "block")
    width = shuffle_width(index.sparkSession)
    found = (graphs.repartition(width, *keys).groupBy(*keys).cogroup(asked.withColumn("h", F.xxhash64("v")).repartition(width, *keys).groupBy(*keys))
             .applyInArrow(run, "query_id bigint, h bigint, vec_id bigint, score double"))
    place = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(place)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(build_index(vectors), vectors.where(f"vec_id % {EVERY} = 0"))
