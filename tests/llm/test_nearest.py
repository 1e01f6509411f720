"""HNSW search against brute force: recall, order, ties, scores and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from rolloutlab.llm import nearest as N
from rolloutlab.llm.common import table
from rolloutlab.llm.vectext import mix

SCHEMA = "vec_id bigint, embedding array<float>"


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, queries, k=N.K):
    """query id -> [(score, id)], best first."""
    out = {}
    rows = list({(i, tuple(v)): (i, np.array(v, np.float64)) for i, v in rows if usable(v)}.values())
    for qi, q in queries:
        if qi is None or not usable(q):
            continue
        q = np.array(q, np.float64)
        found = [(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), i) for i, v in rows if i != qi and len(v) == len(q)]
        out[qi] = sorted(found, key=lambda f: (-round(f[0], 12), f[1] is None, f[1] or 0))[:k]
    return out


def run(spark, rows, queries, **how):
    build = {k: how.pop(k) for k in ("shard", "links") if k in how}
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS dim", "2 AS shard", "3 AS v", "4 AS ids")
    asked = spark.createDataFrame(queries, SCHEMA)
    got = {}
    for r in N.nearest(N.build_index(df, **build), asked, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def same(got, want):
    assert got.keys() == {k for k, v in want.items() if v}
    for q, found in got.items():
        assert [i for _, i in found] == [i for _, i in want[q]], q
        assert np.allclose([s for s, _ in found], [s for s, _ in want[q]], rtol=0, atol=1e-12)


def test_recall_of_the_query_on_its_table(spark):
    data = [(r["vec_id"], r["embedding"]) for r in table(spark, SF_MID, "embeddings").collect()]
    want = brute(data, [r for r in data if r[0] % 50 == 0])
    got = {}
    for r in N.op13_nearest_neighbours(spark, SF_MID).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q].values()} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, found in got.items():
        scores = [found[r][1] for r in range(1, len(found) + 1)]
        assert scores == sorted(scores, reverse=True)
        exact = dict((i, s) for s, i in brute(data, [r for r in data if r[0] == q], k=len(data))[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in found.values())


@pytest.mark.parametrize("spread", ["even", "clusters"])
def test_recall_within_a_large_graph(spread):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 48))
    if spread == "clusters":
        x = rng.normal(size=(40, 48))[rng.integers(0, 40, 6000)] * 3 + x * 0.3
    x = N.unit(x)
    order, layers = N.build(x, mix(np.arange(6000, dtype=np.uint64)))
    assert len(layers) > 1 and sorted(order.tolist()) == list(range(6000))
    for nodes, links in layers:                       # flat tables: places of the layer, no loops, none twice
        assert links.max() < len(nodes) and (links != np.arange(len(nodes))[:, None]).all()
        assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in links)
    x = x[order]
    q = x[::30]
    found = N.search(x.astype(np.float32), layers, q, N.SEARCH_BEAM)
    top = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(top, found)]) >= 0.95


def test_small_shards_find_all(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    same(run(spark, rows, rows[::10], shard=64, block=7), brute(rows, rows[::10]))


def test_copies_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 4)).astype(np.float32).tolist()
    rows = [(i, base[0]) for i in range(200)] + [(1000 + i, v) for i, v in enumerate(base)] + [(7, base[0])] * 3 + [(7, base[1])]
    queries = [(150, base[0]), (3, base[0]), (1002, base[2]), (7, base[0])]
    same(run(spark, rows, queries), brute(rows, queries))


def test_unusable_vectors_lengths_and_few_candidates(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]),
            (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [3e38, 3e38]), (11, [1e-38, 1e-38])]
    got = run(spark, rows, rows)
    assert [i for _, i in got[1]] == [2, 10, 11, None]
    assert got.keys() == {1, 2, 10, 11}                # 9 is alone in its length, null is no query
    assert all(abs(s - 1) < 1e-12 for s, i in got[2] if i in (10, 11))


def test_empty_table(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [(1, [1.0])]) == {}


def test_shards_are_dealt_to_many_tasks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)]
    index = N.build_index(spark.createDataFrame(rows, SCHEMA), shard=25)
    shards = index.select(F.input_file_name().alias("file"), "shard").collect()
    assert len(shards) > 8 and len({r.file for r in shards}) > 2        # each task writes a file
