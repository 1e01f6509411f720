"""Operator 7 against brute force over all pairs."""

import numpy as np
import pytest

from rolloutlab.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<float>, label int, weight int"        # a clashing extra column


def brute(rows, least):
    """(vec_id, n_links, component) per row by comparing all pairs."""
    n = len(rows)
    good, x = [], {}
    for i, (_, v, label, *_) in enumerate(rows):
        if label is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        good.append(i)
        x[i] = np.array(v, np.float32).astype(float)
    links = {i: set() for i in range(n)}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least:
                    links[i].add(j)
    comp = {}
    for i in range(n):
        if i in comp:
            continue
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        for k in seen:
            comp[k] = min(ids, default=None)
    return sorted(((rows[i][0], len(links[i]), comp[i]) for i in range(n)), key=repr)


def result(df):
    out = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr)


@pytest.mark.parametrize("dim,cell,block,noise", [(3, 8, 4, 0.2), (3, 10_000, 7, 0.2), (16, 20, 8, 0.3), (64, 30, 50, 0.4)])
def test_cells_equal_brute_force(spark, dim, cell, block, noise):
    rng = np.random.default_rng(dim + cell)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(220):
        v = centres[rng.integers(12)] + noise * rng.normal(size=dim) * rng.random()
        rows.append((i * 3 % 1009, [float(np.float32(c)) for c in v], int(rng.integers(2)), 1))
    rows += [(5000 + i, rows[i][1], rows[i][2], 1) for i in range(0, 220, 5)]               # exact copies
    assert result(ed.link_vectors(spark.createDataFrame(rows, SCHEMA), cell=cell, block=block)) == brute(rows, 0.93)


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 0, 1), (2, [], 0, 1), (3, [0.0, 0.0], 0, 1), (4, [1.0, None], 0, 1), (5, [1.0, nan], 0, 1), (6, [inf, 1.0], 0, 1),
            (7, [1.0, 0.0], None, 1), (8, [1.0, 0.0], 0, 1), (9, [2.0, -0.0], 0, 1), (10, [1.0, 0.0], 0, 1), (10, [1.0, 0.0], 0, 1),
            (11, [1.0, 0.0], 1, 1), (12, [1.0, 0.0, 0.0], 0, 1), (13, [1e38, 1e36], 0, 1), (13, [-1.0, 0.0], 0, 1), (None, [5.0, 0.0], 0, 1),
            (14, [0.0, 1e-30], 0, 1), (15, [0.0, 3e-30], 0, 1)]
    got = result(ed.link_vectors(spark.createDataFrame(rows, SCHEMA)))
    want = dict()
    for r in got:
        want.setdefault(r[0], []).append(r[1:])
    for lone in (1, 2, 3, 4, 5, 6, 7, 11, 12):
        assert want[lone] == [(0, lone)]
    assert want[8] == [(5, 8)] and want[10] == [(5, 8), (5, 8)] and want[None] == [(5, 8)]
    assert sorted(want[13]) == [(0, 13), (5, 8)] and want[15] == [(1, 14)]
    assert result(ed.link_vectors(spark.createDataFrame([], SCHEMA))) == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(ed.op7_embedding_dedup(spark, sf)) == brute(rows, 0.93)
