"""Operator 6: discriminant against a plain reference, held-out accuracy, edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloutlab.llm import quality as q
from rolloutlab.llm.vectext import text_bytes


def test_scores_are_gaussian_log_densities(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (300, 3)) @ np.diag([1, 2, 3]), rng.normal(1, 1, (500, 3))])
    y = [0] * 300 + [1] * 500
    train = spark.createDataFrame([(r.tolist(), k) for r, k in zip(x, y)], "x array<double>, y int").repartition(5)
    model = q.fit(train, width=3, shrink=0.0, pool=0.0)
    logs = []
    for c in (0, 1):
        part = x[np.array(y) == c]
        cov = np.cov(part.T, bias=True) + np.diag(1e-4 * model.scale ** 2)
        d = x - part.mean(axis=0)
        logs.append(-0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(part)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa
    texts = ["", None, "One two.\nOne two.", "A", "x " * 30_000, "ÉÀ!! ###", "\n\n", "a b a b a b"]
    data, offsets = text_bytes(pa.array(texts))
    whole = q.statistics(data, offsets)
    assert np.isfinite(whole).all()
    for i, t in enumerate(texts):
        assert np.allclose(q.statistics(*text_bytes(pa.array([t], pa.string())))[0], whole[i]), t


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 1), (None, "text", 0), (4, "w " * 40_000, 1), (4, "again", 1)], "doc_id bigint, text string, x int")
    labels = spark.createDataFrame([(1, None, 0), (2, 7, 0), (None, 1, 0), (4, 1, 0), (4, 1, 1), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    out = q.classify(docs, labels).collect()
    assert len(out) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in out)        # no row of class 0
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert q.classify(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, sf):
    out = q.op6_quality_qda(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = (out.join(labels, "doc_id").where("held_out").groupBy("quality")
         .agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect())
    assert all(x.right > 0.98 for x in r), r
