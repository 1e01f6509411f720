"""The launcher signatures: read once a row, on all cores, with the results of a plain reading."""

import re

from conftest import SF_SMALL
from rolloutlab.dictionaries import type_map_table
from rolloutlab.operators import extraction as X
from rolloutlab.sources import fixtures as fx


def python_params(text):
    """Plain twin of ``signature_params``."""
    m = re.search(r"void\s+launch_fused_kernel\s*\((.*?)\)", text or "", re.S)
    params = [p.strip(" ") for p in re.sub(r"\s+", " ", m.group(1)).split(",")] if m else []
    size = [i for i, p in enumerate(params) if re.search(r"(?i)\bint\s+\w*size\w*\b", p)]
    stream = [i for i, p in enumerate(params) if "hipStream_t" in p]
    if not size or not stream or stream[-1] <= size[-1] + 1:
        return []
    out = []
    for j, p in enumerate(params[size[-1] + 1:stream[-1]]):
        m = re.match(X.POINTER_RE, p) or re.match(X.SCALAR_RE, p)
        if not m:
            return []
        out.append((j, m.group(1).strip(" "), m.group(2)))
    return out


def test_signature_params_on_odd_texts_equal_a_plain_reading(spark):
    inner = ["", "int size", "hipStream_t s", "int size, hipStream_t s", "hipStream_t s, int size, float a", "int size, float a, hipStream_t s",
             "int size,\n const  float * w,\tint n, hipStream_t s", "int size, custom_t q, float a, hipStream_t s", "int size, , hipStream_t s",
             "int a_size, int size, bool b, hipStream_t s, float c, hipStream_t t", "float a, hipStream_t s", "int size, float, hipStream_t s"]
    texts = [None, "", "void other(int size, float a, hipStream_t s)"] + [f"x void launch_fused_kernel ({p}) {{}} void launch_fused_kernel()" for p in inner]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("params", X.signature_params("t"))
    want = {i: python_params(t) for i, t in enumerate(texts)}
    assert {r["id"]: [tuple(p) for p in r["params"]] for r in df.collect()} == want
    table = X.argument_table(df, "params", ["id"], type_map_table(spark))
    assert sorted((r["id"], r["pos"], r["ctype"], r["name"]) for r in table.collect()) == sorted((i, *p) for i, ps in want.items() for p in ps)


def test_argument_table_reads_each_signature_once_on_all_cores(spark):
    sig = fx.v_signatures(spark, SF_SMALL)
    assert sig.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))       # before: one, that of the file
    table = X.argument_table(sig.select("model_id", X.signature_params("kernel_code").alias("params")), "params", ["model_id"], type_map_table(spark))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 1 + 4                  # the launcher's list once, type and name of two patterns (before: dozens, with the filter)
