"""Vector, normalisation and matrix queries: V1-V24, N1-N7, M1-M3.

Each vector query applies its function to every embedding and aggregates per
label (row-local ``aggregate`` per vector, then one partial aggregation), so
the whole table takes part without exploding it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.functions import vectors as V
from rolloutlab.operators import matrix as M
from rolloutlab.plans import sqlkit as S
from rolloutlab.plans.registry import register
from rolloutlab.sources import fixtures as fx
from rolloutlab.sources.tables import read_table

INF = float("inf")


def D(v: float) -> str:
    return f"{float(v)!r}::DOUBLE"


def _erf_sql(z: str) -> str:
    a = V.ERF_A
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {D(V.ERF_P)} * abs({z})))"
    poly = f"{t} * ({D(a[0])} + {t} * ({D(a[1])} + {t} * ({D(a[2])} + {t} * ({D(a[3])} + {t} * {D(a[4])}))))"
    y = f"(1.0::DOUBLE - {poly} * exp(-abs({z}) * abs({z})))"
    return f"(CASE WHEN {z} < 0 THEN -{y} ELSE {y} END)"


POS = "(e > 0 AND NOT isnan(e))"
# SQL twins of the element functions (lambda variable ``e``).
UNARY_SQL = {
    "relu": f"CASE WHEN {POS} THEN e ELSE 0.0::DOUBLE END",
    "gelu": f"0.5::DOUBLE * e * (1.0::DOUBLE + {_erf_sql('(e / sqrt(2.0::DOUBLE))')})",
    "silu": "e / (1.0::DOUBLE + exp(-e))",
    "sigmoid": "1.0::DOUBLE / (1.0::DOUBLE + exp(-e))",
    "tanh": "tanh(e)",
    "elu": f"CASE WHEN {POS} THEN e ELSE exp(e) - 1.0::DOUBLE END",
    "exp": "exp(e)",
    "log": "CASE WHEN e > 0 THEN ln(e) WHEN e = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END",
    "abs": "abs(e)",
    "neg": "-e",
    "clamp": "least(greatest(e, -1.0::DOUBLE), 1.0::DOUBLE)",
    "where": "CASE WHEN coalesce(e > 0, false) THEN e ELSE e * 0.5::DOUBLE END",
    "pow": "pow(e, 3.0::DOUBLE)",
    "square": "e * e",
    "reciprocal": "CASE WHEN e = 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE / e END",
    "sign": f"CASE WHEN {POS} THEN 1.0::DOUBLE WHEN e < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "leaky_relu": f"CASE WHEN {POS} THEN e ELSE 0.01::DOUBLE * e END",
    "hardswish": "e * least(greatest(e + 3.0::DOUBLE, 0.0::DOUBLE), 6.0::DOUBLE) / 6.0::DOUBLE",
    "hardsigmoid": "least(greatest(e / 6.0::DOUBLE + 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)",
    "mish": "e * tanh(CASE WHEN e > 20 THEN e ELSE ln(1.0::DOUBLE + exp(e)) END)",
    "affine": "e * 0.5::DOUBLE + 0.1::DOUBLE",
}
IDS = {"relu": "V1", "gelu": "V2", "silu": "V3", "sigmoid": "V4", "tanh": "V5", "elu": "V6", "exp": "V7",
       "log": "V8", "abs": "V9", "neg": "V10", "clamp": "V11", "where": "V12", "pow": "V13", "square": "V13",
       "reciprocal": "V14", "sign": "V15", "leaky_relu": "V16", "hardswish": "V17", "hardsigmoid": "V18",
       "mish": "V19", "affine": "V24"}


def _finite(y: Column) -> Column:
    return ~F.isnan(y) & (F.abs(y) != F.lit(INF))


def _vector_summary(df: DataFrame, arr: str = "y", key: str = "label") -> DataFrame:
    """Per ``key``: element count, sum of finite elements, sum of squares, NaN count."""
    fin = F.filter(arr, _finite)
    per = df.select(key, F.size(arr).alias("_n"),
                    F.aggregate(fin, F.lit(0.0), lambda s, x: s + x).alias("_t"),
                    F.aggregate(fin, F.lit(0.0), lambda s, x: s + x * x).alias("_q"),
                    F.size(F.filter(arr, lambda x: F.isnan(x))).alias("_nan"))
    return per.groupBy(key).agg(F.sum("_n").cast("long").alias("n_elems"), F.sum("_t").alias("total"),
                                F.sum("_q").alias("total_sq"), F.sum("_nan").cast("long").alias("n_nan"))


def _summary_sql(expr_list: str, src: str = "v_vectors", key: str = "label") -> str:
    return f"""SELECT {key}, CAST(count(*) AS BIGINT) AS n_elems, coalesce(sum(y) FILTER (WHERE isfinite(y)), 0.0) AS total,
       coalesce(sum(y * y) FILTER (WHERE isfinite(y)), 0.0) AS total_sq, CAST(count_if(isnan(y)) AS BIGINT) AS n_nan
FROM (SELECT {key}, unnest({expr_list}) AS y FROM {src}) GROUP BY {key}"""


# Inputs are shifted by this amount for functions with a pole at 0, so the
# per-label totals stay in a range where float summation order cannot show.
SHIFT = {"reciprocal": 2.0}


def _make_unary(name: str):
    fn = V.UNARY[name]

    def q(spark: SparkSession, sf: str) -> DataFrame:
        v = fx.v_vectors(spark, sf)
        if name in SHIFT:
            v = v.withColumn("x", F.transform("x", lambda e: e + F.lit(SHIFT[name])))
        return _vector_summary(V.map_column(v, "x", fn, "y"))
    q.__name__ = f"q_vec_{name}"
    q.__doc__ = f"{IDS[name]} {name}: applied to every embedding, summarised per label."
    return q


for _name, _sql in UNARY_SQL.items():
    _arg = f"list_transform(x, lambda e: e + {D(SHIFT[_name])})" if _name in SHIFT else "x"
    register(f"vec_{_name}", [IDS[_name]], S.with_("v_vectors", body=_summary_sql(
        f"list_transform({_arg}, lambda e: {_sql})")))(_make_unary(_name))


BINARY_SQL = {"add": ("V20", "a[i] + b[i]"), "subtract": ("V21", "a[i] - b[i]"),
              "multiply": ("V22", "a[i] * b[i]"), "axpy": ("V23", "2.0::DOUBLE * a[i] + b[i]")}
_PAIRS_SQL = """pr AS (SELECT va.vec_id, va.label, va.x AS a, vb.x AS b
  FROM v_vectors va JOIN v_vectors vb ON vb.vec_id = va.vec_id + 1)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("b"))
    return v.select("vec_id", "label", F.col("x").alias("a")).join(b, "vec_id")


def _make_binary(name: str):
    fn = V.BINARY[name]

    def q(spark: SparkSession, sf: str) -> DataFrame:
        p = _pairs(spark, sf)
        return _vector_summary(p.withColumn("y", V.zip_columns("a", "b", fn)))
    q.__name__ = f"q_vec_{name}"
    return q


for _name, (_id, _sql) in BINARY_SQL.items():
    register(f"vec_{_name}", [_id], S.with_("v_vectors", _PAIRS_SQL, body=_summary_sql(
        f"list_transform(range(1, len(a) + 1), lambda i: {_sql})", "pr")))(_make_binary(_name))


# ---------------------------------------------------------------- N1-N7
@register("reduce_vectors", ["N1"], S.with_("v_vectors", body="""SELECT label, sum(list_sum(x)) AS sum_of_sums,
       avg(list_avg(x)) AS mean_of_means, max(list_max(x)) AS max_elem, min(list_min(x)) AS min_elem,
       sum(list_reduce(x, lambda p, q: p * q)) AS sum_of_prods
FROM v_vectors GROUP BY label"""))
def q_reduce_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    per = v.select("label", V.reduce_vector("x", "sum").alias("s"), V.reduce_vector("x", "mean").alias("m"),
                   V.reduce_vector("x", "max").alias("mx"), V.reduce_vector("x", "min").alias("mn"),
                   V.reduce_vector("x", "prod").alias("p"))
    return per.groupBy("label").agg(F.sum("s").alias("sum_of_sums"), F.avg("m").alias("mean_of_means"),
                                    F.max("mx").alias("max_elem"), F.min("mn").alias("min_elem"),
                                    F.sum("p").alias("sum_of_prods"))


@register("reduce_rows", ["N1"], """SELECT user_id, sum(value) AS value_sum, avg(value) AS value_mean,
       max(value) AS value_max, min(value) AS value_min FROM events GROUP BY user_id""")
def q_reduce_rows(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", "user_id", "value")
    r = M.reduce_rows(ev, ["user_id"], "value", ("sum", "mean", "max", "min"))
    return r


@register("reduce_rows_prod", ["N1"], """SELECT l_orderkey, sum(l_quantity) AS l_quantity_sum, product(l_quantity) AS l_quantity_prod
FROM lineitem GROUP BY l_orderkey""")
def q_reduce_rows_prod(spark: SparkSession, sf: str) -> DataFrame:
    """Products stay exact: an order has few lines of at most 50 pieces."""
    return M.reduce_rows(read_table(spark, sf, "lineitem", "l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity", ("sum", "prod"))


def _norm_sql(per_vector: str) -> str:
    return S.with_("v_vectors", body=_summary_sql(per_vector))


_MEAN = "list_avg(x)"
_VAR = "(list_sum(list_transform(x, lambda e: (e - list_avg(x)) * (e - list_avg(x)))) / len(x))"
_MS = "(list_sum(list_transform(x, lambda e: e * e)) / len(x))"
_SUMEXP = "list_sum(list_transform(x, lambda e: exp(e - list_max(x))))"


@register("layer_norm", ["N2"], _norm_sql(f"list_transform(x, lambda e: (e - {_MEAN}) / sqrt({_VAR} + 1e-5::DOUBLE))"))
def q_layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    return _vector_summary(v.withColumn("y", V.layer_norm(F.col("x"))))


@register("rms_norm", ["N3"], _norm_sql(f"list_transform(x, lambda e: e / sqrt({_MS} + 1e-5::DOUBLE))"))
def q_rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    return _vector_summary(v.withColumn("y", V.rms_norm(F.col("x"))))


@register("softmax", ["N4"], _norm_sql(f"list_transform(x, lambda e: exp(e - list_max(x)) / {_SUMEXP})"))
def q_softmax(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    return _vector_summary(v.withColumn("y", V.softmax(F.col("x"))))


@register("log_softmax", ["N5"], _norm_sql(f"list_transform(x, lambda e: e - list_max(x) - ln({_SUMEXP}))"))
def q_log_softmax(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    return _vector_summary(v.withColumn("y", V.log_softmax(F.col("x"))))


@register("softmax_rows", ["N4", "N5"], """WITH mx AS (SELECT user_id, max(value) AS m FROM events GROUP BY user_id),
se AS (SELECT e.event_id, e.user_id, e.value, exp(e.value - mx.m) AS ex, mx.m FROM events e JOIN mx USING (user_id))
SELECT event_id, user_id, ex / sum(ex) OVER (PARTITION BY user_id) AS softmax,
       value - m - ln(sum(ex) OVER (PARTITION BY user_id)) AS log_softmax
FROM se""")
def q_softmax_rows(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", "event_id", "user_id", "value")
    s = M.softmax_rows(ev, ["user_id"], "value", log_out="log_softmax")
    return s.select("event_id", "user_id", "softmax", "log_softmax")


@register("batch_norm", ["N6"], S.with_("v_vectors", """fs AS (SELECT i, avg(x[i]) AS m, var_pop(x[i]) AS v
  FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM v_vectors) GROUP BY i)""",
    """st AS (SELECT list(m ORDER BY i) AS ms, list(v ORDER BY i) AS vs FROM fs)""",
    body=_summary_sql("list_transform(range(1, len(x) + 1), lambda i: (x[i] - ms[i]) / sqrt(vs[i] + 1e-5::DOUBLE))",
                      "v_vectors, st")))
def q_batch_norm(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    return _vector_summary(M.batch_norm(v, "x", out="y"))


_G = 8
_GMEAN = f"list_avg(x[((i - 1) // {64 // _G}) * {64 // _G} + 1 : ((i - 1) // {64 // _G} + 1) * {64 // _G}])"
_GSLICE = f"x[((i - 1) // {64 // _G}) * {64 // _G} + 1 : ((i - 1) // {64 // _G} + 1) * {64 // _G}]"


@register("group_norm", ["N7"], _norm_sql(
    f"list_transform(range(1, len(x) + 1), lambda i: (x[i] - {_GMEAN}) / sqrt("
    f"list_sum(list_transform({_GSLICE}, lambda e: (e - {_GMEAN}) * (e - {_GMEAN}))) / {64 // _G} + 1e-5::DOUBLE))"))
def q_group_norm(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.v_vectors(spark, sf)
    return _vector_summary(v.withColumn("y", V.group_norm(F.col("x"), _G)))


# ---------------------------------------------------------------- M1-M3
@register("matmul", ["M1"], S.with_("v_matrix", body="""SELECT a.i, b.j, sum(a.v * b.v) AS v
FROM v_matrix_a a JOIN v_matrix_b b ON a.k = b.k GROUP BY a.i, b.j"""))
def q_matmul(spark: SparkSession, sf: str) -> DataFrame:
    return M.matmul(fx.v_matrix_a(spark, sf), fx.v_matrix_b(spark, sf))


_BMM_SQL = """ba AS (SELECT l_returnflag AS batch, l_suppkey AS i, l_partkey AS k, sum(l_quantity) AS v
  FROM lineitem GROUP BY ALL),
bb AS (SELECT l_returnflag AS batch, l_partkey AS k, CAST(l_linenumber AS BIGINT) AS j, sum(l_discount) AS v
  FROM lineitem GROUP BY ALL)"""


@register("bmm", ["M1"], S.with_(_BMM_SQL, body="""SELECT ba.batch, ba.i, bb.j, sum(ba.v * bb.v) AS v
FROM ba JOIN bb ON ba.batch = bb.batch AND ba.k = bb.k GROUP BY ALL"""))
def q_bmm(spark: SparkSession, sf: str) -> DataFrame:
    """M1 batched: one product per return flag (the batch key joins with k)."""
    li = read_table(spark, sf, "lineitem", "l_returnflag", "l_suppkey", "l_partkey", "l_linenumber",
                    "l_quantity", "l_discount")
    a = li.select(F.col("l_returnflag").alias("batch"), F.col("l_suppkey").alias("i"),
                  F.col("l_partkey").alias("k"), F.col("l_quantity").alias("v"))
    b = li.select(F.col("l_returnflag").alias("batch"), F.col("l_partkey").alias("k"),
                  F.col("l_linenumber").cast("long").alias("j"), F.col("l_discount").alias("v"))
    return M.matmul(a, b, batch=["batch"])


_C_SQL = """mc AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_tax) AS v FROM lineitem GROUP BY ALL)"""


def _mc(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem", "l_suppkey", "l_linenumber", "l_tax")
    return li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(
        F.sum("l_tax").alias("v"))


@register("addmm", ["M1"], S.with_("v_matrix", _C_SQL, """ab AS (SELECT a.i, b.j, sum(a.v * b.v) AS v
  FROM v_matrix_a a JOIN v_matrix_b b ON a.k = b.k GROUP BY a.i, b.j)""",
    body="""SELECT coalesce(ab.i, mc.i) AS i, coalesce(ab.j, mc.j) AS j,
       0.5::DOUBLE * coalesce(mc.v, 0.0) + 2.0::DOUBLE * coalesce(ab.v, 0.0) AS v
FROM ab FULL OUTER JOIN mc ON ab.i = mc.i AND ab.j = mc.j"""))
def q_addmm(spark: SparkSession, sf: str) -> DataFrame:
    return M.addmm(_mc(spark, sf), fx.v_matrix_a(spark, sf), fx.v_matrix_b(spark, sf), alpha=2.0, beta=0.5)


@register("linear", ["M1"], S.with_("v_matrix", """ab AS (SELECT a.i, b.j, sum(a.v * b.v) AS v
  FROM v_matrix_a a JOIN v_matrix_b b ON a.k = b.k GROUP BY a.i, b.j)""",
    """bias AS (SELECT j, avg(v) AS v FROM v_matrix_b GROUP BY j)""",
    body="SELECT ab.i, ab.j, ab.v + coalesce(bias.v, 0.0) AS v FROM ab LEFT JOIN bias USING (j)"))
def q_linear(spark: SparkSession, sf: str) -> DataFrame:
    b = fx.v_matrix_b(spark, sf)
    bias = b.groupBy("j").agg(F.avg("v").alias("v"))
    return M.linear(fx.v_matrix_a(spark, sf), b, bias)


@register("conv1x1", ["M2"], S.with_("v_matrix", """cx AS (SELECT l_returnflag AS batch, l_partkey AS c_in,
         l_suppkey AS p, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)""",
    body="""SELECT cx.batch, w.j AS c_out, cx.p, sum(cx.v * w.v) AS v
FROM cx JOIN v_matrix_b w ON w.k = cx.c_in GROUP BY ALL"""))
def q_conv1x1(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem", "l_returnflag", "l_partkey", "l_suppkey", "l_quantity")
    x = li.select(F.col("l_returnflag").alias("batch"), F.col("l_partkey").alias("c_in"),
                  F.col("l_suppkey").alias("p"), F.col("l_quantity").alias("v"))
    w = fx.v_matrix_b(spark, sf).select(F.col("j").alias("c_out"), F.col("k").alias("c_in"), "v")
    return M.conv1x1(x, w)


def _series_pool(spark: SparkSession, sf: str, kind: str, size=None, blocks=None) -> DataFrame:
    s = fx.v_series(spark, sf)
    return M.pool(s, ["series_id"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("seq")], "value", kind,
                  size=size, blocks=blocks)


@register("max_pool", ["M3"], S.with_("v_series", body="""SELECT series_id, CAST(floor((rn - 1) / 4) AS BIGINT) AS block,
       max(value) AS max_pool, count(*) AS block_n
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS rn FROM v_series) GROUP BY ALL"""))
def q_max_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _series_pool(spark, sf, "max", size=4)


@register("adaptive_avg_pool", ["M3"], S.with_("v_series", body="""SELECT series_id, CAST(nt - 1 AS BIGINT) AS block,
       avg(value) AS avg_pool, count(*) AS block_n
FROM (SELECT *, ntile(5) OVER (PARTITION BY series_id ORDER BY ts, seq) AS nt FROM v_series) GROUP BY ALL"""))
def q_adaptive_avg_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _series_pool(spark, sf, "avg", blocks=5)
