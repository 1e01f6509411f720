"""Extraction jobs over completion and source tables.

Everything is row-local: a row's parameter list is an array column resolved
with higher-order functions, so no explode or shuffle is needed; the table form
of X7 explodes and joins the fixed 8-row type map as a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloutlab.dictionaries import SCALAR_TYPE_MAP, lit_map
from rolloutlab.functions.text import fenced_bodies, fenced_langs

# FIXED VALUES: launcher signature patterns.
LAUNCH_RE = r"(?s)void\s+launch_fused_kernel\s*\((.*?)\)"
SIZE_PARAM_RE = r"(?i)\bint\s+\w*size\w*\b"
STREAM_TYPE = "hipStream_t"
POINTER_RE = r"^(const\s+(?:float|double)\s*\*|(?:float|double)\s*\*)\s*(\w+)"
SCALAR_RE = r"^((?:unsigned\s+)?(?:float|double|int|int32_t|int64_t|bool|size_t))\s+(\w+)"
PARAM_TYPE = "array<struct<pos:int,ctype:string,name:string>>"
FIXED_CALL_PREFIX = "output.data_ptr<float>(), input.data_ptr<float>(), input.numel()"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fenced_blocks(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Every ```` ```lang ```` block of a text as a row (keys, pos, lang, body)."""
    z = F.arrays_zip(fenced_langs(col).alias("lang"), fenced_bodies(col).alias("body"))
    return (df.select(*keys, F.posexplode(z).alias("pos", "b"))
            .select(*keys, F.col("pos").cast("long").alias("pos"), "b.lang", "b.body"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made once a row: a column that is named several times in (nested) lambdas is computed as often."""
    return F.get(F.transform(F.array(value), use), 0)


def signature_params(c) -> Column:
    """The launcher's parameters strictly between the last ``int ...size...``
    and the last ``hipStream_t`` parameter, as ``array<struct<pos,ctype,name>>``.
    Empty when the launcher, either marker or any parameter between them has
    an unknown type, or the markers are adjacent/out of order."""
    c = _c(c)
    present = F.coalesce(c.rlike(LAUNCH_RE), F.lit(False))
    empty = F.array().cast(PARAM_TYPE)

    def item(p: Column, j: Column) -> Column:
        ptr = p.rlike(POINTER_RE)
        scal = p.rlike(SCALAR_RE)
        ctype = F.when(ptr, F.trim(F.regexp_extract(p, POINTER_RE, 1))).when(scal, F.regexp_extract(p, SCALAR_RE, 1))
        name = F.when(ptr, F.regexp_extract(p, POINTER_RE, 2)).when(scal, F.regexp_extract(p, SCALAR_RE, 2))
        return F.struct(j.alias("pos"), ctype.alias("ctype"), name.alias("name"))

    def marked(params: Column) -> Column:
        size_i = F.array_max(F.transform(params, lambda p, i: F.when(p.rlike(SIZE_PARAM_RE), i)))
        stream_i = F.array_max(F.transform(params, lambda p, i: F.when(p.contains(STREAM_TYPE), i)))
        return F.struct(params.alias("params"), size_i.alias("size_i"), stream_i.alias("stream_i"))

    def between(m: Column) -> Column:
        extras = F.slice(m["params"], m["size_i"] + 2, m["stream_i"] - m["size_i"] - 1)
        known = _once(F.transform(extras, item), lambda items: F.when(F.forall(items, lambda x: x["ctype"].isNotNull()), items).otherwise(empty))
        return F.when(m["stream_i"] > m["size_i"] + 1, known).otherwise(empty)      # not when a marker is missing (null)

    params = F.transform(F.split(F.regexp_replace(F.regexp_extract(c, LAUNCH_RE, 1), r"\s+", " "), ","),
                         lambda p: F.trim(p))
    return F.when(present, _once(_once(params, marked), between)).otherwise(empty).cast(PARAM_TYPE)


def _type_map() -> Column:
    return lit_map(SCALAR_TYPE_MAP)


def call_expr(ctype: Column, name: Column, host_type: Column) -> Column:
    """Argument expression passed to the launcher for one parameter."""
    is_ptr = ctype.contains("*")
    base = F.trim(F.replace(F.replace(ctype, F.lit("const"), F.lit("")), F.lit("*"), F.lit("")))
    return (F.when(is_ptr, F.concat(name, F.lit(".data_ptr<"), base, F.lit(">()")))
            .when(host_type != ctype, F.concat(F.lit("static_cast<"), ctype, F.lit(">("), name, F.lit(")")))
            .otherwise(name))


def argument_calls(params) -> Column:
    """X7 (row form): the full launcher call argument list for a parameter array."""
    tm = _type_map()

    def one(p: Column) -> Column:
        host = F.coalesce(F.try_element_at(tm, p["ctype"]), p["ctype"])
        return call_expr(p["ctype"], p["name"], host)
    extra = F.array_join(F.transform(_c(params), one), ", ")
    return F.concat(F.lit(FIXED_CALL_PREFIX),
                    F.when(F.size(_c(params)) > 0, F.concat(F.lit(", "), extra)).otherwise(F.lit("")),
                    F.lit(", stream"))


def argument_table(df: DataFrame, params_col: str, keys: list[str], type_map: DataFrame,
                   small: bool = False) -> DataFrame:
    """X7 (table form): one row per parameter with host type, pointer flag, base
    dtype, cast flag and call expression. The library's own type map has 8 rows
    and is broadcast with ``small=True``; by default adaptive execution decides
    from the table's measured size."""
    # rows without a parameter go after the explode: a filter before it would make the parameters a second time
    rows = df.select(*keys, F.explode_outer(params_col).alias("p")).where("p IS NOT NULL").select(*keys, "p.pos", "p.ctype", "p.name")
    j = rows.join(F.broadcast(type_map) if small else type_map, "ctype", "left")
    is_ptr = F.col("ctype").contains("*")
    host = F.when(is_ptr, F.lit("torch::Tensor")).otherwise(F.coalesce("host_type", "ctype"))
    return j.select(*keys, F.col("pos").cast("long").alias("pos"), "ctype", "name",
                    host.alias("host_type"), is_ptr.alias("is_pointer"),
                    F.when(is_ptr, F.trim(F.replace(F.replace("ctype", F.lit("const"), F.lit("")), F.lit("*"),
                                                    F.lit("")))).alias("base_dtype"),
                    (~is_ptr & (F.coalesce("host_type", "ctype") != F.col("ctype"))).alias("needs_cast"),
                    call_expr(F.col("ctype"), F.col("name"), F.coalesce("host_type", "ctype")).alias("call_expr"))


def arity_check(extra_params, init_names) -> Column:
    """struct(rejected, args). Rejected when both lists are non-empty and
    their lengths differ; otherwise the ``self._kp_<name>`` argument list (empty
    unless both lists are non-empty)."""
    ne, ni = F.size(_c(extra_params)), F.size(_c(init_names))
    both = (ne > 0) & (ni > 0)
    rejected = both & (ne != ni)
    args = F.when(both, F.transform(_c(init_names), lambda n: F.concat(F.lit("self._kp_"), n))) \
        .otherwise(F.array().cast("array<string>"))
    return F.struct(rejected.alias("rejected"), F.when(~rejected, args).alias("args"))
