"""Text-extraction queries over completions, launcher sources and documents:
X1-X9, X12, X13, F1, F2, P6, P7, P9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.dictionaries import type_map_table
from rolloutlab.functions import text as TX
from rolloutlab.operators import checks as K
from rolloutlab.operators import extraction as X
from rolloutlab.operators import prompts as P
from rolloutlab.plans import sqlkit as S
from rolloutlab.plans.prepare import CHAT_CTE, _chat, _match_sql, _samples_sql
from rolloutlab.plans.registry import register
from rolloutlab.plans.scoring import CHECKS_SQL, _kernel_sql, _py_sql
from rolloutlab.sources import fixtures as fx
from rolloutlab.sources.tables import read_table

# RE2 twins of the Spark patterns (no (?d) flag in RE2).
HEADER_RE2 = r"(?m)^[ \t*#`-]*(?:kernels/)?fused_kernel\.hip[ \t*#`:\-()]*$"
NAMED_RE2 = (r"(?ms)^[ \t]*\*\*kernels/fused_kernel\.hip\*\*[ \t]*\n(?:[ \t]*\n)*[ \t]*```[^\n]*(?:\n|\z)"
             r"(.*?)(?:^[ \t]*```|\z)")
FENCED_RE2 = r"(?s)```(\w*)\n(.*?)\n```"
LINE_BREAK_RE2 = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _comp(spark: SparkSession, sf: str) -> DataFrame:
    return fx.v_completions(spark, sf)


@register("normalise_header", ["X1"], S.with_("v_completions", body=f"""SELECT prompt_id, generation,
       regexp_replace(completion, {q(HEADER_RE2)}, '**kernels/fused_kernel.hip**', 'g') AS normalised
FROM v_completions"""))
def q_normalise_header(spark: SparkSession, sf: str) -> DataFrame:
    return _comp(spark, sf).select("prompt_id", "generation", TX.normalise_header("completion").alias("normalised"))


@register("named_block", ["X2", "X1"], S.with_("v_completions", f"""nb AS (SELECT prompt_id, generation,
         regexp_replace(completion, {q(HEADER_RE2)}, '**kernels/fused_kernel.hip**', 'g') AS nt FROM v_completions)""",
    body=f"""SELECT prompt_id, generation, coalesce(regexp_matches(nt, {q(NAMED_RE2)}), false) AS found,
       regexp_replace(regexp_extract(nt, {q(NAMED_RE2)}, 1), '\\n\\z', '') AS body FROM nb"""))
def q_named_block(spark: SparkSession, sf: str) -> DataFrame:
    nb = TX.named_block(TX.normalise_header("completion"))
    return _comp(spark, sf).select("prompt_id", "generation", nb["found"].alias("found"), nb["body"].alias("body"))


@register("fenced_blocks", ["X3"], S.with_("v_completions", f"""fb AS (SELECT prompt_id, generation,
         regexp_extract_all(completion, {q(FENCED_RE2)}, 1) AS langs,
         regexp_extract_all(completion, {q(FENCED_RE2)}, 2) AS bodies FROM v_completions)""",
    body="""SELECT prompt_id, generation, CAST(i - 1 AS BIGINT) AS pos, langs[i] AS lang, bodies[i] AS body
FROM (SELECT *, unnest(range(1, len(langs) + 1)) AS i FROM fb)"""))
def q_fenced_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return X.fenced_blocks(_comp(spark, sf), "completion", ["prompt_id", "generation"])


def _kernel_cte() -> str:
    kexpr, norm = _kernel_sql("completion")
    return f"""kt AS (SELECT prompt_id, generation, completion, {kexpr} AS kernel
  FROM (SELECT *, {norm} AS nt FROM v_completions))"""


@register("kernel_source", ["X4", "X1", "X2", "X3"], S.with_("v_completions", _kernel_cte(), body="""SELECT prompt_id,
       generation, kernel IS NOT NULL AS has_hip, kernel FROM kt"""))
def q_kernel_source(spark: SparkSession, sf: str) -> DataFrame:
    ks = TX.kernel_source("completion")
    return _comp(spark, sf).select("prompt_id", "generation", ks["has_hip"].alias("has_hip"),
                                   ks["kernel"].alias("kernel"))


@register("ensure_prefix", ["P6", "X4"], S.with_("v_completions", _kernel_cte(), body="""SELECT prompt_id, generation,
       CASE WHEN contains(kernel, 'hip_runtime.h') THEN kernel ELSE '#include <hip/hip_runtime.h>' || chr(10) || kernel END
         AS kernel_file FROM kt WHERE kernel IS NOT NULL"""))
def q_ensure_prefix(spark: SparkSession, sf: str) -> DataFrame:
    ks = TX.kernel_source("completion")
    k = _comp(spark, sf).select("prompt_id", "generation", ks["kernel"].alias("kernel")).where(F.col("kernel").isNotNull())
    return k.select("prompt_id", "generation", TX.ensure_prefix("kernel").alias("kernel_file"))


@register("python_source", ["X5"], S.with_("v_completions", body=f"""SELECT prompt_id, generation,
       {_py_sql('completion')} IS NOT NULL AS has_python, {_py_sql('completion')} AS code FROM v_completions"""))
def q_python_source(spark: SparkSession, sf: str) -> DataFrame:
    py = TX.python_source("completion")
    return _comp(spark, sf).select("prompt_id", "generation", py.isNotNull().alias("has_python"), py.alias("code"))


_STRICT_RE2 = r"\A\*\*kernels/fused_kernel\.hip\*\*\n```cpp\n[\s\S]*?\n```\n<END_OF_OUTPUT>\z"


@register("completion_predicates", ["F1", "F2"], S.with_("v_completions", body=f"""SELECT prompt_id, generation,
       coalesce(length(trim(completion, {S.WS})) >= 20, false) AS scorable,
       coalesce(regexp_matches(completion, {q(_STRICT_RE2)}), false) AS strict
FROM v_completions"""))
def q_completion_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return _comp(spark, sf).select("prompt_id", "generation", TX.scorable("completion").alias("scorable"),
                                   TX.strict_format("completion").alias("strict"))


_STOPS = ["<END_OF_OUTPUT>", "\n}\n"]


@register("truncate_at_stop", ["P7"], S.with_("v_completions", f"""ts AS (SELECT prompt_id, generation, completion,
         CASE WHEN strpos(completion, '<END_OF_OUTPUT>') > 0 THEN strpos(completion, '<END_OF_OUTPUT>') END AS p0,
         CASE WHEN strpos(completion, chr(10) || '}}' || chr(10)) > 0 THEN strpos(completion, chr(10) || '}}' || chr(10)) END AS p1
  FROM v_completions)""",
    body="""SELECT prompt_id, generation,
       CASE WHEN p0 IS NULL AND p1 IS NULL THEN completion
            WHEN p1 IS NULL OR (p0 IS NOT NULL AND p0 <= p1) THEN substr(completion, 1, p0 - 1 + 15)
            ELSE substr(completion, 1, p1 - 1 + 3) END AS text,
       p0 IS NOT NULL OR p1 IS NOT NULL AS terminated
FROM ts"""))
def q_truncate_at_stop(spark: SparkSession, sf: str) -> DataFrame:
    t = TX.truncate_at_stop("completion", _STOPS, include_stop=True)
    return _comp(spark, sf).select("prompt_id", "generation", t["text"].alias("text"),
                                   t["terminated"].alias("terminated"))


@register("next_turn_prompt", ["P9", "P3", "A1"], S.with_(
    "v_samples", "v_checks", CHECKS_SQL, _samples_sql(), *_match_sql(), CHAT_CTE,
    body="""SELECT chat.sample_id, CAST(len(msgs) + CASE WHEN ver.model_id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_messages,
       CASE WHEN ver.model_id IS NOT NULL THEN 'user' ELSE msgs[len(msgs)].role END AS last_role,
       CASE WHEN ver.model_id IS NULL THEN msgs[len(msgs)].content
            WHEN ver.verdict = 'PASS' THEN '[PASS] verify success'
            WHEN ver.verdict = 'PARTIAL_PASS' THEN '[PARTIAL_PASS] ' || ver.pass_count || '/5 passed, ' || ver.shape_ok_count || '/5 shape-correct'
            WHEN ver.verdict = 'SHAPE_OK' THEN '[SHAPE_OK] ' || ver.shape_ok_count || '/5 shape-correct, AVG_MSE='
            ELSE '[FAIL] verify failed' END AS last_content,
       CASE WHEN ver.verdict = 'SHAPE_OK' THEN ver.avg_mse END AS last_mse,
       CASE WHEN ver.model_id IS NOT NULL THEN ver.verdict ELSE NULL END AS feedback_verdict
FROM (SELECT sample_id, from_json(prompt, '[{"role":"VARCHAR","content":"VARCHAR"}]') AS msgs FROM chat) chat
LEFT JOIN ver ON ver.model_id = chat.sample_id"""))
def q_next_turn_prompt(spark: SparkSession, sf: str) -> DataFrame:
    from rolloutlab.sources.samples import MESSAGES
    chat = _chat(spark, sf).select("sample_id", F.from_json("prompt", MESSAGES).alias("messages"))
    ru = K.roll_up_checks(fx.v_checks(spark, sf)).select(
        F.col("model_id").alias("sample_id"), "verdict", K.render_verify_log().alias("feedback"))
    j = chat.join(ru, "sample_id", "left")
    msgs = F.when(F.col("feedback").isNotNull(), P.next_turn_prompt("messages", "feedback")).otherwise(F.col("messages"))
    return j.select("sample_id", F.size(msgs).cast("long").alias("n_messages"),
                    F.element_at(msgs, -1)["role"].alias("last_role"),
                    # the number behind AVG_MSE= is compared as a number
                    F.regexp_replace(F.element_at(msgs, -1)["content"], "AVG_MSE=.*$", "AVG_MSE=").alias("last_content"),
                    F.regexp_extract(F.element_at(msgs, -1)["content"], "AVG_MSE=(.*)$", 1).try_cast("double").alias("last_mse"),
                    F.when(F.col("feedback").isNotNull(), F.col("verdict")).alias("feedback_verdict"))


# ---------------------------------------------------------------- launcher signatures
_SIG_SQL = r"""sg AS (SELECT model_id, kernel_code, model_code,
         coalesce(regexp_matches(kernel_code, '(?s)void\s+launch_fused_kernel\s*\((.*?)\)'), false) AS present,
         list_transform(string_split(regexp_replace(regexp_extract(kernel_code,
             '(?s)void\s+launch_fused_kernel\s*\((.*?)\)', 1), '\s+', ' ', 'g'), ','), lambda p: trim(p)) AS params
  FROM v_signatures),
sx AS (SELECT *, list_max(list_transform(params, lambda p, i: CASE WHEN regexp_matches(p, '(?i)\bint\s+\w*size\w*\b') THEN i END)) AS si,
              list_max(list_transform(params, lambda p, i: CASE WHEN contains(p, 'hipStream_t') THEN i END)) AS ti
  FROM sg),
se AS (SELECT *, CASE WHEN present AND si IS NOT NULL AND ti IS NOT NULL AND ti > si + 1 THEN params[si + 1:ti - 1] ELSE [] END AS extras
  FROM sx),
si AS (SELECT model_id, model_code, list_transform(extras, lambda p, j: {
          'pos': CAST(j - 1 AS INTEGER),
          'ctype': CASE WHEN regexp_matches(p, '^(const\s+(?:float|double)\s*\*|(?:float|double)\s*\*)\s*(\w+)')
                        THEN trim(regexp_extract(p, '^(const\s+(?:float|double)\s*\*|(?:float|double)\s*\*)\s*(\w+)', 1))
                        WHEN regexp_matches(p, '^((?:unsigned\s+)?(?:float|double|int|int32_t|int64_t|bool|size_t))\s+(\w+)')
                        THEN regexp_extract(p, '^((?:unsigned\s+)?(?:float|double|int|int32_t|int64_t|bool|size_t))\s+(\w+)', 1) END,
          'name': CASE WHEN regexp_matches(p, '^(const\s+(?:float|double)\s*\*|(?:float|double)\s*\*)\s*(\w+)')
                        THEN regexp_extract(p, '^(const\s+(?:float|double)\s*\*|(?:float|double)\s*\*)\s*(\w+)', 2)
                        WHEN regexp_matches(p, '^((?:unsigned\s+)?(?:float|double|int|int32_t|int64_t|bool|size_t))\s+(\w+)')
                        THEN regexp_extract(p, '^((?:unsigned\s+)?(?:float|double|int|int32_t|int64_t|bool|size_t))\s+(\w+)', 2) END}) AS items
  FROM se),
sp AS (SELECT model_id, model_code, CASE WHEN coalesce(list_bool_and(list_transform(items, lambda x: x.ctype IS NOT NULL)), true)
                               THEN items ELSE [] END AS params FROM si)"""

_INIT_SQL = r"""ip AS (SELECT model_id, list_transform(list_filter(list_transform(string_split(
         regexp_extract(model_code, 'def __init__\(self(?:,\s*(.*?))?\)\s*:', 1), ','), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))),
         lambda p: p <> ''), lambda p: trim(split_part(trim(split_part(p, '=', 1), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), ':', 1),
         ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS names
  FROM v_signatures)"""


def _sig(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.v_signatures(spark, sf)
    return s.select("model_id", X.signature_params("kernel_code").alias("params"),
                    TX.init_params("model_code").alias("names"))


@register("signature_params", ["X6"], S.with_("v_signatures", _SIG_SQL, body="""SELECT model_id,
       CAST(len(params) AS BIGINT) AS n_params,
       array_to_string(list_transform(params, lambda x: x.ctype || ' ' || x.name), ', ') AS params_text FROM sp"""))
def q_signature_params(spark: SparkSession, sf: str) -> DataFrame:
    s = _sig(spark, sf)
    return s.select("model_id", F.size("params").cast("long").alias("n_params"),
                    F.array_join(F.transform("params", lambda x: F.concat(x["ctype"], F.lit(" "), x["name"])), ", ")
                    .alias("params_text"))


def _tm_sql() -> str:
    from rolloutlab.dictionaries import SCALAR_TYPE_MAP, sql_values
    return f"tm AS (SELECT * FROM {sql_values(SCALAR_TYPE_MAP, ['ctype', 'host_type'])})"


@register("argument_table", ["X7", "X6"], S.with_("v_signatures", _SIG_SQL, _tm_sql(), """ar AS (
  SELECT model_id, CAST(p.pos AS BIGINT) AS pos, p.ctype AS ctype, p.name AS name
  FROM (SELECT model_id, unnest(params) AS p FROM sp))""",
    body="""SELECT ar.model_id, ar.pos, ar.ctype, ar.name,
       CASE WHEN contains(ar.ctype, '*') THEN 'torch::Tensor' ELSE coalesce(tm.host_type, ar.ctype) END AS host_type,
       contains(ar.ctype, '*') AS is_pointer,
       CASE WHEN contains(ar.ctype, '*') THEN trim(replace(replace(ar.ctype, 'const', ''), '*', '')) END AS base_dtype,
       NOT contains(ar.ctype, '*') AND coalesce(tm.host_type, ar.ctype) <> ar.ctype AS needs_cast,
       CASE WHEN contains(ar.ctype, '*') THEN ar.name || '.data_ptr<' || trim(replace(replace(ar.ctype, 'const', ''), '*', '')) || '>()'
            WHEN coalesce(tm.host_type, ar.ctype) <> ar.ctype THEN 'static_cast<' || ar.ctype || '>(' || ar.name || ')'
            ELSE ar.name END AS call_expr
FROM ar LEFT JOIN tm ON tm.ctype = ar.ctype"""))
def q_argument_table(spark: SparkSession, sf: str) -> DataFrame:
    return X.argument_table(_sig(spark, sf), "params", ["model_id"], type_map_table(spark), small=True)


@register("argument_calls", ["X7"], S.with_("v_signatures", _SIG_SQL, _tm_sql(), """ar AS (
  SELECT model_id, CAST(p.pos AS BIGINT) AS pos, p.ctype AS ctype, p.name AS name
  FROM (SELECT model_id, unnest(params) AS p FROM sp))""",
    """ce AS (SELECT ar.model_id, string_agg(CASE WHEN contains(ar.ctype, '*') THEN ar.name || '.data_ptr<' ||
         trim(replace(replace(ar.ctype, 'const', ''), '*', '')) || '>()'
         WHEN coalesce(tm.host_type, ar.ctype) <> ar.ctype THEN 'static_cast<' || ar.ctype || '>(' || ar.name || ')'
         ELSE ar.name END, ', ' ORDER BY ar.pos) AS extra
  FROM ar LEFT JOIN tm ON tm.ctype = ar.ctype GROUP BY ar.model_id)""",
    body=f"""SELECT sp.model_id, {q(X.FIXED_CALL_PREFIX)} || CASE WHEN ce.extra IS NOT NULL THEN ', ' || ce.extra ELSE '' END
       || ', stream' AS call_args FROM sp LEFT JOIN ce USING (model_id)"""))
def q_argument_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _sig(spark, sf).select("model_id", X.argument_calls("params").alias("call_args"))


@register("init_params", ["X8"], S.with_("v_signatures", _INIT_SQL, body="""SELECT model_id,
       CAST(len(names) AS BIGINT) AS n_init, array_to_string(names, ',') AS names FROM ip"""))
def q_init_params(spark: SparkSession, sf: str) -> DataFrame:
    s = _sig(spark, sf)
    return s.select("model_id", F.size("names").cast("long").alias("n_init"),
                    F.array_join("names", ",").alias("names"))


@register("arity_check", ["X9", "X6", "X8"], S.with_("v_signatures", _SIG_SQL, _INIT_SQL, body="""SELECT sp.model_id,
       len(sp.params) > 0 AND len(ip.names) > 0 AND len(sp.params) <> len(ip.names) AS rejected,
       CASE WHEN NOT (len(sp.params) > 0 AND len(ip.names) > 0 AND len(sp.params) <> len(ip.names)) THEN
            CAST(CASE WHEN len(sp.params) > 0 AND len(ip.names) > 0 THEN len(ip.names) ELSE 0 END AS BIGINT) END AS n_args,
       CASE WHEN NOT (len(sp.params) > 0 AND len(ip.names) > 0 AND len(sp.params) <> len(ip.names)) THEN
            CASE WHEN len(sp.params) > 0 AND len(ip.names) > 0
                 THEN array_to_string(list_transform(ip.names, lambda n: 'self._kp_' || n), ', ') ELSE '' END END AS args
FROM sp JOIN ip USING (model_id)"""))
def q_arity_check(spark: SparkSession, sf: str) -> DataFrame:
    s = _sig(spark, sf).select("model_id", X.arity_check("params", "names").alias("a"))
    return s.select("model_id", "a.rejected", F.size("a.args").cast("long").alias("n_args"),
                    F.array_join("a.args", ", ").alias("args")).withColumn(
        "n_args", F.when(~F.col("rejected"), F.col("n_args")))


# ---------------------------------------------------------------- line and struct slices
@register("slice_lines", ["X12"], f"""WITH ln AS (SELECT doc_id, text,
         CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE
              string_split_regex(regexp_replace(text, '(?:' || {q(LINE_BREAK_RE2)} || ')\\z', ''), {q(LINE_BREAK_RE2)}) END AS lines
  FROM documents)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, array_to_string(lines[2:4], chr(10)) AS lines_2_4,
       array_to_string(lines[len(lines):len(lines)], chr(10)) AS last_line FROM ln""")
def q_slice_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", "doc_id", "text")
    lines = TX.split_lines("text")
    return d.select("doc_id", F.size(lines).cast("long").alias("n_lines"), TX.slice_lines("text", 2, 4).alias("lines_2_4"),
                    F.array_join(F.slice(lines, F.greatest(F.size(lines), F.lit(1)), F.least(F.size(lines), F.lit(1))),
                                 "\n").alias("last_line"))


@register("named_struct_block", ["X13"], S.with_("v_struct_texts", f"""sb AS (SELECT text_id,
         regexp_extract(text, {q(TX.struct_block_pattern(fx.STRUCT_NAME))}, 0) AS whole FROM v_struct_texts)""",
    body=f"""SELECT text_id, array_to_string(CASE WHEN whole = '' THEN CAST([] AS VARCHAR[]) ELSE
       string_split_regex(regexp_replace(whole, '(?:' || {q(LINE_BREAK_RE2)} || ')\\z', ''), {q(LINE_BREAK_RE2)}) END[1:30], chr(10)) AS block
FROM sb"""))
def q_named_struct_block(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.v_struct_texts(spark, sf)
    return t.select("text_id", TX.named_struct_block("text", fx.STRUCT_NAME).alias("block"))
