"""E1 -- prepare training prompts, and the queries of its operators
(S1-S4, P1-P5, J1-J4, D1-D3, G1, A5, F3)."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.dictionaries import ARCH_JOIN, op_dictionary, phase_of, snippet_rows, snippet_table, sql_values
from rolloutlab.functions.text import is_float_dtype, normalise_ops
from rolloutlab.operators import matching as M
from rolloutlab.operators import prompts as P
from rolloutlab.operators import sampling as D
from rolloutlab.plans import sqlkit as S
from rolloutlab.plans.registry import register
from rolloutlab.session import checkpoint_dir
from rolloutlab.sources import fixtures as fx
from rolloutlab.sources import samples as src
from rolloutlab.sources.tables import table_path

SYSTEM_PROMPT_PATH = str(Path(__file__).resolve().parent.parent / "resources" / "system_prompt.md")
ARCH = "gfx1201"
VAL_RATIO = 0.1
SEED = 42
K = 3


def system_text() -> str:
    return Path(SYSTEM_PROMPT_PATH).read_text()


# ---------------------------------------------------------------- E1 job
def prepare(samples: DataFrame, tensors: DataFrame | None = None, system: str = "", arch: str = ARCH,
            k: int = K, val_ratio: float = VAL_RATIO, seed: int = SEED) -> DataFrame:
    """Raw samples ``(sample_id, ops_raw, code, data_source)`` -> chat rows with
    ``split``. The only shuffles are the weight-spec aggregation and its join
    (when tensors are given); snippet lookup is row-local and the exact split
    is a comparison against a boundary key found by small bounded jobs."""
    df = samples.withColumn("ops", normalise_ops("ops_raw"))
    df = M.reference_text(df, arch=arch, k=k)
    if tensors is not None:
        spec = P.render_weight_spec(tensors).withColumnRenamed("model_id", "sample_id")
        df = df.join(spec.select("sample_id", "weight_info"), "sample_id", "left")
    else:
        df = df.withColumn("weight_info", F.lit(""))
    user = P.render_user_message("code", "ref_text", "weight_info", arch=arch)
    df = df.withColumn("user_message", user)
    df = df.withColumn("prompt", F.to_json(P.assemble_chat(F.lit(system), F.col("user_message"))))
    df = df.withColumn("interaction_kwargs", P.pack_metadata("code", "ops", "data_source"))
    return D.exact_split(df, val_ratio, "sample_id", seed)


# ---------------------------------------------------------------- shared SQL pieces
def _samples_sql() -> str:
    return """s AS (
  SELECT sample_id, code, data_source, ops_raw,
         CASE WHEN starts_with(ops_raw, '[') THEN CAST(from_json(ops_raw, '["VARCHAR"]') AS VARCHAR[])
              WHEN ops_raw <> '' THEN [ops_raw] ELSE CAST([] AS VARCHAR[]) END AS ops
  FROM v_samples)"""


def _match_sql(arch: str = ARCH, k: int = K) -> list[str]:
    """CTEs occ/ex/fz/m/ref computing J1-J4 relationally (independent of the
    row-local Spark form)."""
    sep = ARCH_JOIN[arch][0]
    return [
        S.dict_cte(arch), S.snippets_cte(arch),
        """occ AS (SELECT sample_id, pos, ops[pos + 1] AS op
  FROM (SELECT sample_id, ops, unnest(range(len(ops))) AS pos FROM s))""",
        "ex AS (SELECT o.sample_id, o.pos, o.op, d.key FROM occ o LEFT JOIN dict d ON d.map_op = o.op)",
        """fz AS (SELECT n.op, arg_min(d.key, d.ord) AS fkey
  FROM (SELECT DISTINCT op FROM ex WHERE key IS NULL) n
  JOIN dict d ON contains(lower(n.op), lower(d.map_op)) OR contains(lower(d.map_op), lower(n.op))
  GROUP BY n.op)""",
        "m AS (SELECT ex.sample_id, ex.pos, ex.op, coalesce(ex.key, fz.fkey) AS key FROM ex LEFT JOIN fz ON ex.op = fz.op)",
        "av AS (SELECT m.sample_id, m.key, min(m.pos) AS pos FROM m JOIN snippets USING (key) GROUP BY ALL)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS rn FROM av)",
        f"""ref AS (SELECT rk.sample_id, string_agg(rk.key, ',' ORDER BY rk.pos) AS ref_keys,
         count(*) AS n_ref, string_agg(sn.snippet, {S.text(sep)} ORDER BY rk.pos) AS ref_text
  FROM rk JOIN snippets sn USING (key) WHERE rk.rn <= {k} GROUP BY rk.sample_id)""",
    ]


def _split_sql(ratio: float = VAL_RATIO, seed: int = SEED, src_: str = "s") -> str:
    return f"""sp AS (SELECT sample_id,
         row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', CAST(sample_id AS VARCHAR))), sample_id) AS rnk,
         count(*) OVER () AS n_total
  FROM {src_})"""


def _split_case(ratio: float = VAL_RATIO) -> str:
    return f"CASE WHEN sp.rnk <= floor(sp.n_total * {ratio}::DOUBLE) THEN 'val' ELSE 'train' END"


def _user_message_sql(weight: str = "''", arch: str = ARCH) -> str:
    head = P.INSTRUCTION.format(arch=arch) + "```python\n"
    return (f"{S.text(head)} || trim(s.code, {S.WS}) || chr(10) || '```' || "
            f"CASE WHEN coalesce(ref.ref_text, '') <> '' THEN {S.text(chr(10) + chr(10) + P.REF_HEADER + chr(10) + '```cpp' + chr(10))}"
            f" || ref.ref_text || chr(10) || '```' ELSE '' END || {weight}")


def _weight_sql(max_tensors: int = P.MAX_WEIGHT_TENSORS) -> str:
    return f"""fl AS (SELECT * FROM v_tensors WHERE dtype IN ('float16', 'bfloat16', 'float32', 'float64')),
wcnt AS (SELECT model_id, count(*) FILTER (WHERE dtype IN ('float16', 'bfloat16', 'float32', 'float64')) AS n_float
  FROM v_tensors GROUP BY model_id),
wtxt AS (SELECT fl.model_id,
         {S.text(P.WEIGHT_HEADER)} || string_agg('  - const float* ' || replace(name, '.', '_') || '  shape=('
            || array_to_string(list_transform(shape, lambda x: CAST(x AS VARCHAR)), ',') || ')', chr(10) ORDER BY ord)
            || chr(10) AS weight_info
  FROM fl JOIN wcnt USING (model_id) WHERE wcnt.n_float <= {max_tensors} GROUP BY fl.model_id),
w AS (SELECT wcnt.model_id, wcnt.n_float, coalesce(wtxt.weight_info, '') AS weight_info
  FROM wcnt LEFT JOIN wtxt USING (model_id))"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return fx.v_samples(spark, sf).withColumn("ops", normalise_ops("ops_raw"))


# ---------------------------------------------------------------- flagship
@register("prepare_prompts", ["S1", "P1", "J1", "J2", "J3", "J4", "P2", "D1", "D2"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(), _split_sql(),
    body=f"""SELECT s.sample_id, {_split_case()} AS split, coalesce(ref.ref_keys, '') AS ref_keys,
       CAST(coalesce(ref.n_ref, 0) AS BIGINT) AS n_ref, {_user_message_sql()} AS user_message
FROM s JOIN sp USING (sample_id) LEFT JOIN ref USING (sample_id)"""))
def q_prepare_prompts(spark: SparkSession, sf: str) -> DataFrame:
    df = M.reference_text(_samples(spark, sf), arch=ARCH, k=K)
    df = df.withColumn("user_message", P.render_user_message("code", "ref_text", arch=ARCH))
    return D.exact_split(df, VAL_RATIO, "sample_id", SEED).select(
        "sample_id", "split", "ref_keys", "n_ref", "user_message")


# ---------------------------------------------------------------- sources
@register("read_samples", ["S1"], """SELECT doc_id AS sample_id, source AS data_source,
       CAST(length(text) AS BIGINT) AS code_chars FROM documents""")
def q_read_samples(spark: SparkSession, sf: str) -> DataFrame:
    df = src.read_samples(spark, table_path(sf, "documents"),
                          rename={"doc_id": "sample_id", "source": "data_source", "text": "code"})
    return df.select("sample_id", "data_source", F.length("code").cast("long").alias("code_chars"))


CHAT_CTE = f"""chat AS (SELECT s.sample_id, CAST(to_json([{{'role': 'system', 'content': {S.text(system_text())}}},
        {{'role': 'user', 'content': {_user_message_sql()}}}]) AS VARCHAR) AS prompt
  FROM s LEFT JOIN ref USING (sample_id))"""
_CHAT_SQL = S.with_(
    "v_samples", _samples_sql(), *_match_sql(), CHAT_CTE,
    body="""SELECT sample_id, CAST(length(prompt) AS BIGINT) AS prompt_chars,
       CAST(len(from_json(prompt, '[{"role":"VARCHAR","content":"VARCHAR"}]')) AS BIGINT) AS n_messages,
       from_json(prompt, '[{"role":"VARCHAR","content":"VARCHAR"}]')[2].role AS second_role,
       CAST(length(from_json(prompt, '[{"role":"VARCHAR","content":"VARCHAR"}]')[1].content) AS BIGINT) AS system_chars
FROM chat""")


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    df = M.reference_text(_samples(spark, sf), arch=ARCH, k=K)
    df = P.attach_text(df, spark, SYSTEM_PROMPT_PATH)
    user = P.render_user_message("code", "ref_text", arch=ARCH)
    return df.select("sample_id", F.to_json(P.assemble_chat(F.col("system_text"), user)).alias("prompt"))


@register("read_chat", ["S2", "S4", "P3"], _CHAT_SQL)
def q_read_chat(spark: SparkSession, sf: str) -> DataFrame:
    parsed = src.parse_chat(_chat(spark, sf))
    return parsed.select("sample_id", F.length("prompt").cast("long").alias("prompt_chars"),
                         F.size("messages").cast("long").alias("n_messages"),
                         F.get("messages", 1)["role"].alias("second_role"),
                         F.length(F.get("messages", 0)["content"]).cast("long").alias("system_chars"))


@register("assemble_chat", ["P3", "S4"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(),
    body=f"""SELECT s.sample_id, CAST(to_json([{{'role': 'system', 'content': {S.text(system_text())}}},
        {{'role': 'user', 'content': {_user_message_sql()}}}]) AS VARCHAR) AS prompt
FROM s LEFT JOIN ref USING (sample_id)"""))
def q_assemble_chat(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf)


@register("write_split", ["S3", "D2"], S.with_(
    "v_samples", _samples_sql(), _split_sql(),
    body=f"""SELECT {_split_case()} AS split, count(*) AS n_rows, CAST(sum(s.sample_id) AS BIGINT) AS id_sum
FROM s JOIN sp USING (sample_id) GROUP BY 1"""))
def q_write_split(spark: SparkSession, sf: str) -> DataFrame:
    out = f"{checkpoint_dir(spark)}/write_split-{uuid.uuid4().hex}"
    split = D.exact_split(_samples(spark, sf), VAL_RATIO, "sample_id", SEED)
    src.write_split(split.select("sample_id", "split"), out)
    back = spark.read.parquet(out)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sample_id").alias("id_sum"))


# ---------------------------------------------------------------- projections
@register("normalise_ops", ["P1"], S.with_(
    "v_samples", _samples_sql(),
    body="""SELECT sample_id, CAST(len(ops) AS BIGINT) AS n_ops, array_to_string(ops, '|') AS ops_text,
       CAST(to_json(ops) AS VARCHAR) AS ops_json FROM s"""))
def q_normalise_ops(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("sample_id", F.size("ops").cast("long").alias("n_ops"),
                                      F.array_join("ops", "|").alias("ops_text"),
                                      F.to_json("ops").alias("ops_json"))


@register("render_user_message", ["P2", "P5", "J4"], S.with_(
    "v_samples", "v_tensors", _samples_sql(), *_match_sql(), _weight_sql(),
    body=f"""SELECT s.sample_id, {_user_message_sql("coalesce(w.weight_info, '')")} AS user_message
FROM s LEFT JOIN ref USING (sample_id) LEFT JOIN w ON w.model_id = s.sample_id"""))
def q_render_user_message(spark: SparkSession, sf: str) -> DataFrame:
    df = M.reference_text(_samples(spark, sf), arch=ARCH, k=K)
    spec = P.render_weight_spec(fx.v_tensors(spark, sf)).select(
        F.col("model_id").alias("sample_id"), "weight_info")
    df = df.join(spec, "sample_id", "left")
    return df.select("sample_id", P.render_user_message("code", "ref_text", "weight_info", arch=ARCH)
                     .alias("user_message"))


@register("pack_metadata", ["P4"], S.with_(
    "v_samples", _samples_sql(),
    body="""SELECT sample_id, CAST(to_json({'name': 'hip_kernel', 'model_code': code,
       'ops': CAST(to_json(ops) AS VARCHAR), 'data_source': data_source}) AS VARCHAR) AS interaction_kwargs
FROM s"""))
def q_pack_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("sample_id", P.pack_metadata("code", "ops", "data_source")
                                      .alias("interaction_kwargs"))


@register("render_weight_spec", ["P5", "F3"], S.with_(
    "v_tensors", _weight_sql(), body="SELECT model_id, n_float, weight_info FROM w"))
def q_render_weight_spec(spark: SparkSession, sf: str) -> DataFrame:
    return P.render_weight_spec(fx.v_tensors(spark, sf))


@register("is_float_dtype", ["F3"], S.with_(
    "v_tensors", body="""SELECT dtype, coalesce(dtype IN ('float16', 'bfloat16', 'float32', 'float64'), false) AS is_float,
       count(*) AS n FROM v_tensors GROUP BY ALL"""))
def q_is_float_dtype(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.v_tensors(spark, sf)
    return t.groupBy("dtype", is_float_dtype("dtype").alias("is_float")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- joins
@register("match_exact", ["J1"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(), body="SELECT sample_id, pos, op, key FROM ex"))
def q_match_exact(spark: SparkSession, sf: str) -> DataFrame:
    occ = M.explode_ops(_samples(spark, sf))
    return M.match_exact(occ, op_dictionary(spark, ARCH), small=True).select(
        "sample_id", F.col("pos").cast("long").alias("pos"), "op", "key")


@register("match_fuzzy", ["J2"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(), body="SELECT sample_id, pos, op, key FROM m"))
def q_match_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    d = op_dictionary(spark, ARCH)
    occ = M.explode_ops(_samples(spark, sf))
    return M.match_fuzzy(M.match_exact(occ, d, small=True), d, small=True).select(
        "sample_id", F.col("pos").cast("long").alias("pos"), "op", "key")


@register("attach_snippets", ["J3"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(),
    body="SELECT m.sample_id, m.pos, m.key, sn.snippet FROM m JOIN snippets sn USING (key)"))
def q_attach_snippets(spark: SparkSession, sf: str) -> DataFrame:
    d = op_dictionary(spark, ARCH)
    occ = M.explode_ops(_samples(spark, sf))
    m = M.match_fuzzy(M.match_exact(occ, d, small=True), d, small=True)
    return M.attach_snippets(m, snippet_table(spark, ARCH), small=True).select(
        "sample_id", F.col("pos").cast("long").alias("pos"), "key", "snippet")


def _ref_sql(arch: str) -> str:
    return S.with_("v_samples", _samples_sql(), *_match_sql(arch),
                   body="""SELECT s.sample_id, coalesce(ref.ref_keys, '') AS ref_keys,
       CAST(coalesce(ref.n_ref, 0) AS BIGINT) AS n_ref, coalesce(ref.ref_text, '') AS ref_text
FROM s LEFT JOIN ref USING (sample_id)""")


@register("reference_text", ["J4"], _ref_sql("gfx1201"))
def q_reference_text(spark: SparkSession, sf: str) -> DataFrame:
    return M.reference_text(_samples(spark, sf), arch="gfx1201").select(
        "sample_id", "ref_keys", "n_ref", "ref_text")


@register("reference_text_gfx1100", ["J4"], _ref_sql("gfx1100"))
def q_reference_text_gfx1100(spark: SparkSession, sf: str) -> DataFrame:
    return M.reference_text(_samples(spark, sf), arch="gfx1100").select(
        "sample_id", "ref_keys", "n_ref", "ref_text")


@register("reference_text_join", ["J1", "J2", "J3", "J4"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(), body="SELECT sample_id, ref_keys, n_ref, ref_text FROM ref"))
def q_reference_text_join(spark: SparkSession, sf: str) -> DataFrame:
    return M.reference_text_join(_samples(spark, sf), op_dictionary(spark, ARCH), snippet_table(spark, ARCH), small=True)


# ---------------------------------------------------------------- sampling
@register("seeded_shuffle", ["D1"], S.with_(
    "v_samples", _samples_sql(), _split_sql(),
    body=f"""SELECT sample_id, md5(concat_ws('|', '{SEED}', CAST(sample_id AS VARCHAR))) AS shuffle_key,
       CAST(rnk AS BIGINT) AS rank FROM sp"""))
def q_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return D.shuffled_rank(_samples(spark, sf).select("sample_id"), "sample_id", SEED).select(
        "sample_id", "shuffle_key", "rank")


@register("exact_split", ["D2"], S.with_(
    "v_samples", _samples_sql(), _split_sql(),
    body=f"SELECT sample_id, {_split_case()} AS split, CAST(rnk AS BIGINT) AS rank FROM sp"))
def q_exact_split(spark: SparkSession, sf: str) -> DataFrame:
    return D.ranked_split(_samples(spark, sf).select("sample_id"), VAL_RATIO, "sample_id", SEED).select(
        "sample_id", "split", "rank")


def _phase_sql() -> str:
    rows = [(k, phase_of(k)) for k, _ in snippet_rows(ARCH)]
    return f"ph AS (SELECT * FROM {sql_values(rows, ['key', 'phase'])})"


@register("curriculum", ["D3", "J1", "J2"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(), _phase_sql(),
    """sph AS (SELECT s.sample_id, CAST(coalesce(max(ph.phase), 1) AS INTEGER) AS phase
  FROM s LEFT JOIN m USING (sample_id) LEFT JOIN ph ON ph.key = m.key GROUP BY s.sample_id)""",
    body=f"""SELECT sample_id, phase, CAST(row_number() OVER (ORDER BY phase,
       md5(concat_ws('|', '{SEED}', CAST(sample_id AS VARCHAR))), sample_id) AS BIGINT) AS rank FROM sph"""))
def q_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    return D.curriculum(_samples(spark, sf), seed=SEED, arch=ARCH).select("sample_id", "phase", "rank")


BATCH, ACCUM, GENS, EPOCHS = 1, 8, 4, 2


@register("assign_batches", ["G1", "D2"], S.with_(
    "v_samples", _samples_sql(), _split_sql(),
    body=f"""SELECT sp.sample_id, e.epoch, g.generation,
       CAST(e.epoch * floor(sp.n_total / {BATCH * ACCUM}) + floor((sp.rnk - 1) / {BATCH * ACCUM}) AS BIGINT) AS step,
       CAST((sp.rnk - 1) % {BATCH * ACCUM} AS BIGINT) AS slot,
       (sp.rnk - 1) >= floor(sp.n_total / {BATCH * ACCUM}) * {BATCH * ACCUM} AS partial
FROM sp, (SELECT unnest(range({EPOCHS})) AS epoch) e, (SELECT unnest(range({GENS})) AS generation) g"""))
def q_assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    return D.assign_batches(_samples(spark, sf), BATCH, ACCUM, GENS, EPOCHS, seed=SEED).select(
        "sample_id", "epoch", "generation", "step", "slot", "partial")


@register("dataset_plan", ["A5"], S.with_(
    "v_samples", body=f"""SELECT CAST(count(*) AS BIGINT) AS n,
       CAST(floor(count(*) * {VAL_RATIO}::DOUBLE) AS BIGINT) AS n_val,
       CAST(count(*) - floor(count(*) * {VAL_RATIO}::DOUBLE) AS BIGINT) AS n_train,
       CAST({BATCH * ACCUM} AS BIGINT) AS effective_batch,
       CAST(floor((count(*) - floor(count(*) * {VAL_RATIO}::DOUBLE)) / {BATCH * ACCUM}) AS BIGINT) AS steps_per_epoch,
       CAST(floor((count(*) - floor(count(*) * {VAL_RATIO}::DOUBLE)) / {BATCH * ACCUM}) * {EPOCHS} AS BIGINT) AS total_steps
FROM v_samples"""))
def q_dataset_plan(spark: SparkSession, sf: str) -> DataFrame:
    return D.dataset_plan(fx.v_samples(spark, sf), VAL_RATIO, BATCH, ACCUM, EPOCHS)


@register("read_chat_file", ["S2", "S3", "P3", "D2"], S.with_(
    "v_samples", _samples_sql(), *_match_sql(), CHAT_CTE, _split_sql(),
    body=f"""SELECT {_split_case()} AS split, count(*) AS n_rows,
       CAST(sum(len(from_json(chat.prompt, '[{{"role":"VARCHAR","content":"VARCHAR"}}]'))) AS BIGINT) AS n_messages,
       CAST(sum(length(from_json(chat.prompt, '[{{"role":"VARCHAR","content":"VARCHAR"}}]')[2].content)) AS BIGINT)
         AS user_chars
FROM chat JOIN sp USING (sample_id) GROUP BY 1"""))
def q_read_chat_file(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows written per split (S3) and read back through S2 from the files."""
    out = f"{checkpoint_dir(spark)}/read_chat-{uuid.uuid4().hex}"
    chat = D.exact_split(_chat(spark, sf), VAL_RATIO, "sample_id", SEED)
    src.write_split(chat.select("prompt", "split"), out)
    back = src.read_chat(spark, out, keep=("split",))
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("messages")).cast("long").alias("n_messages"),
        F.sum(F.length(F.get("messages", 1)["content"])).cast("long").alias("user_chars"))


@register("prepare_dataset", ["S1", "P1", "J4", "P5", "P2", "P3", "P4", "D2", "E1"], S.with_(
    "v_samples", "v_tensors", _samples_sql(), *_match_sql(), _weight_sql(), _split_sql(),
    body=f"""SELECT s.sample_id, {_split_case()} AS split,
       CAST(to_json([{{'role': 'system', 'content': {S.text(system_text())}}},
           {{'role': 'user', 'content': {_user_message_sql("coalesce(w.weight_info, '')")}}}]) AS VARCHAR) AS prompt,
       CAST(to_json({{'name': 'hip_kernel', 'model_code': s.code, 'ops': CAST(to_json(s.ops) AS VARCHAR),
           'data_source': s.data_source}}) AS VARCHAR) AS interaction_kwargs
FROM s JOIN sp USING (sample_id) LEFT JOIN ref USING (sample_id) LEFT JOIN w ON w.model_id = s.sample_id"""))
def q_prepare_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """The whole E1 job: chat prompt (system + user with snippets and weight
    specs), metadata JSON and the exact split, one row per sample."""
    out = prepare(fx.v_samples(spark, sf).select("sample_id", "ops_raw", "code", "data_source"),
                  fx.v_tensors(spark, sf), system=system_text())
    return out.select("sample_id", "split", "prompt", "interaction_kwargs")
