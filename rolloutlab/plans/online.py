"""Queries for the user-function surface (U1, U2) and the streaming jobs (ST1-ST3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlab.functions.text import scorable
from rolloutlab.operators import rewards as R
from rolloutlab.operators.udf import safe_apply
from rolloutlab.plans import sqlkit as S
from rolloutlab.plans.registry import register
from rolloutlab.plans.scoring import _TRAJ_TURNS_SQL
from rolloutlab.sources import fixtures as fx
from rolloutlab.streaming import jobs as ST

WS = " \t\n\r\f\v"


def fenced_length_score(row: dict) -> float:
    """Example user reward: stripped length / 1000 for fenced answers; raises otherwise."""
    text = row["completion"]
    if "```" not in text:
        raise ValueError("no fenced block")
    return len(text.strip(WS)) / 1000.0


@register("safe_apply", ["U1"], S.with_("v_completions", body=f"""SELECT prompt_id, generation,
       CASE WHEN contains(completion, '```') THEN length(trim(completion, {S.WS})) / 1000.0 ELSE -1.0 END AS score,
       CASE WHEN contains(completion, '```') THEN NULL ELSE 'ValueError: no fenced block' END AS error
FROM v_completions"""))
def q_safe_apply(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.v_completions(spark, sf)
    return safe_apply(c, fenced_length_score).select("prompt_id", "generation", "score", "error")


def length_bonus(c: Column) -> Column:
    """Reward term in [0, 1) that grows with the length: n / (n + 2000)."""
    n = F.length(c).cast("double")
    return n / (n + F.lit(2000.0))


@register("with_reward", ["U2", "F1"], S.with_("v_completions", body=f"""SELECT prompt_id, generation,
       CASE WHEN coalesce(length(trim(completion, {S.WS})) >= 20, false) THEN 1.0 ELSE 0.0 END * 1.0
       + length(completion) / (length(completion) + 2000.0::DOUBLE) * 0.5 AS reward
FROM v_completions"""))
def q_with_reward(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.v_completions(spark, sf)
    out = R.with_reward(c, [scorable("completion").cast("double"), length_bonus(F.col("completion"))], [1.0, 0.5])
    return out.select("prompt_id", "generation", "reward")


@register("stream_scores", ["ST1"], S.with_("v_rollouts", body="""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')
       AS window_start, stage, CAST(count(*) AS BIGINT) AS n, avg(reward) AS mean_reward FROM v_rollouts GROUP BY ALL"""))
def q_stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ST.stream_scores(ST.rollouts_from_events(ST.event_stream(spark, sf)))


@register("stream_timeout_join", ["ST2"], """WITH c AS (SELECT event_id AS sub_id, user_id, ts FROM events
  WHERE event_type = 'click'),
v AS (SELECT event_id AS res_id, user_id, ts, value FROM events WHERE event_type = 'view'),
m AS (SELECT c.sub_id, v.res_id, v.value,
         row_number() OVER (PARTITION BY c.sub_id ORDER BY v.ts, v.res_id) AS rn
  FROM c LEFT JOIN v ON v.user_id = c.user_id AND v.ts >= c.ts AND v.ts <= c.ts + INTERVAL 6 HOUR)
SELECT sub_id, res_id,
       CASE WHEN res_id IS NULL THEN -1.0::DOUBLE
            ELSE least(0.8::DOUBLE, greatest(0.05::DOUBLE, 0.8::DOUBLE / (1.0::DOUBLE + sqrt(value)))) END AS reward
FROM m WHERE rn = 1""")
def q_stream_timeout_join(spark: SparkSession, sf: str) -> DataFrame:
    """Drained input, finalised: every submission scored exactly once."""
    ev = ST.event_stream(spark, sf)
    return ST.stream_timeout_join(ST.submissions(ev), ST.results(ev)).select("sub_id", "res_id", "reward")


@register("stream_trajectory", ["ST3", "W3"], S.with_("v_rollouts", _TRAJ_TURNS_SQL, """it AS (SELECT *,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration FROM tt)""",
    """st AS (SELECT *, length(text) > 0 AND (reward >= 3.0 OR iteration >= 20) AS stop_here FROM it)""",
    """fs AS (SELECT conv_id, min(turn) FILTER (WHERE stop_here) AS stop_turn FROM st GROUP BY conv_id)""",
    body="""SELECT st.conv_id, st.turn, st.reward, st.text, CAST(st.iteration AS BIGINT) AS iteration,
       coalesce(st.turn = fs.stop_turn, false) AS should_stop
FROM st JOIN fs USING (conv_id) WHERE fs.stop_turn IS NULL OR st.turn <= fs.stop_turn"""))
def q_stream_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return ST.stream_trajectory(ST.turns(ST.event_stream(spark, sf)))
