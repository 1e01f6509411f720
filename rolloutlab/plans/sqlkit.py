"""Helpers for writing the DuckDB oracle SQL next to each Spark query."""

from __future__ import annotations

from rolloutlab.dictionaries import OP_DICTS, snippet_rows, sql_values
from rolloutlab.sources import fixtures as fx

FIXTURE_SQL = {
    "v_samples": fx.V_SAMPLES_SQL,
    "v_completions": fx.V_COMPLETIONS_SQL,
    "v_prompt_turns": fx.V_PROMPT_TURNS_SQL,
    "v_signatures": fx.V_SIGNATURES_SQL,
    "v_tensors": fx.V_TENSORS_SQL,
    "v_checks": fx.V_CHECKS_SQL,
    "v_timings": fx.V_TIMINGS_SQL,
    "v_rollouts": fx.V_ROLLOUTS_SQL,
    "v_matrix": fx.V_MATRIX_SQL,
    "v_vectors": fx.V_VECTORS_SQL,
    "v_series": fx.V_SERIES_SQL,
    "v_struct_texts": fx.V_STRUCT_TEXTS_SQL,
}

# DuckDB expression for the whitespace set of a full strip.
WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def text(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    return fx._nl(s)


def dict_cte(arch: str = "gfx1201", name: str = "dict") -> str:
    rows = [(i, op, key) for i, (op, key) in enumerate(OP_DICTS[arch])]
    return f"{name} AS (SELECT * FROM {sql_values(rows, ['ord', 'map_op', 'key'])})"


def snippets_cte(arch: str = "gfx1201", name: str = "snippets") -> str:
    rows = [(k, s.replace("\n", "\u0001")) for k, s in snippet_rows(arch)]
    return (f"{name} AS (SELECT key, replace(snippet, chr(1), chr(10)) AS snippet "
            f"FROM {sql_values(rows, ['key', 'snippet'])})")


def with_(*parts: str, body: str) -> str:
    """``WITH`` fixture CTEs (by name) and extra CTE texts, then the body."""
    ctes = [FIXTURE_SQL.get(p, p) for p in parts]
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
