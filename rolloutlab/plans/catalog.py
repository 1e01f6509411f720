"""All registered queries (importing the plan modules fills the registry)."""

from __future__ import annotations

from rolloutlab.plans import extract, numeric, online, prepare, scoring  # noqa: F401
from rolloutlab.plans.registry import OPERATOR_IDS, ORACLES, QUERIES, RAW_QUERIES

__all__ = ["QUERIES", "RAW_QUERIES", "ORACLES", "OPERATOR_IDS"]
