"""All registered queries of the engine."""

from __future__ import annotations

from . import ahead_queries, cv_queries, entry_queries, file_queries, line_queries, nested_queries, plan_queries, shown_queries, text_queries, xml_queries  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
