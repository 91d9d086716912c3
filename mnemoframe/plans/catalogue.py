"""All registered queries and their SQL."""

from __future__ import annotations

from . import graph_queries, log_queries, question_queries, source_queries, stream_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
