"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from folioframe.plans import (  # noqa: F401
    evaluation_queries,
    layout_queries,
    qa_queries,
    relational_queries,
    retrieval_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from folioframe.plans.registry import ORACLES, QUERIES

FLAGSHIP = "hybrid_retrieve"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
