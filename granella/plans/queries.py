"""All queries of the document and drawing operators over the driver's tables, each with the same result as SQL."""

from __future__ import annotations

from granella.plans import queries_drawing, queries_record, queries_section, queries_text  # noqa: F401  they register themselves
from granella.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
