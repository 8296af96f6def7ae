"""All core queries by name, with their SQL counterparts."""

from __future__ import annotations

from siltweave.plans import gate_queries, kernel_queries, link_queries, page_queries, report_queries, selection_queries, stream_queries, text_queries, url_queries  # noqa: F401
from siltweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
