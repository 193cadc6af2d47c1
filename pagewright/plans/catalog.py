"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from . import answer_queries, commit_queries, evaluation_queries, extraction_queries, inventory_queries, lineage_queries, matching_queries, page_queries, retrieval_queries, record_queries, rule_queries, store_queries, streaming_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
