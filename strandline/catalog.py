"""All queries of the core and the SQL they are checked against."""

from __future__ import annotations

from .plans import derived, evaluation, experiments, graphs, ingestion, judged, knowledge, modes, relational, retrieval, texts
from .registry import QUERIES, SQL, Query

FLAGSHIP: Query = retrieval.bm25_topk
MODULES = (texts, ingestion, retrieval, graphs, knowledge, evaluation, judged, experiments, relational, derived, modes)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
