"""All queries of this part of the library."""

from __future__ import annotations

from . import live, parsing, quality, reshaping, scores, service, streams, tagging
from .registry import ORACLE_SQL, QUERIES, Query

MODULES = (scores, parsing, reshaping, quality, tagging, live, service, streams)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
