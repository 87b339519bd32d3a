"""All core queries and their SQL."""

from __future__ import annotations

from quaystone.plans import archive, ingest, preparation, surface

FLAGSHIP = "search_top_20"
_PARTS = [archive, ingest, preparation, surface]


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
