"""The queries of the core and their SQL."""

from __future__ import annotations

from dowser.plans import index, references, sources, upkeep

FLAGSHIP = "semantic_search"
MODULES = (index, references, upkeep, sources)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
