"""Names of the registered queries, with their Spark plans and SQL counterparts."""

from __future__ import annotations

from scriptorium.plans import flows, learning, pages, pixels, registry, study, texts  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
