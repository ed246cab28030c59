"""The named queries of this library over the driver's tables, and the same in SQL."""

from __future__ import annotations

from shardlore.plans import changes, checks, custom, registry, scores, statistics, transfers  # noqa: F401  importing registers


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
