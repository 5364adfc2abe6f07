"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from stocklens.plans import audit_queries, feed_queries, mapping_queries, product_queries, site_queries

MODULES = [audit_queries, product_queries, mapping_queries, site_queries, feed_queries]


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
