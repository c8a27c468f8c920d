"""Registered queries."""

from fieldlink.queries import base


def _load() -> None:
    from fieldlink.queries import inputs_sql, pairs_queries, raster_queries, edge_queries, group_queries, sanity_queries, legacy_queries, catalog_queries, parent_queries, graph_queries  # noqa: F401


def all_queries() -> dict:
    _load()
    return dict(base.QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(base.ORACLES)
