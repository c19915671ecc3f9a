"""All registered queries of the reference operators."""

from __future__ import annotations

from framewise.plans import dataset_queries, loader_queries, motion_queries, qc_queries, source_queries, volume_queries

_ALL = motion_queries.QUERIES | dataset_queries.QUERIES | loader_queries.QUERIES | qc_queries.QUERIES | source_queries.QUERIES | volume_queries.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
