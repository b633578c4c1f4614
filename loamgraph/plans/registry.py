"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from loamgraph import streaming
from loamgraph.operators import archive, cascade, entities, evidence, extraction, graph, names, planning, resolution, retrieval, search, status, vector_index
from loamgraph.streaming import store

_PARTS = (search, graph, archive, status, planning, names, evidence, entities, resolution, cascade, extraction, retrieval, vector_index, streaming, store)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: f for part in _PARTS for k, f in part.ORACLE_SQL.items()}
