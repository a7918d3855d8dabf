"""All named queries with their SQL."""

from __future__ import annotations

from tidelog.plans import maintenance_queries, read_queries, storage_queries

QUERIES: dict = {}
ORACLES: dict = {}
for part in (read_queries, maintenance_queries, storage_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.SQL
