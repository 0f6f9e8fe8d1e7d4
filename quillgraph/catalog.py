"""Registered graph queries and the SQL each is compared with."""

from __future__ import annotations

from quillgraph.catalogs import analytics, changes, identity, landed, logs, records, values

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (analytics, records, identity, values, changes, logs, landed):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
FLAGSHIP = "ag10_interlock_org_pairs"
