"""All queries of the contract engine and, by the same names, their DuckDB SQL."""

from __future__ import annotations

from pactum.plans import classification, diffs, files, requests, searches, states, streams, tables, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (texts, classification, diffs, searches, states, tables, streams, files, requests):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.SQL
