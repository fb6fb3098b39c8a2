"""Registered queries of the curation operators and their DuckDB SQL."""

from __future__ import annotations

from gleaner.plans import events, kinds, lookups, picks, records, sources, stages, steps, texts

MODULES = (texts, records, events, kinds, lookups, picks, sources, stages, steps)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
