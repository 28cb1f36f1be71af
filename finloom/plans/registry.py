"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from finloom.plans import balances, banks, blocks, canonical, checks, classification, domain, entities, files, integrity, issuers, more, narratives, nested, reports, schemas, tables

AREAS = (balances, banks, blocks, canonical, checks, classification, domain, entities, files, integrity, issuers, more, narratives, nested, reports, schemas, tables)
QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
