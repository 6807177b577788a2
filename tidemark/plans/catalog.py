"""All queries of the library by name, with the SQL that each is held against where there is one."""

from __future__ import annotations

from tidemark.plans import evidence, execution, queries

QUERIES = queries.QUERIES
SQL = queries.SQL

__all__ = ["QUERIES", "SQL", "evidence", "execution"]
