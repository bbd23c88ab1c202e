"""Registered queries over the given tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from matchlake.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "team_stats"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
