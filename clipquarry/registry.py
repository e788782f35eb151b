"""All queries of the engine, and the SQL that each must agree with."""

from __future__ import annotations

from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
