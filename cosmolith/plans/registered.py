"""All queries of the analytics operators, with the SQL that checks them."""

from cosmolith.plans import catalogue, files, jobs, scale, variants

QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "files", "jobs", "scale", "variants"]
