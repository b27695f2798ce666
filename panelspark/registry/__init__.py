"""Named queries over the given tables, and the SQL each is checked against."""

from panelspark.registry.core import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
