"""Analytics over change-data streams, as plain Spark DataFrame jobs."""

from changelake.specs import Column, TableSpec, TITLE_TABLES

__all__ = ["Column", "TableSpec", "TITLE_TABLES"]
