"""The registered queries and their SQL."""

from .catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
