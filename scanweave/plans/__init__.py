"""The registered queries and the SQL that checks them."""

from scanweave.plans import placement, queries

__all__ = ["placement", "queries"]
