"""Registered queries by family; importing this package registers them all."""

from paperloom.plans import activity, analytics, catalogue, documents, fields, files, listings, retrieval  # noqa: F401
from paperloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
