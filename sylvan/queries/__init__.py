"""The named queries of the core."""

from sylvan.queries import exports, hierarchies, runs, sentences, stores, trees, vectors, verifying  # noqa: F401
from sylvan.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
