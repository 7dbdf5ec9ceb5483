"""All named queries."""

from epochlens.catalog import content, device, formats, relational  # noqa: F401
from epochlens.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
