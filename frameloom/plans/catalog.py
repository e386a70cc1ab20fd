"""All registered queries."""

from frameloom.plans import (  # noqa: F401
    collection_queries,
    live_queries,
    loading_queries,
    pixel_queries,
    source_queries,
    stat_queries,
    stream_queries,
    text_queries,
)
from frameloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
