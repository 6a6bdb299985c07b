"""All registered queries. Importing the modules fills the registry."""

from newsgraph.catalog import (  # noqa: F401
    feed_queries,
    key_queries,
    load_queries,
    page_queries,
    row_queries,
    stream_queries,
    text_queries,
)
from newsgraph.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
