"""All queries of the engine: importing the modules registers them."""

from corpusloom.plans import io_queries, text_queries, token_queries  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
