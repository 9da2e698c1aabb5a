"""The registry of the retrieval engine's queries: importing the plans fills it."""

from __future__ import annotations

from cuelake.plans import engine_queries, more_queries, search_queries, star_queries, text_queries  # noqa: F401
from cuelake.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    return search_queries.hybrid_search(spark, sf_dir)
