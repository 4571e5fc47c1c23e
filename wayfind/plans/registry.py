"""All queries of the library, and their SQL."""

from __future__ import annotations

from wayfind.plans import answer_queries, batch_queries, history_queries, movie_queries, queries, seed_queries  # noqa: F401  each registers its own

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
