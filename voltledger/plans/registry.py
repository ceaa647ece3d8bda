"""All queries of the bill engine by name, and their SQL twins."""

from __future__ import annotations

from . import oracle, queries, reviews, whole  # noqa: F401  (whole adds its queries to those of reviews)

FLAGSHIP = "flagship_route"
QUERIES = queries.QUERIES | reviews.QUERIES
ORACLE_SQL = oracle.SQL | reviews.SQL
