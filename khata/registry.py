"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from khata.plans import fiscal_queries, listing_queries, review_queries, source_queries, text_queries

QUERIES = {**fiscal_queries.QUERIES, **text_queries.QUERIES, **listing_queries.QUERIES, **review_queries.QUERIES, **source_queries.QUERIES}
SQL = {**fiscal_queries.SQL, **text_queries.SQL, **listing_queries.SQL, **review_queries.SQL, **source_queries.SQL}
