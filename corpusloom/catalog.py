"""All queries of the library by name, with their DuckDB counterparts."""

from __future__ import annotations

from .plans import queries_models, queries_tables, queries_terms, queries_topics, queries_words

#: Best terms of each keyword and period.
FLAGSHIP = "pmi_topk"
QUERIES = queries_terms.QUERIES | queries_tables.QUERIES | queries_models.QUERIES | queries_topics.QUERIES | queries_words.QUERIES
SQL = queries_terms.SQL | queries_tables.SQL | queries_models.SQL | queries_topics.SQL | queries_words.SQL
