"""Queries over the tables, by problem; SQL where SQL can express the result over whole tables."""

from __future__ import annotations

from corpusloom.llm import queries_body, queries_language, queries_terms, queries_text, queries_tokens

QUERIES = {**queries_text.QUERIES, **queries_terms.QUERIES, **queries_tokens.QUERIES, **queries_body.QUERIES, **queries_language.QUERIES}
SQL = {**queries_text.SQL, **queries_terms.SQL, **queries_tokens.SQL, **queries_body.SQL, **queries_language.SQL}
