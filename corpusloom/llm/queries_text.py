"""Queries of problems 1 and 2: repeated site lines and wrong character encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.garble import repaired_lines
from corpusloom.llm.lines import host_site, line_table, repeated_lines, site_lines, without_site_lines
from corpusloom.sources.tables import table


def doc_site() -> Column:
    """The site of a document: its source, or what the host of its url says."""
    return F.coalesce(F.nullif(F.trim("source"), F.lit("")), host_site(F.col("url")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines the site itself adds, in every document."""
    lines = line_table(table(spark, d, "documents").select("doc_id", "url", "source", "text"), "doc_id", doc_site())
    return repeated_lines(lines, site_lines(lines)).select(F.col("id").alias("doc_id"), "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document without its site's lines."""
    docs = table(spark, d, "documents").select("doc_id", "url", "source", "text")
    found = site_lines(line_table(docs, "doc_id", doc_site()))
    return without_site_lines(docs, "doc_id", doc_site(), found).select(F.col("id").alias("doc_id"), "n_removed", "clean")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of which a part was decoded with a wrong encoding."""
    docs = table(spark, d, "documents").select("doc_id", "url", "source", "title", "text")
    bad = repaired_lines(docs, "doc_id", doc_site()).where(F.col("state").isin("restored", "twin", "lost"))
    return bad.select(F.col("id").alias("doc_id"), "field").distinct()


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled lines with their original wording as far as it can be had."""
    docs = table(spark, d, "documents").select("doc_id", "url", "source", "title", "text")
    return repaired_lines(docs, "doc_id", doc_site()).where(F.col("state").isin("restored", "twin", "lost")).select(
        F.col("id").alias("doc_id"), "field", "line_no", "restored", "state"
    )


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_restored": p2_restored}
#: The definition of a site's line, without its test of significance, which excludes nothing further in these tables.
_SITE_LINES = """WITH d AS (SELECT doc_id, text, coalesce(nullif(trim(source), ''), nullif(regexp_replace(regexp_replace(
  regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '^(?:www|m)[.]', ''), '[.][a-z0-9-]+$', ''), ''), '') AS site FROM documents),
n AS (SELECT site, count(*) AS n_site FROM d GROUP BY site),
p AS (SELECT doc_id, site, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l AS (SELECT doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM p),
k AS (SELECT *, regexp_replace(lower(line), '[^\\p{L}\\p{M}]+', '', 'g') AS key FROM l),
f AS (SELECT site, key FROM (SELECT site, key, count(DISTINCT doc_id) AS n_in FROM k WHERE key <> '' GROUP BY site, key) JOIN n USING (site) WHERE n_in >= greatest(4, 0.1 * n_site))
"""
SQL: dict[str, str] = {
    "p1_found": _SITE_LINES + "SELECT doc_id, line_no FROM k WHERE (site, key) IN (SELECT site, key FROM f)",
    "p1_clean": _SITE_LINES
    + """, m AS (SELECT k.*, f.key IS NOT NULL AS own FROM k LEFT JOIN f ON f.site = k.site AND f.key = k.key)
SELECT d.doc_id, coalesce(g.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(g.clean, '') END AS clean FROM d LEFT JOIN
  (SELECT doc_id, count(*) FILTER (own) AS n_removed, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT own) AS clean FROM m GROUP BY doc_id) g USING (doc_id)""",
}
