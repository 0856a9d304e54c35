"""Queries of problems 6 and 7: stuffed records and main bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.body import Corpus, corpus, furniture, main_body, stuffed_records
from corpusloom.llm.lines import host_site
from corpusloom.llm.queries_text import doc_site
from corpusloom.sources.tables import table


def documents(spark: SparkSession, d: str) -> Corpus:
    return corpus(table(spark, d, "documents"), "doc_id", doc_site())


def crawl_pages(spark: SparkSession, d: str) -> Corpus:
    return corpus(table(spark, d, "crawl_pages"), "page_id", host_site(F.col("base_url")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records stuffed with keywords, links, tags or products."""
    parts = [stuffed_records(c).select(F.lit(t).alias("tab"), F.col("id").alias("rec_id")) for t, c in (("documents", documents(spark, d)), ("crawl_pages", crawl_pages(spark, d)))]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines outside the main body."""
    parts = [furniture(c).select(F.lit(t).alias("tab"), F.col("id").alias("rec_id"), "line_no") for t, c in (("documents", documents(spark, d)), ("crawl_pages", crawl_pages(spark, d)))]
    return parts[0].unionByName(parts[1])


def p7_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Every record's text reduced to its main body."""
    parts = [main_body(c).select(F.lit(t).alias("tab"), F.col("id").alias("rec_id"), "body") for t, c in (("documents", documents(spark, d)), ("crawl_pages", crawl_pages(spark, d)))]
    return parts[0].unionByName(parts[1])


QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_bodies": p7_bodies}
SQL: dict[str, str] = {}
