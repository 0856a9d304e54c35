"""Queries of problem 5: per-key results without the imbalance of a few heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.heavy_keys import degrees, dense_counts, outsized_keys
from corpusloom.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys of `edges.dst` and `postings.doc_id` that own an outsized part of their table."""
    parts = [
        outsized_keys(table(spark, d, tab), key).select(F.lit(tab).alias("tab"), "key_value")
        for tab, key in (("edges", "dst"), ("postings", "doc_id"))
    ]
    return parts[0].unionByName(parts[1])


def p5_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows and distinct sources of every `dst`."""
    return degrees(table(spark, d, "edges"))


def p5_terms_per_doc(spark: SparkSession, d: str) -> DataFrame:
    """Stored posting rows of every document, by dense accumulators."""
    return dense_counts(table(spark, d, "postings"), "doc_id").select(
        F.col("key_value").cast("bigint").alias("doc_id"), F.col("n").alias("n_rows")
    )


_COUNTS = """
SELECT '{tab}' AS tab, key_value FROM (
  SELECT CAST({key} AS VARCHAR) AS key_value, count(*) AS n,
         (SELECT count(*) FROM {tab}) AS total, (SELECT count(DISTINCT {key}) FROM {tab}) AS n_keys
  FROM {tab} WHERE {key} IS NOT NULL GROUP BY {key})
WHERE n >= total * 0.01 AND n * n_keys >= total * 10
"""

QUERIES = {"p5_found": p5_found, "p5_degrees": p5_degrees, "p5_terms_per_doc": p5_terms_per_doc}
SQL = {
    "p5_found": _COUNTS.format(tab="edges", key="dst") + " UNION ALL " + _COUNTS.format(tab="postings", key="doc_id"),
    "p5_degrees": "SELECT dst, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT src) AS n_sources FROM edges WHERE dst IS NOT NULL GROUP BY dst",
    "p5_terms_per_doc": "SELECT doc_id, count(*) AS n_rows FROM postings GROUP BY doc_id",
}
