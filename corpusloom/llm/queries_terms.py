"""Queries of problems 3 and 4: weights and counts of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.terms import current_postings, current_rows, last_seen_counts, log_entropy, marked_terms
from corpusloom.operators.scale import hot_keys, salted_join
from corpusloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms used at least 5 times in a document and known to 2 to 6 documents."""
    w = log_entropy(current_postings(table(spark, d, "postings")))
    return w.where((F.col("freq") >= 5) & F.col("n_docs").between(2, 6)).select("doc_id", "term")


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    """Log-entropy weight of every (term, doc_id)."""
    w = log_entropy(current_postings(table(spark, d, "postings")))
    return w.select("term", "doc_id", "freq", "n_docs", F.round("weight", 6).alias("weight"))


def p3_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct hit with the sum of its terms' weights in the document beside its old score."""
    w = log_entropy(current_postings(table(spark, d, "postings"))).select("term", "doc_id", "weight")
    hits = table(spark, d, "hits").groupBy("hit_id").agg(F.first("q", True).alias("q"), F.first("doc_id", True).alias("doc_id"), F.max("score").alias("score"))
    terms = hits.select("hit_id", "doc_id", F.explode(F.array_distinct(F.split(F.trim("q"), r"\s+"))).alias("term"))
    # hits may ask for one term again and again: its rows are few in each document, but spread them all the same
    asked = terms.withColumn("__k", F.concat_ws("\x01", "term", F.col("doc_id").cast("string")))
    known = w.select(F.concat_ws("\x01", "term", F.col("doc_id").cast("string")).alias("__k"), "weight")
    scored = salted_join(asked, known, "__k", "hit_id", hot_keys(asked, "__k")).groupBy("hit_id").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    return hits.join(scored, "hit_id", "left").select("hit_id", "doc_id", "score", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("weight"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return marked_terms(current_rows(table(spark, d, "postings"))).where(F.col("mark").isNotNull()).select("term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every term, with its mark."""
    return marked_terms(current_rows(table(spark, d, "postings"))).select("term", "freq", "n_docs", "mark")


def p4_reports(spark: SparkSession, d: str) -> DataFrame:
    """What the shards reported for a term (outer blanks and case removed, latest known by its largest count per shard) against the truth."""
    said = (
        table(spark, d, "keywords")
        .where(F.col("term").isNotNull())
        .groupBy(F.lower(F.trim("term")).alias("term"), "shard")
        .agg(F.max("freq").alias("freq"))
        .groupBy("term")
        .agg(F.sum("freq").alias("reported"), F.count(F.lit(1)).alias("n_shards"))
    )
    true = last_seen_counts(current_rows(table(spark, d, "postings")))
    return said.join(true, "term", "left").select("term", "reported", "n_shards", F.col("freq").alias("true_freq"), "n_docs")


_CURRENT = """WITH v AS (SELECT term, doc_id, coalesce(freq, 0) AS freq, coalesce(indexed_at, TIMESTAMP '0001-01-01') AS ts
  FROM postings WHERE term IS NOT NULL AND doc_id IS NOT NULL),
cur AS (SELECT v.term, v.doc_id, max(v.freq) AS freq FROM v JOIN (SELECT doc_id, max(ts) AS ts FROM v GROUP BY doc_id) l
  ON l.doc_id = v.doc_id AND l.ts = v.ts GROUP BY v.term, v.doc_id),
total AS (SELECT count(DISTINCT doc_id) AS n FROM cur),
stats AS (SELECT term, count(*) AS n_docs, CAST(sum(freq) AS BIGINT) AS freq,
  CASE WHEN sum(freq) > 0 THEN log2(sum(freq)) - sum(CASE WHEN freq > 0 THEN freq * log2(freq) ELSE 0 END) / sum(freq) ELSE 0 END AS h
  FROM cur GROUP BY term),
w AS (SELECT cur.term, cur.doc_id, cur.freq, stats.n_docs,
  log2(1 + cur.freq) * greatest(1 - CASE WHEN n > 1 THEN h / log2(n) ELSE 0 END, 0) AS weight
  FROM cur JOIN stats ON stats.term = cur.term, total)
"""
_MARK = "CASE WHEN n_docs > 0.3 * n THEN 'common' WHEN n_docs <= 2 THEN 'rare' END"

QUERIES = {"p3_found": p3_found, "p3_weights": p3_weights, "p3_hits": p3_hits, "p4_found": p4_found, "p4_counts": p4_counts, "p4_reports": p4_reports}
SQL = {
    "p3_found": _CURRENT + "SELECT doc_id, term FROM w WHERE freq >= 5 AND n_docs BETWEEN 2 AND 6",
    "p3_weights": _CURRENT + "SELECT term, doc_id, freq, n_docs, round(weight, 6) AS weight FROM w",
    "p3_hits": _CURRENT
    + """, h AS (SELECT hit_id, min(q) AS q, min(doc_id) AS doc_id, max(score) AS score FROM hits GROUP BY hit_id),
t AS (SELECT DISTINCT hit_id, doc_id, unnest(regexp_split_to_array(trim(q), '\\s+')) AS term FROM h),
s AS (SELECT t.hit_id, sum(coalesce(w.weight, 0)) AS x FROM t LEFT JOIN w ON w.term = t.term AND w.doc_id = t.doc_id GROUP BY t.hit_id)
SELECT h.hit_id, h.doc_id, h.score, round(coalesce(s.x, 0), 6) AS weight FROM h LEFT JOIN s ON s.hit_id = h.hit_id""",
    "p4_found": _CURRENT + f"SELECT term, {_MARK} AS mark FROM stats, total WHERE {_MARK} IS NOT NULL",
    "p4_counts": _CURRENT + f"SELECT term, freq, n_docs, {_MARK} AS mark FROM stats, total",
    "p4_reports": _CURRENT
    + """, said AS (SELECT term, CAST(sum(freq) AS BIGINT) AS reported, count(*) AS n_shards FROM
  (SELECT lower(trim(term)) AS term, shard, max(freq) AS freq FROM keywords WHERE term IS NOT NULL GROUP BY ALL) GROUP BY term)
SELECT said.term, reported, n_shards, stats.freq AS true_freq, n_docs FROM said LEFT JOIN stats ON stats.term = said.term""",
}
