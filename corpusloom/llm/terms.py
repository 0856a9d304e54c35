"""Counts and weights of terms over the whole collection.

Input are postings (term, doc_id, freq, indexed_at): of a document only its latest version counts, and repeated rows count
once. Nulls: rows with a null term or doc_id are ignored, a null freq counts 0 occurrences but its record counts, a null
indexed_at is older than any other. Ties in freq of one (term, doc_id, indexed_at) take the larger. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.scale import hot_keys, is_small, salt, salted_join
from corpusloom.sources.tables import stored


def current_rows(postings: DataFrame) -> DataFrame:
    """(term, doc_id, freq): the stored rows of the latest version of each document, repeats included; nothing is grouped by pair.

    Only (doc_id, latest time) is aggregated. It is sent to all tasks if it is small; otherwise documents that own a large part of
    the rows are spread over salted tasks.
    """
    at = F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    rows = postings.where(F.col("term").isNotNull() & F.col("doc_id").isNotNull()).select("term", "doc_id", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"), at.alias("at"))
    latest = stored(rows.groupBy("doc_id").agg(F.max("at").alias("latest")), "latest")
    joined = rows.join(F.broadcast(latest), "doc_id") if is_small(latest, 200_000) else salted_join(rows, latest, "doc_id", "term", hot_keys(rows, "doc_id"), "inner")
    return joined.where(F.col("at") == F.col("latest")).select("term", "doc_id", "freq")


def current_postings(postings: DataFrame) -> DataFrame:
    """(term, doc_id, freq): the latest version of each document, each term once; stored, as several steps read it.

    The grouping is by (term, doc_id), which no heavy term or document can skew.
    """
    return stored(current_rows(postings).groupBy("term", "doc_id").agg(F.max("freq").alias("freq")), "postings")


def last_seen_counts(rows: DataFrame, hot: list | None = None) -> DataFrame:
    """(term, freq, n_docs): occurrences and records of every term by last-seen counters over stored rows with repeats.

    Rows are hash-partitioned by term and ordered by record, the largest freq first. Walking along, a term counts a row only if
    its record differs from the one last seen: then its occurrences are added and one record; a repeat adds nothing. So neither
    pairs are grouped nor sets of records kept. Heavy terms are spread by a hash of the record: all rows of a record fall into
    one part, so the parts' counters add up.
    """
    hot = hot_keys(rows, "term") if hot is None else hot
    part = rows.withColumn("__part", salt(F.col("term"), hot, F.col("doc_id")))
    seen = F.lag("doc_id").over(Window.partitionBy("term", "__part").orderBy("doc_id", F.desc("freq")))
    new = seen.isNull() | (seen != F.col("doc_id"))
    return (
        part.select("term", "__part", F.when(new, F.col("freq")).otherwise(0).alias("freq"), F.when(new, 1).otherwise(0).alias("new"))
        .groupBy("term", "__part")
        .agg(F.sum("freq").alias("freq"), F.sum("new").alias("n_docs"))
        .groupBy("term")
        .agg(F.sum("freq").alias("freq"), F.sum("n_docs").alias("n_docs"))
    )


def marked_terms(rows: DataFrame, rare_docs: int = 2, common_share: float = 0.3, n_docs: int | None = None) -> DataFrame:
    """The counts with `mark`: rare (in at most `rare_docs` records), common (in more than `common_share` of them) or null."""
    n = rows.select(F.count_distinct("doc_id")).first()[0] if n_docs is None else n_docs
    mark = F.when(F.col("n_docs") > F.lit(n * common_share), "common").when(F.col("n_docs") <= rare_docs, "rare")
    return last_seen_counts(rows).withColumn("mark", mark)


def log_entropy(current: DataFrame) -> DataFrame:
    """(term, doc_id, freq, n_docs, weight): log2(1 + freq) * (1 - H / log2(N)).

    H is the entropy of the term's occurrences over records and N the number of records; with p = freq / total,
    H = log2(total) - sum(freq * log2(freq)) / total, so one aggregation by term gives it and a second one N. With N of 1
    every weight is its local part. Terms that own a large part of the rows are spread in the join back.
    """
    n = current.select(F.count_distinct("doc_id")).first()[0]
    f = F.col("freq").cast("double")
    stats = current.groupBy("term").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(f).alias("__total"), F.sum(F.when(f > 0, f * F.log2(f)).otherwise(0.0)).alias("__flogf")
    )
    spread = F.when(F.col("__total") > 0, F.log2("__total") - F.col("__flogf") / F.col("__total")).otherwise(0.0)
    share = F.lit(1.0) - (spread / F.log2(F.lit(float(n))) if n > 1 else F.lit(0.0))
    joined = salted_join(current, stats.select("term", "n_docs", share.alias("__g")), "term", "doc_id", hot_keys(current, "term"), "inner")
    return joined.select("term", "doc_id", "freq", "n_docs", (F.log2(1 + f) * F.greatest(F.col("__g"), F.lit(0.0))).alias("weight"))
