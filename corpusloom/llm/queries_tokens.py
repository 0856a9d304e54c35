"""Queries of problems 8 and 9: token ids, and mixing sources by their size in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.encode import encode
from corpusloom.llm.lines import host_site
from corpusloom.llm.mix import mix, reached, source_sizes, temperature, tempered_targets
from corpusloom.sources.tables import stored, table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode(table(spark, d, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "ids")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), host_site(F.col("url")))
    return source_sizes(table(spark, d, "documents").select("doc_id", "url", "source", "text"), "doc_id", source)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used, so that every source has its target share of all tokens."""
    chosen = mix(_sizes(spark, d), table(spark, d, "mix_targets"))
    return chosen.select(F.col("id").alias("doc_id"), "source", "n_tokens", "times")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares really reached."""
    targets = table(spark, d, "mix_targets")
    return reached(stored_mix(spark, d), targets)


def stored_mix(spark: SparkSession, d: str) -> DataFrame:
    return stored(mix(_sizes(spark, d), table(spark, d, "mix_targets")), "mix")


def p9_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Temperature mixing: weights are the sources' token shares to the power whose entropy is that of the targets, realised under
    the repetition limits; the shares really reached beside them."""
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    exponent, weights = tempered_targets(sizes, targets)
    got = reached(stored(mix(sizes, weights), "mix"), weights)
    return got.select("source", F.lit(exponent).alias("exponent"), F.col("target_share").alias("weight"), "tokens", "share", "n_docs", "most_times")


def p9_temperature(spark: SparkSession, d: str) -> DataFrame:
    """Weights by temperature: the flattest mix of half the corpus' size that repeats no source more than its limit. Sources are
    those of the targets, a table of fixed size."""
    targets = table(spark, d, "mix_targets").where(F.col("source").isNotNull())
    rows = _sizes(spark, d).groupBy("source").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(targets.select("source", "max_repeats")), "source").where(F.col("n") > 0).collect()
    sizes, limits = {r["source"]: float(r["n"]) for r in rows}, {r["source"]: float(1 if r["max_repeats"] is None else r["max_repeats"]) for r in rows}
    exponent, weights = temperature(sizes, repeats=limits, budget=sum(sizes.values()) / 2)
    return spark.createDataFrame([(s, sizes[s], exponent, w) for s, w in sorted(weights.items())], "source string, tokens double, exponent double, weight double")


QUERIES = {"p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_temperature": p9_temperature, "p9_tempered": p9_tempered}
SQL: dict[str, str] = {}
