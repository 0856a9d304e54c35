"""The link graph: simple directed edges, nodes with a status and a degree, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import stored

NODES = 400


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without empty ends and loops. The pair is the key, so no page is a hot spot."""
    return edges.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node, combined before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def nodes(crawled: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, url, title, status, degree): crawled pages (url, title), and pending ones that are only linked to.

    One union and one aggregation give status, title and degree at once, without a join.
    """
    pages = crawled.select(F.col("url").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.lit(1).alias("rank"), F.lit(0).alias("d"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), F.lit("").alias("title"), F.lit(0).alias("rank"), F.lit(1).alias("d"))
    one = pages.unionByName(ends).groupBy("id").agg(F.max("title").alias("title"), F.max("rank").alias("rank"), F.sum("d").alias("degree"))
    title = F.when(F.col("title") == "", F.col("id")).otherwise(F.col("title"))
    return one.select("id", F.col("id").alias("url"), title.alias("title"), F.when(F.col("rank") == 1, "crawled").otherwise("pending").alias("status"), "degree")


def truncate(all_nodes: DataFrame, edges: DataFrame, limit: int = NODES) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, ties by id, and the edges between them; 400 for no limit and for one above 800."""
    limit = limit if 0 < limit <= 800 else NODES
    kept = stored(all_nodes.orderBy(F.desc("degree"), "id").limit(limit), "top-nodes")
    ids = F.broadcast(kept.select("id"))  # at most 800
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inner.select("src", "dst")
