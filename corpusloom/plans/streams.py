"""Queries of the streaming twins: a table's files as a stream, against the closed form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import is_folder, table
from corpusloom.streaming.throughput import counts_per_interval, event_stream, polite_slots, settled


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    if is_folder(spark, f"{d}/events.parquet"):
        return event_stream(spark, f"{d}/events.parquet", schema)
    return event_stream(spark, d, schema, only="events.parquet")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of every ten minutes that the watermark has passed."""
    events = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"))
    return settled(counts_per_interval(events, "ts", 600)).select(F.col("t").cast("timestamp_ntz").alias("t"), "n")


def stream_slots(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a user half a minute apart, by the user's clock kept as state."""
    asked = _events(spark, d).select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("arrival"))
    return settled(polite_slots(asked, 30.0)).select("seq", F.round("slot", 3).alias("slot"))


QUERIES = {"stream_counts": stream_counts, "stream_slots": stream_slots}
SQL = {
    "stream_counts": """WITH b AS (SELECT floor(epoch(ts))::BIGINT // 600 * 600 AS s, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY s), m AS (SELECT max(epoch(ts)) AS last FROM events)
SELECT to_timestamp(s)::TIMESTAMP AS t, n FROM b, m WHERE s + 600 <= last - 600""",
    "stream_slots": """WITH r AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS a, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) - 1 AS i FROM events)
SELECT event_id AS seq, round(i * 30.0 + max(a - i * 30.0) OVER (PARTITION BY user_id ORDER BY a, event_id), 3)::DOUBLE AS slot FROM r""",
}
