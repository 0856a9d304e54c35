"""Streaming twins: throughput per interval under a watermark, and the clock of each host as kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from corpusloom.sources.tables import stream_folder


def event_stream(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int = 1, only: str | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive, those with a name like `only` if given; so many of them make a micro-batch, which
    bounds what one batch holds of a host."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", only) if only else reader).parquet(folder)


def counts_per_interval(events: DataFrame, ts: str = "ts", seconds: int = 1, late: str = "10 minutes") -> DataFrame:
    """(t, n): events of every interval, given out once the watermark has passed it; later events are dropped.

    State is one number for each open interval. Empty intervals are filled in downstream, as a stream cannot know them.
    """
    win = F.window(ts, f"{seconds} seconds")
    return events.withWatermark(ts, late).groupBy(win.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("t"), "n")


def polite_slots(requests: DataFrame, gap: float) -> DataFrame:
    """(host, seq, arrival, slot): requests of a host at least `gap` seconds apart; the state of a host is its last slot.

    Within a batch a host's requests are taken in the order of their arrival.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["arrival", "seq"], kind="stable")
        slots = []
        for a in rows["arrival"]:
            last = max(float(a), last + gap)
            slots.append(last)
        state.update((last,))
        yield pd.DataFrame({"host": rows["host"], "seq": rows["seq"], "arrival": rows["arrival"], "slot": slots})

    return requests.groupBy("host").applyInPandasWithState(
        run, "host string, seq bigint, arrival double, slot double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its table; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def settled(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Run a stream over what is there into Parquet files of the shared folder, and read them; its state and offsets lie beside."""
    folder = stream_folder(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
