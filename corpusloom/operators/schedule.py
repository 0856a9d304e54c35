"""Throughput over time, rate limits and polite gaps as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.scale import numbered, running_max

SAMPLES = 120


def throughput(events: DataFrame, ts: str = "ts", seconds: int = 1, keep: int | None = SAMPLES) -> DataFrame:
    """(t, pages, rps): one sample for each interval from the first event to the last, empty ones with 0; the last `keep` of them.

    Events are counted per interval before anything is ordered, so the windows run over intervals, not events; with `keep`
    only the last intervals are generated and older events enter as one sum.
    """
    bucket = F.floor(F.unix_timestamp(ts) / seconds).cast("bigint")
    counts = events.where(F.col(ts).isNotNull()).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("b").alias("low"), F.max("b").alias("high")).first()
    if ends["low"] is None:
        return events.sparkSession.createDataFrame([], "t timestamp, pages bigint, rps double")
    low = ends["low"] if keep is None else max(ends["low"], ends["high"] - keep + 1)
    before = counts.where(F.col("b") < low).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spine = events.sparkSession.range(low, ends["high"] + 1).withColumnRenamed("id", "b")
    dense = spine.join(counts, "b", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # the running sum runs over intervals of an hour and adds the hours before, so no window holds a whole history
    hour = F.floor(F.col("b") * seconds / 3600)
    dense = dense.withColumn("__h", hour)
    hours = dense.groupBy("__h").agg(F.sum("n").alias("s"))
    past = hours.select("__h", (F.sum("s").over(Window.orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s") + F.lit(before)).alias("past"))
    inside = Window.partitionBy("__h").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    out = dense.join(past, "__h").withColumn("pages", F.col("past") + F.sum("n").over(inside))
    return out.select(F.timestamp_seconds(F.col("b") * seconds).alias("t"), F.col("pages").cast("bigint").alias("pages"), (F.col("n") / seconds).alias("rps"))


def last_samples(samples: DataFrame, n: int) -> DataFrame:
    return samples.orderBy(F.desc("t")).limit(n)


def scaled(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """`value` over its maximum, which counts as 1 at least; the maximum is one number."""
    top = df.agg(F.max(value)).first()[0]
    return df.withColumn(out, F.col(value) / F.lit(float(max(top or 1, 1))))


def token_bucket(requests: DataFrame, rate: float, arrival: str = "arrival", by: list[str] | None = None, order: str = "seq", rows_per_block: int = 1_000_000) -> DataFrame:
    """Requests with `release`, when a bucket of `rate` tokens a second and a burst of max(1, int(rate)) lets them pass.

    Closed form: with T = 1 / rate, TAT(i) = (i + 1) T + max(a(j) - j T, j <= i), release(i) = max(a(i), TAT(i-1) - (burst - 1) T).
    A running maximum, taken inside blocks and carried over between them, so neither the global bucket nor a host with most
    requests is one task. Without a rate every request passes at once.
    """
    if rate <= 0:
        return requests.withColumn("release", F.col(arrival).cast("double"))
    step, burst = 1.0 / rate, max(1, int(rate))
    keys = by or []
    rows = numbered(requests, keys, [order], [order], "__i", rows_per_block).withColumn("__v", F.col(arrival).cast("double") - F.col("__i") * step)
    rows = running_max(rows, keys, [order], "__v", "__top", include=False)
    return rows.withColumn("release", F.greatest(F.col(arrival).cast("double"), F.col("__i") * step + F.col("__top") - (burst - 1) * step)).drop("__i", "__v", "__top", "__blk")


def min_gap(requests: DataFrame, gap: float, arrival: str = "arrival", host: str = "host", order: str = "seq", rows_per_block: int = 1_000_000) -> DataFrame:
    """Requests with `slot`: at least `gap` seconds after the one before at the same host; no wait without a host or a gap."""
    if gap <= 0:
        return requests.withColumn("slot", F.col(arrival).cast("double"))
    rows = numbered(requests, [host], [order], [order], "__i", rows_per_block).withColumn("__v", F.col(arrival).cast("double") - F.col("__i") * gap)
    rows = running_max(rows, [host], [order], "__v", "__top")
    slot = F.col("__i") * gap + F.col("__top")
    return rows.withColumn("slot", F.when(F.coalesce(F.col(host).cast("string"), F.lit("")) == "", F.col(arrival).cast("double")).otherwise(slot)).drop("__i", "__v", "__top", "__blk")


def two_buckets(requests: DataFrame, global_rate: float, host_rate: float) -> DataFrame:
    """The global bucket first, then one for each host; requests without a host skip the second."""
    first = token_bucket(requests, global_rate).withColumnRenamed("release", "__g")
    named = F.coalesce(F.col("host"), F.lit("")) != ""
    second = token_bucket(first.where(named), host_rate, "__g", ["host"])
    return second.unionByName(first.where(~named).withColumn("release", F.col("__g").cast("double"))).drop("__g")


def rate(pages: Column, before: Column, seconds: float = 1.0) -> Column:
    return (pages - before) / seconds
