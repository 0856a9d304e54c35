"""Heavy keys and streaming twins."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators.heavy_keys import degrees, dense_counts, outsized_keys
from corpusloom.operators.scale import hot_keys, salted_join
from corpusloom.operators.schedule import min_gap, throughput
from corpusloom.streaming.throughput import counts_per_interval, drain, event_stream, polite_slots


def _edges(spark):
    rows = [(f"s{i % 50}", "hot" if i % 3 == 0 else None if i % 31 == 0 else f"d{i % 400}", i) for i in range(3000)]
    return spark.createDataFrame(rows, "src string, dst string, n int"), rows


def test_dense_counts(spark):
    df, rows = _edges(spark)
    want = Counter(r[1] for r in rows)
    for block in (10, 200_000):
        assert {r["key_value"]: r["n"] for r in dense_counts(df.repartition(3), "dst", block).collect()} == want
    assert dense_counts(df.limit(0), "dst").collect() == []


def test_outsized(spark):
    df, rows = _edges(spark)
    counts = Counter(r[1] for r in rows)
    keys = len([k for k in counts if k is not None])
    want = {k for k, n in counts.items() if k is not None and n >= 0.01 * len(rows) and n >= 10 * len(rows) / keys}
    assert {r["key_value"] for r in outsized_keys(df, "dst").collect()} == want == {"hot"}
    assert outsized_keys(df.limit(0), "dst").collect() == []


def test_degrees(spark):
    df, rows = _edges(spark)
    got = {r["dst"]: (r["n_rows"], r["n_sources"]) for r in degrees(df).collect()}
    assert got["hot"] == (1000, len({r[0] for r in rows if r[1] == "hot"})) and None not in got


def test_salted_join_keeps_every_row(spark):
    big = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("k"), "id")
    small = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(big, "k")
    assert 0 in hot
    a = salted_join(big, small, "k", "id", hot).groupBy().agg(F.count("id"), F.sum("v")).first()
    assert a == big.join(small, "k", "left").groupBy().agg(F.count("id"), F.sum("v")).first()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select(F.timestamp_seconds(F.col("id") * 7 % 1000).alias("ts"))
    rows.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = counts_per_interval(event_stream(spark, str(tmp_path / "in"), "ts timestamp", 10), "ts", 10, "1 hour")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("update" if False else "append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {r["t"]: r["rps"] * 10 for r in throughput(rows, "ts", 10, None).collect()}
    got = {r["t"]: r["n"] for r in spark.table("counts").collect()}
    assert all(batch[t] == n for t, n in got.items())


def test_polite_stream_equals_window(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 5).cast("string").alias("host"), F.col("id").alias("seq"), (F.col("id") * 0.3).alias("arrival"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), "host string, seq bigint, arrival double")
    got = {r["seq"]: round(r["slot"], 6) for r in drain(polite_slots(stream, 2.0), "polite", str(tmp_path / "c")).collect()}
    assert got == {r["seq"]: round(r["slot"], 6) for r in min_gap(rows, 2.0).collect()}


def test_degrees_run_through_the_accumulators(spark):
    df, rows = _edges(spark)
    df = df.union(spark.createDataFrame([(None, "hot", 1), (None, "lone", 2), (None, "lone", 3)], df.schema))
    rows = [*rows, (None, "hot", 1), (None, "lone", 2), (None, "lone", 3)]
    want = {k: (sum(r[1] == k for r in rows), len({r[0] for r in rows if r[1] == k and r[0]})) for k in {r[1] for r in rows} if k}
    for block in (10, 200_000):
        got = degrees(df.repartition(3), block)
        assert {r["dst"]: (r["n_rows"], r["n_sources"]) for r in got.collect()} == want
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert degrees(df.limit(0)).collect() == []
