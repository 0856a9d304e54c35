"""Joins and groupings that stay even when one key owns a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import stored

#: A side with at most so many rows and bytes may be broadcast; both are counted before.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 16 << 20
#: A key is hot when it owns more than this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.002
SALTS = 48


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether `df` was counted to have at most `limit` rows and `most` bytes, long strings and arrays included. Counting stops
    after `limit` rows."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= limit and (size or 0) <= most


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is small, else as it is (a shuffle join follows). Give it stored or small inputs, as
    counting reads them once more."""
    return F.broadcast(df) if is_small(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores if a small file leaves it in fewer partitions; a large table has more and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys with more than `share` of all rows: at most 1 / share of them, found by one pre-aggregated count."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    if not total:
        return []
    return [r[0] for r in counts.where(F.col("__n") > max(1000, int(total * share))).select(key).collect()]


def salt(key: Column, hot: Sequence, by: Column, salts: int = SALTS) -> Column:
    """0 for ordinary keys; for hot ones a number below `salts` that depends on `by` only, so a rerun gives the same."""
    if not hot:
        return F.lit(0)
    return F.when(key.isin(list(hot)), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)


def salted_join(big: DataFrame, small: DataFrame, key: str, by: str, hot: Sequence, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join `big` to `small` (unique in `key`): rows of hot keys are spread over `salts` tasks, whose few rows of `small` are repeated.

    All other keys join as usual. No row is dropped or sampled.
    """
    if not hot:
        return big.join(small, key, how)
    many = small.withColumn("__salt", F.explode(F.when(F.col(key).isin(list(hot)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return big.withColumn("__salt", salt(F.col(key), hot, F.col(by), salts)).join(many, [key, "__salt"], how).drop("__salt")


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_block: int = 1_000_000) -> DataFrame:
    """`df` with `__blk`: rows in ranges of (keys, order) of about `rows_per_block`, so that a key with a third of all rows spans many.

    The ranges are stored, as a number of a partition is only good for the partitioning it was read from. Small inputs are one block.
    """
    n = -(-df.count() // rows_per_block)
    if n <= 1:
        return df.withColumn("__blk", F.lit(0))
    return stored(df.repartitionByRange(int(n), *keys, *order).withColumn("__blk", F.spark_partition_id()), "blocks")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sort_by: Sequence[str], name: str = "i", rows_per_block: int = 1_000_000) -> DataFrame:
    """`df` with `name`, the row's number from 0 within its keys; and `__blk`. Windows run inside blocks, over blocks only sums.

    `order` sorts inside a block, `sort_by` names the columns that sort the same way and make the ranges.
    """
    blocks = in_blocks(df, keys, sort_by, rows_per_block)
    local = (F.row_number().over(Window.partitionBy(*keys, "__blk").orderBy(*order)) - 1).cast("bigint")
    sizes = blocks.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__blk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]
    key = F.concat_ws("\x01", *filled) if keys else F.lit("")
    joined = blocks.withColumn("__l", local).withColumn("__k", key).join(sized(offsets.withColumn("__k", key).drop(*keys)), ["__k", "__blk"]).drop("__k")
    return joined.withColumn(name, F.col("__l") + F.col("__o")).drop("__l", "__o")


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, include: bool = True) -> DataFrame:
    """`df` (with `__blk`) with `name`: the maximum of `value` over the rows up to this one within its keys, or before it."""
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    tops = df.groupBy(*keys, "__blk").agg(F.max(value).alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    filled = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]
    past = tops.withColumn("__p", F.max("__m").over(before)).withColumn("__k", F.concat_ws("\x01", *filled) if keys else F.lit("")).select("__k", "__blk", "__p")
    rows = df.withColumn("__x", F.max(value).over(upto)).withColumn("__k", F.concat_ws("\x01", *filled) if keys else F.lit(""))
    return rows.join(sized(past), ["__k", "__blk"]).withColumn(name, F.greatest("__x", "__p")).drop("__k", "__x", "__p")
