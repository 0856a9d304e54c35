"""Per-key results when a few keys own most rows: dense accumulator arrays.

Every task reads one input split of equal size, whatever the keys in it. It dictionary-encodes the keys of each Arrow
batch, counts the codes with numpy's bincount and adds the counts to the split's own accumulator array. What leaves a
split is at most one row per distinct key and block, so the owner of a third of all rows sends one number per split. The
blocks are then summed by a distributed reduction over the key.

Defined cases: null keys are counted under a null key and are left to the caller; an empty table gives an empty result;
repeated rows count as often as they are stored; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import stored

#: Distinct keys held by a split before its block of sums is sent on.
BLOCK_KEYS = 200_000


def _accumulate(block_keys: int, sums_of: tuple[str, ...] = ()):
    """Sums of the columns that follow the key, or the number of its rows where there are none."""
    names = sums_of or ("n",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}
        sums = np.zeros((len(names), 1024), dtype=np.int64)

        def block() -> pa.RecordBatch:
            keys = pa.array(list(index), type=pa.string())
            return pa.RecordBatch.from_arrays([keys, *(pa.array(x[: len(index)]) for x in sums)], names=["key_value", *names])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            words = coded.dictionary.to_pylist()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            if coded.null_count:
                codes = np.where(np.isnan(codes), len(words), codes).astype(np.int64)
                words.append(None)
            slots = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
            if len(index) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros((len(names), max(sums.shape[1], len(index))), dtype=np.int64)], axis=1)
            if sums_of:
                for k in range(len(names)):  # weights are doubles, exact to 2 ** 53 in a batch
                    sums[k, slots] += np.bincount(codes, batch.column(k + 1).to_numpy(zero_copy_only=False), len(words)).astype(np.int64)
            else:
                sums[0, slots] += np.bincount(codes, minlength=len(words))
            if len(index) >= block_keys:
                yield block()
                index, sums = {}, np.zeros((len(names), 1024), dtype=np.int64)
        if index:
            yield block()

    return run


def dense_counts(df: DataFrame, key: str, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(key_value STRING, n BIGINT): rows per distinct value of `key`, null included."""
    parts = df.select(F.col(key).cast("string").alias("key_value")).mapInArrow(_accumulate(block_keys), "key_value string, n bigint")
    return parts.groupBy("key_value").agg(F.sum("n").alias("n"))


def outsized_keys(df: DataFrame, key: str, share: float = 0.01, times_mean: float = 10.0) -> DataFrame:
    """Keys that hold at least `share` of the rows and at least `times_mean` times the mean rows per distinct key.

    Null keys are no keys, but their rows count in both. Two small sums and a filter; the counts are computed once.
    """
    counts = stored(dense_counts(df, key), "key-counts")
    whole = counts.agg(F.sum("n").alias("rows"), F.count("key_value").alias("keys")).first()
    rows, keys = whole["rows"] or 0, whole["keys"]
    return counts.where(
        F.col("key_value").isNotNull() & (F.col("n") >= F.lit(rows * share)) & (F.col("n") * F.lit(keys) >= F.lit(rows * times_mean))
    )


def degrees(edges: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(dst, n_rows, n_sources): stored rows and distinct non-null sources of every non-null `dst`.

    Repeats are removed under the pair, which has no heavy key; the pairs' counts then run through the accumulators.
    """
    pairs = edges.where(F.col("dst").isNotNull()).groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n_rows"))
    weighed = pairs.select(F.col("dst").cast("string").alias("dst"), "n_rows", F.col("src").isNotNull().cast("bigint").alias("n_sources"))
    parts = weighed.mapInArrow(_accumulate(block_keys, ("n_rows", "n_sources")), "key_value string, n_rows bigint, n_sources bigint")
    return parts.groupBy(F.col("key_value").alias("dst")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_sources").alias("n_sources"))
