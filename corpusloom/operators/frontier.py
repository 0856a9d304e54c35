"""The frontier of a crawl: what has been seen, what comes next, and how much waits at each host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.url import host_of
from corpusloom.operators.scale import numbered


def first_depth(items: DataFrame) -> DataFrame:
    """(url, depth): each address once, at its least depth."""
    return items.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("depth").alias("depth"))


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items whose address has not been seen; an exact anti-join where a filter of bits would err."""
    return items.join(seen.select("url").distinct(), "url", "left_anti")


def push_once(items: DataFrame) -> DataFrame:
    """The first push of every trimmed address, by seq."""
    trimmed = items.withColumn("url", F.trim("url")).where(F.col("url") != "")
    return trimmed.groupBy("url").agg(F.min_by(F.struct(*[c for c in items.columns if c != "url"]), "seq").alias("__v")).select("url", "__v.*")


def in_order(items: DataFrame, limit: int) -> DataFrame:
    """The next `limit` items: highest priority, least depth, first pushed. Every task keeps `limit` candidates only."""
    return items.orderBy(F.desc("priority"), "depth", "seq").limit(limit)


def ranked_by_host(items: DataFrame, host: Column | None = None, rows_per_block: int = 1_000_000) -> DataFrame:
    """`rank` of each item among those of its host, in the frontier's order; a host with most items is numbered in blocks."""
    rows = items.withColumn("host", host if host is not None else host_of(F.col("url"))).withColumn("__d", -F.col("priority"))
    out = numbered(rows, ["host"], ["__d", "depth", "seq"], ["__d", "depth", "seq"], "rank", rows_per_block)
    return out.withColumn("rank", F.col("rank") + 1).drop("__d", "__blk")


def pending_per_host(items: DataFrame) -> DataFrame:
    """(host, pending); items without a host are left out."""
    hosts = items.select(host_of(F.col("url")).alias("host")).where(F.col("host") != "")
    return hosts.groupBy("host").agg(F.count(F.lit(1)).alias("pending"))


#: Bits for each address of a filter; with three slots about 0.5 % of strangers seem to be seen.
BITS_EACH = 16
#: Largest filter; beyond it only the exact anti-join is offered.
MOST_BITS = 1 << 28
_PRIME = np.uint64(1099511628211)
_START = 14695981039346656037


def _slots(urls: pd.Series, bits: int) -> np.ndarray:
    """Three slots of every address: 64-bit FNV-1a over a byte with the round's number and the address; all addresses at once.

    Longest first, so that at each byte those that are not over yet are a prefix."""
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    left = np.bincount(sizes, minlength=1)[::-1].cumsum()[::-1] if len(raw) else np.zeros(1, dtype=np.int64)
    out = np.empty((len(raw), 3), dtype=np.int64)
    for k in range(3):
        h = np.full(len(raw), ((_START ^ k) * int(_PRIME)) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for at in range(len(left) - 1):
            n = left[at + 1]
            h[:n] = (h[:n] ^ flat[starts[:n] + at]) * _PRIME
        out[order, k] = (h % np.uint64(bits)).astype(np.int64)
    return out


def bits_for(n: int) -> int | None:
    """Bits of a filter for `n` addresses; None where it would be larger than MOST_BITS."""
    bits = max(64, (n * BITS_EACH + 63) // 64 * 64)
    return bits if bits <= MOST_BITS else None


def bloom_bits(urls: DataFrame, bits: int) -> bytes:
    """A filter of `bits` bits (a multiple of 64) over all addresses: every task sets its own array, the arrays are joined by or.

    What reaches the driver is the filter, whose size the caller sets, see `bits_for`.
    """
    bits = max(64, (bits + 63) // 64 * 64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.zeros(bits, dtype=bool)
        for batch in batches:
            mine[_slots(batch["url"], bits).ravel()] = True
        words = np.packbits(mine.reshape(-1, 64)[:, ::-1], axis=1).view(">u8").ravel()
        used = np.flatnonzero(words)
        yield pd.DataFrame({"word": used, "value": words[used].astype(np.int64)})

    parts = urls.where(F.col("url").isNotNull()).select("url").mapInPandas(run, "word bigint, value bigint")
    words = np.zeros(bits // 64, dtype=np.int64)
    got = parts.groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words[got["word"].to_numpy(dtype=np.int64)] = got["value"].to_numpy(dtype=np.int64)
    return words.astype("<i8").tobytes()


def may_be_seen(url: Column, sent: Broadcast) -> Column:
    """Whether all three bits of an address are set in a filter sent to all tasks; never false for one that was added."""

    @F.pandas_udf("boolean")
    def run(urls: pd.Series) -> pd.Series:
        words = np.frombuffer(sent.value, dtype="<u8")
        slots = _slots(urls.fillna(""), len(words) * 64)
        hit = (words[slots // 64] >> (slots % 64).astype(np.uint64)) & np.uint64(1)
        return pd.Series(hit.all(axis=1)) & urls.notna()

    return run(url)


def seen_or_not(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items (url) whose address was surely not seen, by a filter of bits sized for the counted addresses: it errs only by leaving
    out some new ones. Where the filter would be too large the exact anti-join answers instead."""
    urls = seen.select("url").where(F.col("url").isNotNull()).distinct()
    bits = bits_for(urls.count())
    if bits is None:
        return unseen(items, seen)
    sent = items.sparkSession.sparkContext.broadcast(bloom_bits(urls, bits))
    return items.where(F.col("url").isNotNull()).where(~may_be_seen(F.col("url"), sent))
