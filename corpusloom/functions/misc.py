"""Hashes, times, limits and waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(text: Column, size: int = 8) -> Column:
    """The first figures of the SHA-1; 8 for no size, 40 at most."""
    return F.left(F.sha1(text.cast("binary")), F.lit(min(size if size > 0 else 8, 40)))


def local_time(ts: Column) -> Column:
    """Clock time eight hours east of UTC; empty for null. The session runs in UTC."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, "+08:00"), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def clamp(value: Column, default: int, most: int) -> Column:
    """`default` for null, zero and less; never above `most`."""
    return F.least(F.when(value > 0, value).otherwise(F.lit(default)), F.lit(most))


def backoff(attempt: Column, base: float = 0.2, most: float = 1.6, factor: float = 2.0) -> Column:
    """Seconds before the next attempt, without jitter."""
    base = base if base > 0 else 0.2
    most = most if most >= base else 8 * base
    return F.least(F.lit(base) * F.pow(F.lit(factor if factor > 1 else 2.0), F.greatest(attempt, F.lit(0))), F.lit(most))


def with_jitter(seconds: Column, jitter: float = 0.2, seed: int | None = None) -> Column:
    """Up to `jitter` more or less, at least a tenth; applied after the limit, so it may exceed it."""
    if jitter <= 0:
        return seconds
    return seconds * F.greatest(1 + (F.rand(seed) * 2 - 1) * min(jitter, 1.0), F.lit(0.1))


def wait_until(seconds: Column, now: Column, until: Column) -> Column:
    """`seconds`, but no longer than to the deadline, and not below 0; no deadline for null."""
    left = F.greatest(until.cast("double") - now.cast("double"), F.lit(0.0))
    return F.when(until.isNull(), seconds).otherwise(F.least(seconds, left))


def gap_of_rate(rate: Column) -> Column:
    """Seconds between requests at a rate; 0 for no rate."""
    return F.when(rate > 0, 1 / rate).otherwise(F.lit(0.0))
