"""Mixing sources to target weights.

Weights come from a temperature: the sources' token shares to the power of an exponent, which is found by bisection so that
the weights have a wanted entropy or no source is repeated more often than it may; or they are given. The largest total
size at which every source reaches its weight within its repetition limit is then realised by budgeted block permutations:
a source's documents fall into blocks by a hash of their id, the blocks are put in an order drawn from the seed, whole
blocks are taken as long as they fit, larger ones passed over, and only in the smallest of those are documents counted one by one.

Scale: per-source and per-block sums are pre-aggregated; a group never holds more than one source's blocks (their number
is a parameter) or one block's documents, so a source with a third of all rows is no hot spot. Texts are tokenised once; only
(id, source, n_tokens) is stored.

Defined cases: documents without tokens (null or empty text) are used zero times; sources without a target, or with a null,
zero or negative one, contribute nothing; targets of sources without tokens are given up and the remaining ones scaled to 1;
max_repeats of null counts as 1; repeated rows are documents of their own, in the order of a hash; empty tables give an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.encode import encode
from corpusloom.operators.scale import sized
from corpusloom.sources.tables import stored

#: Blocks of a source at least; more where blocks would hold over BLOCK_ROWS documents.
BLOCKS = 512
BLOCK_ROWS = 1_000_000
#: Largest exponent that is tried.
MOST_EXPONENT = 64.0


def source_sizes(docs: DataFrame, id_col: str, source: Column, path: str | None = None) -> DataFrame:
    """(id, source, n_tokens), stored: sizes in tokens of the public tokenizer; the source goes through the encoder with its text."""
    return stored(encode(docs, id_col, "text", path, counts=True, keep={"source": source}), "sizes")


def temperature(sizes: dict[str, float], entropy: float | None = None, repeats: dict[str, float] | None = None, budget: float | None = None) -> tuple[float, dict[str, float]]:
    """The exponent and the weights.

    With `entropy` (in nats) the exponent gives weights of that entropy, or the nearest that shares to a power of at most
    MOST_EXPONENT can have; it is above 1 where the sources are more even than wanted. With `repeats` and `budget` it is the
    smallest one up to 1 (the flattest mix) that uses no source more than its limit.
    """
    known = {s: n for s, n in sizes.items() if n > 0}
    total = sum(known.values())
    if not known:
        return 1.0, {}

    def weights(a: float) -> dict[str, float]:
        w = {s: (n / total) ** a for s, n in known.items()}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    def enough(a: float) -> bool:
        w = weights(a)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values() if x > 0) <= entropy
        return all(w[s] * budget <= known[s] * (repeats or {}).get(s, math.inf) for s in known)

    low, high = 0.0, 1.0
    if enough(low):
        return low, weights(low)
    while entropy is not None and high < MOST_EXPONENT and not enough(high):
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high, weights(high)


def plan(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> list[tuple[str, float, float, int]]:
    """(source, tokens, quota, max_repeats) for each source with a target; bounded by the number of targets.

    quota = share * total, where total is `budget` or the most that every repetition limit allows.
    """
    tokens = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = targets.where(F.col("target_share") > 0).join(tokens, "source", "left").select("source", "target_share", "max_repeats", "tokens").collect()
    known = [(r["source"], float(r["target_share"]), float(r["tokens"]), max(int(r["max_repeats"] if r["max_repeats"] is not None else 1), 0)) for r in rows if r["tokens"] and (r["max_repeats"] is None or r["max_repeats"] > 0)]
    shares = sum(s for _, s, _, _ in known)
    if not known:
        return []
    most = min(t * m * shares / s for _, s, t, m in known)
    total = most if budget is None else min(budget, most)
    return [(name, t, s / shares * total, m) for name, s, t, m in known]


def take_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """(source, __b, state, left) of one source's blocks in their drawn order: whole blocks are taken (1) while they fit into what
    is left of the budget, and those that do not are passed over (0). The smallest one passed over is the edge (2), in which
    documents are counted one by one; `left` is what is left for it."""
    left = float(blocks["rest"].iloc[0])
    state = np.zeros(len(blocks), dtype=np.int32)
    sizes = blocks["size"].to_numpy(dtype=np.float64)
    for i in np.argsort(blocks["drawn"].to_numpy(), kind="stable"):
        if sizes[i] <= left:
            state[i] = 1
            left -= sizes[i]
    passed = np.flatnonzero(state == 0)
    if len(passed) and left > 0:
        state[passed[np.argmin(sizes[passed])]] = 2
    return pd.DataFrame({"source": blocks["source"], "__b": blocks["__b"], "state": state, "left": left})


def take_documents(docs: pd.DataFrame) -> pd.DataFrame:
    """`more` of the documents of one source's edge block in their drawn order: what fits is taken, what does not is passed over.
    At the end the document that comes nearest to what is left is taken if more than half of it fits."""
    left = float(docs["left"].iloc[0])
    sizes = docs["n_tokens"].to_numpy(dtype=np.float64)
    more = np.zeros(len(docs), dtype=np.int32)
    for i in np.lexsort((sizes, docs["id"].to_numpy(), docs["drawn"].to_numpy())):
        if sizes[i] <= left:
            more[i] = 1
            left -= sizes[i]
    free = np.flatnonzero((more == 0) & (sizes < 2 * left))
    if len(free):
        more[free[np.argmin(sizes[free])]] = 1
    return pd.DataFrame({"id": docs["id"], "source": docs["source"], "n_tokens": docs["n_tokens"], "full": docs["full"], "max_repeats": docs["max_repeats"], "more": more})


def mix(sizes: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 0, blocks: int | None = None) -> DataFrame:
    """(id, source, n_tokens, times): how often each document is used; rows of 0 uses are left out.

    A group of `take_blocks` is a source's blocks, a group of `take_documents` one block; neither grows with the collection but
    for the number of blocks, which keeps a block at about BLOCK_ROWS documents.
    """
    quotas = plan(sizes, targets, budget)
    spark = sizes.sparkSession
    blocks = blocks or max(BLOCKS, -(-sizes.count() // BLOCK_ROWS))
    each = [(s, int(q // t), float(q - int(q // t) * t), m) for s, t, q, m in quotas]
    base = spark.createDataFrame(each, "source string, full int, rest double, max_repeats int")
    rows = sizes.where(F.col("n_tokens") > 0).join(sized(base), "source")
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), "source", "id"), F.lit(blocks)).cast("int"))
    summed = rows.groupBy("source", "__b").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    drawn = summed.withColumn("drawn", F.xxhash64(F.lit(seed + 1), "source", "__b"))
    taken = stored(drawn.groupBy("source").applyInPandas(take_blocks, "source string, __b int, state int, left double"), "blocks")
    rows = rows.join(sized(taken), ["source", "__b"])
    edge = rows.where(F.col("state") == 2).select("id", "source", "n_tokens", "full", "max_repeats", "left", F.xxhash64(F.lit(seed + 2), "id").alias("drawn"))
    last = edge.groupBy("source").applyInPandas(take_documents, "id bigint, source string, n_tokens bigint, full int, max_repeats int, more int")
    rest = rows.where(F.col("state") != 2).select("id", "source", "n_tokens", "full", "max_repeats", F.col("state").alias("more"))
    times = F.least(F.col("full") + F.col("more"), F.col("max_repeats"))
    return rest.unionByName(last).select("id", "source", "n_tokens", times.alias("times")).where(F.col("times") > 0)


def tempered_targets(sizes: DataFrame, targets: DataFrame, entropy: float | None = None) -> tuple[float, DataFrame]:
    """The exponent, and (source, target_share, max_repeats) with the sources' token shares to its power as targets.

    The exponent is bisected to the entropy of the given targets, or to `entropy`. Only sources with a target take part; their
    number bounds what is collected.
    """
    known = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(targets.where(F.col("target_share") > 0), "source").collect()
    sized_by = {r["source"]: float(r["n"]) for r in known}
    total = sum(float(r["target_share"]) for r in known)
    shares = [float(r["target_share"]) / total for r in known]
    wanted = -sum(x * math.log(x) for x in shares) if entropy is None else entropy
    exponent, weights = temperature(sized_by, entropy=wanted)
    limits = {r["source"]: r["max_repeats"] for r in known}
    rows = [(s, w, limits[s]) for s, w in sorted(weights.items())]
    return exponent, sizes.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int")


def reached(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, n_docs, most_times) of the selection."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("times").alias("most_times"))
    total = chosen.agg(F.sum(F.col("n_tokens") * F.col("times"))).first()[0] or 1
    return targets.join(got, "source", "left").select(
        "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.lit(total)).alias("share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_times", F.lit(0)).alias("most_times")
    )
