"""The whole corpus as token ids of a public byte-level tokenizer.

Texts up to CHUNK characters are encoded as they are, one Arrow batch after the other. Longer ones are cut into
overlapping chunks that are pre-tokenised in parallel. Two neighbouring chunks are stitched where a pre-token begins at
the same place in both: the pattern is matched from left to right without memory, so from there on both agree. A chunk
border without such a place joins its chunks. The pieces between the stitches are encoded in parallel and their ids are
concatenated; merges never cross a pre-token, so the result equals encoding the text at once. Decoding concatenates the
raw bytes of the ids.

Defined cases: the ids of a null and of an empty text are an empty list; texts of any length are encoded whole; the
strings of special tokens in a text are ordinary text; repeated rows are encoded each; other columns are ignored. A lone
surrogate, which UTF-8 cannot hold, is encoded as U+FFFD.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a chunk, and of its overlap with the next one.
CHUNK = 65_536
OVERLAP = 1_024

#: Fixed value of the public vocabulary: how text is split before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, tiktoken.Encoding] = {}


def default_ranks() -> str:
    """Rank file of byte_bpe_50k: where BPE_RANKS says, else in the installed package of public tokenizers."""
    if os.environ.get("BPE_RANKS"):
        return os.environ["BPE_RANKS"]
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoder(path: str | None = None) -> tiktoken.Encoding:
    """The encoder of a rank file, loaded once per process."""
    path = path or default_ranks()
    if path not in _ENCODERS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def decode(ids: list[int], path: str | None = None) -> str:
    """The text of ids: their raw bytes, concatenated, then read as UTF-8."""
    enc = encoder(path)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


def _encode(path: str | None, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            lists = [enc.encode_ordinary(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            if counts:
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes)], names=[*names, "n_tokens"])
                continue
            flat = np.empty(int(sizes.sum()), dtype=np.int32)
            at = 0
            for ids in lists:
                flat[at : at + len(ids)] = ids
                at += len(ids)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*names, "ids"])

    return run


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where pre-tokens begin in the first and in the last OVERLAP characters of a chunk, counted from the chunk's start."""
    pattern = regex.compile(PATTERN)
    for batch in batches:
        head, tail = [], []
        for text, size in zip(batch.column("piece").to_pylist(), batch.column("size").to_pylist(), strict=True):
            starts = [m.start() for m in pattern.finditer(text)]
            head.append([s for s in starts if s < OVERLAP])
            # the pre-token at the end of the chunk may go on, so its own start is the last one known
            tail.append([s - size for s in starts if s >= size])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("chunk"), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))],
            names=["row", "chunk", "head", "tail"],
        )


def _pieces(long: DataFrame, chunk: int) -> DataFrame:
    """(row, part, piece): long texts cut where neighbouring chunks agree."""
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    chunks = long.select("row", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select(
        "row", "chunk", F.lit(chunk).alias("size"), F.expr(f"substring(text, chunk * {chunk} + 1, {chunk + OVERLAP})").alias("piece")
    )
    starts = chunks.repartition("row", "chunk").mapInArrow(_starts, "row bigint, chunk int, head array<int>, tail array<int>")
    order = Window.partitionBy("row").orderBy("chunk")
    agree = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    cuts = starts.withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.col("chunk") * F.lit(chunk) + agree)).where(F.col("cut").isNotNull())
    cuts = cuts.groupBy("row").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    parts = long.join(cuts, "row").select("row", "text", "cuts", F.posexplode("cuts").alias("part", "start"))
    end = F.coalesce(F.try_element_at("cuts", F.col("part") + 2), F.length("text"))
    return parts.select("row", "part", F.substring(F.col("text"), F.col("start") + 1, end - F.col("start")).alias("piece")).repartition("row", "part")


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, counts: bool = False, keep: dict[str, Column] | None = None
) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row, or (id, n_tokens BIGINT) with `counts`; `keep` adds columns that go along with the row.

    Equal long texts are encoded once; what they belong to is joined again, so repeated ids keep their own columns.
    """
    if chunk <= 2 * OVERLAP:
        raise ValueError("a chunk must be longer than two overlaps")
    keep = keep or {}
    what, out = ("n_tokens bigint", "n_tokens") if counts else ("ids array<int>", "ids")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), *[c.alias(k) for k, c in keep.items()], F.col(text_col).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_encode(path, counts), f"{kept}, {what}")
    long = rows.where(is_long).withColumn("row", F.xxhash64("text"))
    texts = long.groupBy("row").agg(F.first("text").alias("text"))
    coded = _pieces(texts, chunk).mapInArrow(_encode(path, counts), f"row bigint, part int, {what}")
    if counts:
        joined = coded.groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        joined = coded.groupBy("row").agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "ids")))["ids"]).alias("ids"))
    whole = long.drop("text").join(joined, "row")
    return short.unionByName(whole.select("id", *keep, out))
