"""The inverted index: postings, statistics, ranked search for all terms, keywords, re-adding and removal.

Documents are (doc_id, url, title, body). A document's token sequence is its title three times, then its body. Null titles and
bodies have no tokens; a document without tokens still counts as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import escape_html, exact_snippet, highlight, tokens_of
from corpusloom.operators.scale import sized, spread
from corpusloom.sources.tables import stored

POSITIONS = 32


#: Tokens that are counted together.
SLICE_TOKENS = 500_000
_POSTINGS = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("freq", pa.int64()), ("positions", pa.list_(pa.int32()))])


def _counted(ids: list[int], tokens: list[list[str]]) -> pa.RecordBatch:
    """Postings of some documents: one stable sort by (document, term) brings every term's places together, in their order."""
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    known: dict[str, int] = {}
    code = np.fromiter((known.setdefault(t, len(known)) for t in chain.from_iterable(tokens)), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(tokens)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = doc * np.int64(len(known)) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    freq = np.diff(np.append(starts, len(key)))
    first = np.arange(len(key)) - np.repeat(starts, freq) < POSITIONS
    kept = np.concatenate([[0], np.cumsum(np.minimum(freq, POSITIONS))]).astype(np.int32)
    at = order[starts]
    terms = pa.array(list(known), pa.string()).take(pa.array(code[at]))
    places = pa.ListArray.from_arrays(pa.array(kept), pa.array(place[order][first].astype(np.int32)))
    return pa.RecordBatch.from_arrays([terms, pa.array(np.array(ids, dtype=np.int64)[doc[at]]), pa.array(freq), places], schema=_POSTINGS)


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tokens, n = [], [], 0
        for i, title, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            ids.append(i)
            tokens.append(tokens_of(title or "") * 3 + tokens_of(body or ""))
            n += len(tokens[-1])
            if n >= SLICE_TOKENS:
                yield _counted(ids, tokens)
                ids, tokens, n = [], [], 0
        if n:
            yield _counted(ids, tokens)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, freq, positions): occurrences, and the first 32 places in the token sequence.

    A document's tokens are counted in the task that reads it, in Arrow batches, so nothing is shuffled. Rows that share a doc_id
    are one document: only if there are any, their counts are added and their places merged. A null doc_id is not indexed.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "title", "body")
    found = spread(rows).mapInArrow(_tokenized, "term string, doc_id bigint, freq bigint, positions array<int>")
    n = rows.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n[0] == n[1]:
        return found
    return found.groupBy("term", "doc_id").agg(F.sum("freq").alias("freq"), F.slice(F.sort_array(F.flatten(F.collect_list("positions"))), 1, POSITIONS).alias("positions"))


def stored_index(docs: DataFrame) -> DataFrame:
    """Postings stored by term: a search for a few terms reads few row groups."""
    return stored(postings(docs).repartition("term").sortWithinPartitions("term"), "index")


def term_freq(index: DataFrame) -> DataFrame:
    """(term, freq) over all documents."""
    return index.groupBy("term").agg(F.sum("freq").alias("freq"))


def index_stats(docs: DataFrame, index: DataFrame) -> DataFrame:
    """One row (docs, terms)."""
    return index.agg(F.count_distinct("term").alias("terms")).select(F.lit(docs.count()).alias("docs"), "terms")


def top_keywords(freqs: DataFrame, limit: int = 30) -> DataFrame:
    """The most frequent terms, ties by term; 30 for no limit."""
    return freqs.where(F.col("freq") > 0).orderBy(F.desc("freq"), "term").limit(limit if limit > 0 else 30)


def clamp_hits(limit: int) -> int:
    """20 hits for no limit and for one above 50."""
    return limit if 0 < limit <= 50 else 20


def scores(index: DataFrame, query: str) -> DataFrame:
    """(doc_id, score) of the documents that hold every distinct term of the query; the score sums their occurrences.

    The terms are literals in a filter, which reaches a scan of stored postings; no join is needed.
    """
    terms = list(dict.fromkeys(tokens_of(query)))
    hit = index.where(F.col("term").isin(terms) if terms else F.lit(False))
    found = hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("freq").alias("score"))
    return found.where(F.col("n") == len(terms)).select("doc_id", F.col("score").cast("double").alias("score"))


def search(docs: DataFrame, index: DataFrame, query: str, limit: int = 20, mark: bool = True) -> DataFrame:
    """(doc_id, url, title, score, snippet, highlight): best score first, ties by address.

    Only addresses take part in the ranking. Its at most 50 hits are brought to the driver, so that their ids are a filter of the
    scan that reads titles and bodies; snippets are cut by the exact byte rule and marked there.
    """
    ranked = scores(index, query).join(docs.select("doc_id", "url"), "doc_id").orderBy(F.desc("score"), "url", "doc_id").limit(clamp_hits(limit)).collect()
    best = docs.sparkSession.createDataFrame([tuple(r) for r in ranked], "doc_id bigint, score double, url string")
    ids = [r["doc_id"] for r in ranked]
    hits = docs.where(F.col("doc_id").isin(ids) if ids else F.lit(False)).select("doc_id", "title", "body").join(F.broadcast(best), "doc_id")
    title, cut = F.coalesce(F.col("title"), F.lit("")), exact_snippet(F.col("body"), query)
    dress = (lambda x: highlight(x, query)) if mark else escape_html
    return hits.select("doc_id", "url", (highlight(title, query) if mark else title).alias("title"), "score", dress(cut).alias("snippet"), F.lit(mark).alias("highlight")).orderBy(F.desc("score"), "url", "doc_id").limit(clamp_hits(limit))


def latest(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of every key; a null key is a key of its own, and a null order comes before all others. Only the winners'
    order is shuffled twice, never the bodies.

    Repeated addresses are few each, so a max over a struct needs no window.
    """
    newest = docs.groupBy(key).agg(F.max(F.struct(order, "doc_id")).alias("__v")).select(F.col(key).alias("__k"), F.col(f"__v.{order}").alias("__o"), F.col("__v.doc_id").alias("__d"))
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col(order).eqNullSafe(F.col("__o")) & F.col("doc_id").eqNullSafe(F.col("__d"))
    return docs.join(newest, same, "left_semi")


def number_by_first_use(docs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, id): ids from 1 in the order of first use. Keys are sorted over all tasks and stored with the number of their task,
    as that is only good for one sort; counts per task give the offsets."""
    first = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first")).orderBy("__first", key)
    local = stored(first.select(key, "__first", F.spark_partition_id().alias("__p")), "sorted")
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__first", key))
    return local.withColumn("__r", rank).join(sized(offsets), "__p").select(key, (F.col("__r") + F.col("__o")).cast("bigint").alias("id"))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The postings without those of the given documents; frequencies follow by summing again."""
    return index.join(ids.select("doc_id"), "doc_id", "left_anti")

