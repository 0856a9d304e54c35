"""Lines that one site repeats over its documents.

A line is known by its letters alone: figures, dates, letter case, blanks and bullets do not count. For every site and
line the number of documents that hold it inside the site is compared with the number outside by the log-likelihood
ratio; the Benjamini-Hochberg procedure over all (site, line) pairs, those of a single document too, bounds the share of false
discoveries. Documents fetched again count once in that test. Significant lines in excess within the site that cover enough of
its documents are the site's lines; they are anti-joined and the rest of each document is put together again by position.

Scale: the text is read once. What is stored and shuffled is a 64-bit number per line, never the line. Counts are
pre-aggregated before their shuffle. A site has at most 10 times its mean lines per document of such lines (each covers
a tenth of the documents), so the per-site arrays are bounded; the table of sites is broadcast only if counted small,
otherwise rows of heavy sites are spread over salted tasks.

Defined cases: null or empty text has no lines but its record counts for its site; a null site is taken from the host of
the url; lines without letters are never cases; repeated records count
each; in a collection of one site, which has no outside, the share alone decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.scale import hot_keys, is_small, salted_join, sized
from corpusloom.sources.tables import stored

#: Share of false discoveries allowed among the significant (site, line) pairs.
FDR = 0.01
LINE_ENTRIES = "array<struct<line_no: int, line: string, key: bigint>>"


def host_site(url: Column) -> Column:
    """Host without scheme, user, port, `www.` or `m.` and without its last label."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"^(?:www|m)\.", ""), r"\.[a-z0-9-]+$", ""), F.lit(""))


def line_keys(text: Column) -> Column:
    """A 64-bit number for the letters of each line; 0 for a line without letters."""
    letters = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\n]+", ""), "\n", -1)
    return F.transform(letters, lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(x)))


def line_table(docs: DataFrame, id_col: str, site: Column, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, site, keys, sig): the lines of each record as numbers, stored; with the columns of `keep`, so that a later pass over
    texts need not make the numbers again.

    `sig`, the four least numbers, is the same for a record fetched again and hardly ever for two others.
    """
    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(site, F.lit("")).alias("site"), line_keys(F.col(text_col)).alias("keys"), *keep)
    least = F.slice(F.array_sort(F.array_distinct(F.filter("keys", lambda k: k != 0))), 1, 4)
    sig = F.when(F.size(least) > 0, F.xxhash64(least)).otherwise(F.xxhash64("id"))
    return stored(keyed.withColumn("sig", sig), "line-keys")


def _g2(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Log-likelihood ratio of a of n against b of m."""
    rate = (a + b) / (n + m)

    def part(k: Column, size: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (size * rate))).otherwise(0.0) + F.when(k < size, (size - k) * F.log((size - k) / (size * (1 - rate)))).otherwise(0.0)

    return 2 * (part(a, n) + F.when(m > 0, part(b, m)).otherwise(0.0))


def _threshold(z: DataFrame, tests: int, fdr: float) -> float:
    """Smallest root of the ratio that Benjamini-Hochberg accepts; from at most 5,000 bins, as p falls with the ratio."""
    bins = np.zeros(5001)
    for r in z.groupBy(F.least(F.floor(F.col("z") * 50), F.lit(5000)).alias("b")).count().collect():
        bins[int(r["b"])] += r["count"]
    rank, least = 0.0, math.inf
    for b in range(5000, 0, -1):
        rank += bins[b]
        if bins[b] and math.erfc(b / 50 / math.sqrt(2)) <= fdr * rank / max(tests, 1):
            least = b / 50
    return least


def site_sizes(lines: DataFrame) -> DataFrame:
    """(site, n_site, d_site), stored: records of each site, and how many of them are no repeats."""
    return stored(lines.groupBy("site").agg(F.count(F.lit(1)).alias("n_site"), F.count_distinct("sig").alias("d_site")), "site-sizes")


def line_counts(lines: DataFrame) -> DataFrame:
    """(site, key, n_in, d_in), stored: documents of a site with a line, and how many of them are no repeats.

    Which records are repeats is settled on (id, site, sig) alone, so the arrays of keys stay where they are unless there are
    too many repeats to send.
    """
    slim = lines.select("id", "site", "sig")
    first = slim.groupBy("site", "sig").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    again = slim.join(first, ["site", "sig"]).where(F.col("id") != F.col("first")).select("id").distinct().withColumn("again", F.lit(1))
    again = stored(again, "again")
    counted = (
        lines.join(sized(again, 200_000), "id", "left")
        .select("site", F.when(F.col("again").isNull(), 1).otherwise(0).alias("new"), F.explode(F.array_distinct("keys")).alias("key"))
        .where(F.col("key") != 0)
        .groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("n_in"), F.sum("new").alias("d_in"))
    )
    return stored(counted, "line-counts")


def line_totals(counted: DataFrame) -> DataFrame:
    """(key, d_all), stored: documents of the whole collection with a line, repeats once."""
    return stored(counted.groupBy("key").agg(F.sum("d_in").alias("d_all")), "line-totals")


def _root(total: int) -> Column:
    """Root of the ratio of a pair (d_in, d_site, d_all); 0 where the site has no more of the line than the others."""
    a, n = F.col("d_in"), F.col("d_site")
    b, m = F.col("d_all") - a, F.lit(total) - n
    return F.when(m <= 0, F.lit(1e6)).when(a * m <= b * n, F.lit(0.0)).otherwise(F.sqrt(F.greatest(_g2(a, n, b, m), F.lit(0.0))))


def _beside_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (site, key) with the sizes of their site; sites are sent if they are few, else those of many pairs are spread."""
    return pairs.join(F.broadcast(sizes), "site") if is_small(sizes) else salted_join(pairs, sizes, "site", "key", hot_keys(pairs, "site"), "inner")


def site_lines(
    lines: DataFrame,
    share: float = 0.1,
    least: int = 4,
    fdr: float = FDR,
    counted: DataFrame | None = None,
    sizes: DataFrame | None = None,
    totals: DataFrame | None = None,
    tested: bool = True,
) -> DataFrame:
    """(site, key, n_in, n_site, n_out, z): the lines a site repeats over `share` of its documents and at least `least`.

    Every (site, line) pair of the collection is tested and ranked, lines seen once too; only then the significant ones are held
    against `share` and `least`. Without `tested` these two decide alone.
    """
    sizes = site_sizes(lines) if sizes is None else sizes
    counted = line_counts(lines) if counted is None else counted
    totals = line_totals(counted) if totals is None else totals
    total = sizes.agg(F.sum("d_site")).first()[0] or 0
    least_root = 0.0
    if tested:
        pairs = counted.select("site", "key", "d_in").join(totals, "key")
        least_root = _threshold(_beside_sizes(pairs, sizes).select(_root(total).alias("z")), counted.count(), fdr)
    much = _beside_sizes(counted.where((F.col("n_in") >= least) & (F.col("d_in") >= least)), sizes).where(F.col("n_in") >= F.col("n_site") * share)
    rows = stored(much, "line-cases")
    rows = rows.join(totals.join(sized(rows.select("key").distinct()), "key", "left_semi"), "key")
    rows = rows.select("site", "key", "n_in", "n_site", (F.col("d_all") - F.col("d_in")).alias("n_out"), _root(total).alias("z"))
    return stored(rows.where(F.col("z") >= least_root), "site-lines")


def per_site(lines: DataFrame, found: DataFrame) -> DataFrame:
    """`lines` with `own`, the array of its site's lines."""
    sets = found.groupBy("site").agg(F.collect_set("key").alias("own"))
    if is_small(sets):
        return lines.join(F.broadcast(sets), "site", "left")
    return salted_join(lines, sets, "site", "id", hot_keys(lines, "site"))


def repeated_lines(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(id, line_no) of every occurrence of a site's line in the site's documents: a semi-join of all lines with the found ones."""
    pairs = found.select("site", "key")
    if is_small(pairs):
        each = lines.select("id", "site", F.posexplode("keys").alias("line_no", "key"))
        return each.join(F.broadcast(pairs), ["site", "key"], "left_semi").select("id", F.col("line_no").cast("bigint").alias("line_no"))
    # too many to send: each site's lines travel with its documents, whatever part of the rows is one site's
    each = per_site(lines, found).where(F.col("own").isNotNull()).select("id", "own", F.posexplode("keys").alias("line_no", "key"))
    return each.where(F.array_contains("own", F.col("key"))).select("id", F.col("line_no").cast("bigint").alias("line_no"))


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept lines of each row, which stand together, put together by position."""
    schema = pa.schema([("id", pa.int64()), ("n_removed", pa.int64()), ("clean", pa.string())])
    now, head, kept = None, (None, 0), []

    def whole() -> tuple:
        ident, n = head
        return ident, max(n - len(kept), 0), "\n".join(x for _, x in sorted(kept)) if n else None

    for batch in batches:
        out = []
        for row, ident, n, no, line in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "n", "line_no", "line")), strict=True):
            if row != now:
                if now is not None:
                    out.append(whole())
                now, head, kept = row, (ident, n), []
            if no >= 0:
                kept.append((no, line))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(whole(), schema, strict=True)], schema=schema)


def without_site_lines(docs: DataFrame, id_col: str, site: Column, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, n_removed, clean): each text without its site's lines, the others in their order; null stays null.

    Lines are anti-joined with the found ones, sent to all tasks, and put together again in the task that read them, so the text
    is never shuffled. Every row adds an entry without a key, which no join takes, so rows whose lines all go are kept. Where
    the found lines are too many to send, each site's set is joined to its documents and the lines are taken out inside the row.
    """
    text, pairs = F.col(text_col), found.select("site", "key")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(site, F.lit("")).alias("site"), text.alias("__text"), line_keys(text).alias("keys"))
    parts = F.arrays_zip(F.split("__text", "\n", -1).alias("line"), F.col("keys").alias("key"))
    if is_small(pairs):
        entry = F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("bigint").alias("key")))
        numbered = F.transform(parts, lambda x, i: F.struct(i.alias("line_no"), x["line"].alias("line"), x["key"].alias("key")))
        # the number is given before the rows are taken apart
        each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "site", F.coalesce(F.size("keys"), F.lit(0)).alias("n"), F.explode(F.concat(entry, F.coalesce(numbered, F.array().cast(LINE_ENTRIES)))).alias("e"))
        each = each.select("row", "id", "site", F.greatest("n", F.lit(0)).alias("n"), "e.*")
        kept = each.join(F.broadcast(pairs), ["site", "key"], "left_anti").select("row", "id", "n", "line_no", "line")
        return kept.mapInArrow(_reassemble, "id bigint, n_removed bigint, clean string")
    own = F.coalesce(F.col("own"), F.array().cast("array<bigint>"))
    kept = F.filter(parts, lambda x: ~F.array_contains(own, x["key"]))
    return per_site(rows, found).select(
        "id", F.coalesce(F.size("keys") - F.size(kept), F.lit(0)).cast("bigint").alias("n_removed"), F.when(F.col("__text").isNotNull(), F.array_join(kept["line"], "\n")).alias("clean")
    )
