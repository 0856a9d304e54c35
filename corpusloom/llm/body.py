"""Main bodies and stuffed records of whole tables: what the collection knows, and one pass over the records.

What the collection knows is bounded. Frequent lines stand in more than `LINE_SHARE` of the records, so there are at most
(lines per record / LINE_SHARE) of them; title openings stand in more than `TITLE_SHARE` of the titles, so at most 1 / TITLE_SHARE
of each kind. Both are sent to all tasks. A site's own lines are a bounded array per site and travel with the record, see `lines`.

Garbled lines are judged by their restored wording. Texts are never shuffled; they are stored once, with the numbers of their
lines, and read again for the pass.

Where a table has `links`, a record with little or no own text is judged by them, see `link_list`.

Defined cases: null, empty or blank texts have no lines outside the body and are stuffed only by their links; a null title or one
that is an address names no headline; null links count as none; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.llm.garble import Model, pair_counts, values_of
from corpusloom.llm.lines import line_counts, line_table, line_totals, per_site, site_lines, site_sizes
from corpusloom.llm.page import LINKS, LITTLE_TEXT, Known, kinds, link_list, stuffing

LINE_SHARE = 0.003
TITLE_SHARE = 0.0005
#: Records and characters that are looked at together.
SLICE = 256
SLICE_CHARS = 1_000_000
#: What stands between the parts of a title.
SEPARATORS = (": ", " – ")


@dataclass
class Corpus:
    """A table of records (id, site, title, text, links) with what was learned about it."""

    records: DataFrame
    found: DataFrame
    known: Broadcast
    model: Broadcast


def corpus(table: DataFrame, id_col: str, site: Column, share: float = 0.1, more: tuple[str, ...] = ()) -> Corpus:
    """Learn the lines, titles and characters of a table; every row counts. Its `links`, if it has any, are carried along, and so
    are the columns `more`.

    The records are stored with the numbers of their lines: making those is dearer than reading the text again.
    """
    links = F.col("links") if "links" in table.columns else F.lit(None).cast("array<string>")
    # fewer links are no list, so they need not travel
    links = F.when(F.size(links) >= LINKS, links).alias("links")
    plain = table.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(site, F.lit("")).alias("site"), "title", "text", links, *more)
    records = line_table(plain, "id", F.col("site"), keep=("title", "text", "links", *more))
    lines = records.select("id", "site", "keys", "sig")
    sizes, counted = site_sizes(lines), line_counts(lines)
    totals = line_totals(counted)
    found = site_lines(lines, share, counted=counted, sizes=sizes, totals=totals)
    n = sizes.agg(F.sum("n_site")).first()[0] or 0
    often = totals.where(F.col("d_all") >= max(5, LINE_SHARE * n))
    parts = F.filter(
        F.array(*[F.struct(F.lit(sep).alias("sep"), F.when(F.col("title").contains(sep), F.substring_index("title", sep, 1)).alias("part")) for sep in SEPARATORS]), lambda x: x["part"].isNotNull()
    )
    opened = records.where(F.col("title").isNotNull()).select(F.length("title").alias("size"), F.explode(parts).alias("p")).groupBy("p.sep", "p.part")
    rows = opened.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).where(F.col("n") >= max(3, TITLE_SHARE * n)).collect()
    openings = [{r["part"]: r["size"] for r in rows if r["sep"] == sep} for sep in SEPARATORS]
    known = Known(frozenset(r["key"] for r in often.select("key").collect()), *openings)
    sc = table.sparkSession.sparkContext
    return Corpus(records, found, sc.broadcast(known), sc.broadcast(Model(pair_counts(values_of(records, "id")))))


def as_written(texts: list[str], model: Model) -> list[list[str]]:
    """The lines of each text as they were written: suspects are found over all texts at once and restored."""
    split = [t.split("\n") for t in texts]
    wide = [i for i, t in enumerate(texts) if not t.isascii()]
    lines = [x for i in wide for x in split[i]]
    starts = np.cumsum([0, *(len(split[i]) for i in wide)])
    for k in np.flatnonzero(model.suspects(lines)):
        at = int(np.searchsorted(starts, k, side="right")) - 1
        split[wide[at]][k - starts[at]] = model.restore(lines[k])[0]
    return split


def restored_titles(titles: list[str | None], model: Model) -> list[str]:
    """Titles as they were written, each a single line."""
    lines = [(t or "").replace("\n", " ") for t in titles]
    for k in np.flatnonzero(model.suspects(lines)):
        lines[k] = model.restore(lines[k])[0]
    return lines


@dataclass
class Judged:
    """One record after the pass; `kind` is 0 for empty lines, 1 for the body, 2 for known lines, 3 for others outside the body."""

    id: int
    title: str | None
    lines: list[str]
    kind: list[int]
    by_links: bool = False

    def own(self) -> list[int]:
        return [i for i, k in enumerate(self.kind) if k == 1]

    def unknown(self) -> list[str]:
        """The lines that tell whether the record is stuffed; lists have no running text, so windows do not find them."""
        return [x for x, k in zip(self.lines, self.kind, strict=True) if k in (1, 3)]


def judge(i: int, title: str | None, written: list[str], keys: list[int], own: set[int], known: Known, site: str = "", links: list[str | None] | None = None) -> Judged:
    kind = kinds(written, keys, own, known, title)
    by_links = links is not None and len(links) >= LINKS and sum(len(x) for x, k in zip(written, kind, strict=True) if k in (1, 3)) < LITTLE_TEXT and link_list(links, site)
    return Judged(i, title, written, kind, by_links)


def stuffed(js: list[Judged]) -> list[bool]:
    """Which of the records are stuffed; their terms are counted together."""
    return [j.by_links or s for j, s in zip(js, stuffing([j.unknown() for j in js]), strict=True)]


def unstuffed(js: list[Judged]) -> list[Judged]:
    return [j for j, s in zip(js, stuffed(js), strict=True) if not s]


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of at most SLICE rows and, beyond the first row, SLICE_CHARS characters; nothing is cut out."""
    start = chars = 0
    for at, n in enumerate(sizes):
        if at > start and (at - start >= SLICE or chars + n > SLICE_CHARS):
            yield start, at
            start, chars = at, 0
        chars += n
    if start < len(sizes):
        yield start, len(sizes)


def each_slice(c: Corpus, emit: Callable[..., list[tuple]], schema: str, extra: list[Column] | None = None, records: DataFrame | None = None, bare: bool = False) -> DataFrame:
    """Rows that `emit` makes of lists of judged records; the values of extra columns follow as lists. `records` are some of the
    corpus' own. `bare` adds the records without text that have links enough for a list."""
    known, model = c.known, c.model
    source = c.records if records is None else records
    wanted, text = F.col("text").isNotNull(), F.col("text")
    if bare:
        wanted, text = wanted | F.col("links").isNotNull(), F.coalesce("text", F.lit(""))
    keys = F.coalesce("keys", F.array(F.lit(0).cast("bigint")))
    rows = source.where(wanted).select("id", "site", "title", text.alias("text"), keys.alias("keys"), "links", *(extra or []))
    rows = per_site(rows, c.found)
    more = [x for x in rows.columns if x not in ("id", "site", "title", "text", "keys", "links", "own")]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, set[int]] = {}
        for batch in batches:
            for start, stop in slices(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
                part = {n: batch.column(n).slice(start, stop - start).to_pylist() for n in ("id", "site", "title", "text", "keys", "links", *more)}
                sites = batch.column("own").slice(start, stop - start)
                for k, site in enumerate(part["site"]):
                    if site not in own:
                        own[site] = set(sites[k].as_py() or ())
                written = as_written(part["text"], model.value)
                titles = restored_titles(part["title"], model.value)
                judged = [judge(i, titles[k], written[k], part["keys"][k], own[part["site"][k]], known.value, part["site"][k], part["links"][k]) for k, i in enumerate(part["id"])]
                out = emit(judged, *(part[m] for m in more))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def furniture(c: Corpus) -> DataFrame:
    """(id, line_no) of every line outside the main body; stuffed records are left out."""
    return each_slice(c, lambda js: [(j.id, i) for j in unstuffed([j for j in js if 2 in j.kind or 3 in j.kind]) for i, k in enumerate(j.kind) if k > 1], "id bigint, line_no bigint")


def stuffed_records(c: Corpus) -> DataFrame:
    """(id) of records that are mostly keywords, link lists, tags or products."""
    return each_slice(c, lambda js: [(j.id,) for j, s in zip(js, stuffed(js), strict=True) if s], "id bigint", bare=True)


def main_body(c: Corpus) -> DataFrame:
    """(id, body): the text reduced to the main body, restored where it was garbled; null for null."""
    bodies = each_slice(c, lambda js: [(j.id, "\n".join(j.lines[i] for i in j.own())) for j in js], "id bigint, body string")
    missing = c.records.where(F.col("text").isNull()).select("id", F.lit(None).cast("string").alias("body"))
    return bodies.unionByName(missing)
