"""What a front end derives from the results: seeds of a form, hints, sizes and points of a curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seed_lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def valid_seeds(text: Column) -> Column:
    """Whether every seed is an http(s) address; no seed at all is fine."""
    return F.forall(seed_lines(text), lambda x: x.rlike("(?i)^https?://"))


def search_hint(title: Column) -> Column:
    """The first piece of a title, up to a blank or a middle dot."""
    return F.element_at(F.split(F.coalesce(title, F.lit("")), r"[\s·]"), 1)


def node_radius(degree: Column) -> Column:
    """3 and 0.6 for each of the first eight links; no link counts as one."""
    return 3 + F.least(F.when(degree > 0, degree).otherwise(1), F.lit(8)) * 0.6


def curve(samples: DataFrame, last: int, height: float, span: float) -> DataFrame:
    """(t, x, y) of the last `last` samples (t, rps): x from 0 to 100, y falls from `height` by `span` at the highest rate.

    The windows run over the `last` samples only.
    """
    kept = samples.orderBy(F.desc("t")).limit(last)
    every = Window.orderBy("t")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(every) - 1, F.count(F.lit(1)).over(whole)
    top = F.greatest(F.max(F.coalesce("rps", F.lit(0.0))).over(whole), F.lit(1.0))
    return kept.select("t", (i / F.greatest(n - 1, F.lit(1)) * 100).alias("x"), (F.lit(float(height)) - F.coalesce("rps", F.lit(0.0)) / top * span).alias("y"))


def valid_form(seeds: Column, workers: Column, depth: Column, pages: Column) -> Column:
    """Whether a form may be sent: readable seeds, 1 to 64 workers, 1 to 20 levels, 1 to 5000 pages."""
    return valid_seeds(seeds) & F.coalesce(workers.between(1, 64) & depth.between(1, 20) & pages.between(1, 5000), F.lit(False))


def metric_cards(stats: DataFrame) -> DataFrame:
    """(card, value) of six of the figures as text, the rate rounded; missing ones are 0."""
    text = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).cast("string")
    rate = F.round(F.coalesce("current_rps", F.lit(0.0)), 0).cast("bigint").cast("string")
    cards = {"PAGES": text("pages_crawled"), "QUEUE": text("queue_length"), "DOCS": text("index_docs"), "TERMS": text("index_terms"), "RPS": rate, "WORK": F.concat_ws("/", text("active"), text("configured"))}
    return stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("card"), v.alias("value")) for k, v in cards.items()])).alias("c")).select("c.*")
