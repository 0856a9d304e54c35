"""Queries of problem 10: missing or wrong language labels, and the languages of mixed documents."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.body import Corpus, Judged, corpus, each_slice, stuffed
from corpusloom.llm.language import LANGUAGES, LINE_CHARS, LINES, RECORD_LINES, SAMPLE, Machines, fit
from corpusloom.llm.queries_text import doc_site
from corpusloom.operators.scale import sized
from corpusloom.sources.tables import table

#: A document of fewer characters in own lines has no language; a stretch is an own line of at least so many.
LEAST_TEXT = 60
LEAST_LINE = 30
#: Confidence from which a single own line in another language makes a document of up to CHANCE_LINES lines a mixed one; of more
#: lines it must be so much surer, or FAIR_PART of the lines must be in that language.
SURE = 0.8
CHANCE_LINES = 20
FAIR_PART = 0.05


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, url, source, title, text, label): the label's language where its spelling is known."""
    aliases = table(spark, d, "lang_aliases").select(F.col("alias").alias("lang"), F.col("lang").alias("label"))
    return table(spark, d, "documents").select("doc_id", "url", "source", "title", "text", "lang").join(sized(aliases), "lang", "left")


def train(c: Corpus, sample: int = SAMPLE) -> Machines:
    """Fit the machines on own lines of at most about `sample` labelled documents, drawn by a hash of the id."""
    records = c.records
    known = records.where(F.col("label").isin(*LANGUAGES[:5]) & F.col("text").isNotNull())
    # every language gets its part of the sample, however rare it is
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    each = sample // 5
    spread = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1_000_000))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("label") == lang, F.lit(min(1_000_000, each * 1_000_000 // max(n, 1)))).otherwise(share)
    lines = each_slice(
        c,
        lambda js, labels: [(label, x) for j, label in zip(*labelled_ones(js, labels), strict=True) for x in drawn(j)],
        "label string, line string",
        [F.col("label")],
        records.where(F.col("label").isin(*LANGUAGES[:5]) & (spread < share)),
    )
    # a fixed order that has nothing to do with the documents' order decides which lines are taken
    ranked = lines.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("line"), "line"))).where(F.col("r") <= 2 * LINES)
    return fit([(r["label"], r["line"]) for r in ranked.orderBy("label", "r").select("label", "line").collect()])


def drawn(j: Judged) -> list[str]:
    """The own lines of a record for the sample: at most RECORD_LINES, in an order of their content, each cut to LINE_CHARS."""
    own = sorted((j.lines[i][:LINE_CHARS] for i in j.own() if len(j.lines[i]) >= 15), key=lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")))
    return own[:RECORD_LINES]


def labelled_ones(js: list[Judged], labels: list[str]) -> tuple[list[Judged], list[str]]:
    """The records that are not stuffed, and their labels."""
    kept = [(j, x) for j, x, bad in zip(js, labels, stuffed(js), strict=True) if not bad]
    return [j for j, _ in kept], [x for _, x in kept]


def others(said: list[tuple[int, str | None, float]], main: str) -> set[str]:
    """Languages beside `main` that lines (length, language, confidence) bring into a document.

    A short line is not enough, and the more lines there are the surer one must be, as some are mistaken by chance; or a
    language has a fair part of them.
    """
    n = sum(lang is not None for _, lang, _ in said)
    sure = 1 - (1 - SURE) * min(1.0, CHANCE_LINES / max(n, 1))
    votes: dict[str, int] = {}
    out = set()
    for size, lang, c in said:
        if lang is None or lang == main:
            continue
        if c >= SURE and size >= (LEAST_TEXT if lang != "zh" else LEAST_LINE) or c >= 0.95 and size >= 45:
            votes[lang] = votes.get(lang, 0) + 1
            if c >= sure:
                out.add(lang)
    return out | {lang for lang, k in votes.items() if k >= FAIR_PART * n}


def judge_languages(js: list[Judged], labels: list[str | None], m: Machines, cases: bool = False) -> list[tuple]:
    """(id, line_no, language, confidence, label) of records with enough own text: line_no -1 is the main language, and own lines
    from LEAST_LINE on follow if the record is a mixed one. The lines of all records are classified together. With `cases` only
    records with a missing or wrong label and mixed ones remain. Whether a record is stuffed is asked at the end, of those left."""
    texts, spans = [], []
    for j in js:
        own = [(i, j.lines[i].strip()) for i in j.own()]
        own = own if sum(len(x) for _, x in own) >= LEAST_TEXT else []
        spans.append(own)
        texts += [x for _, x in own]
    langs, conf = m.classify(texts)
    found: list[tuple[Judged, list[tuple]]] = []
    at = 0
    for j, label, own in zip(js, labels, spans, strict=True):
        part, sures = langs[at : at + len(own)], conf[at : at + len(own)].tolist()
        at += len(own)
        weight: dict[str, float] = {}
        sure: dict[str, float] = {}
        for (_, x), lang, c in zip(own, part, sures, strict=True):
            if lang:
                weight[lang] = weight.get(lang, 0.0) + len(x)
                sure[lang] = sure.get(lang, 0.0) + len(x) * c
        if not weight:
            continue
        main = min(weight, key=lambda x: (-weight[x], x))
        rows = []
        if len(weight) > 1:
            known = others([(len(x), lang, c) for (_, x), lang, c in zip(own, part, sures, strict=True)], main) | {main}
            if len(known) > 1:
                rows = [(j.id, i, lang if lang in known and (c >= 0.7 or len(x) >= LEAST_TEXT) else main, c, label) for (i, x), lang, c in zip(own, part, sures, strict=True) if lang and len(x) >= LEAST_LINE]
                rows = rows if any(r[2] != main for r in rows) else []
        if rows or not cases or label != main:
            found.append((j, [(j.id, -1, main, sure[main] / sum(weight.values()), label), *rows]))
    clean = stuffed([j for j, _ in found])
    return [r for (_, rows), bad in zip(found, clean, strict=True) if not bad for r in rows]


def languages(spark: SparkSession, d: str, cases: bool = False) -> DataFrame:
    """(id, line_no, lang, confidence, label): line_no -1 is the document; one row for each own line of mixed ones."""
    docs = labelled(spark, d)
    c = corpus(docs, "doc_id", doc_site(), more=("label",))
    m = spark.sparkContext.broadcast(train(c))
    return each_slice(
        c,
        lambda js, labels: judge_languages(js, labels, m.value, cases),
        "id bigint, line_no bigint, lang string, confidence double, label string",
        [F.col("label")],
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a missing or wrong label, and the own lines of mixed documents."""
    rows = languages(spark, d, True)
    wrong = (F.col("line_no") == -1) & ~F.col("label").eqNullSafe(F.col("lang"))
    return rows.where(wrong | (F.col("line_no") >= 0)).select(F.col("id").alias("doc_id"), "line_no", "lang")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's main language and every stretch of the mixed ones, with confidence."""
    return languages(spark, d).select(F.col("id").alias("doc_id"), "line_no", "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p10_found": p10_found, "p10_languages": p10_languages}
SQL: dict[str, str] = {}
