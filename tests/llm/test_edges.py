"""Every query of the subpackage on tables of nothing, and on tables of nulls, repeats, ties, long texts and clashing columns."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.queries import QUERIES

AT = dt.datetime(2024, 5, 1, 12, 0, 0)
DOCS = "doc_id long, url string, title string, text string, lang string, source string, n_chars long, fetched_at timestamp_ntz"
PAGES = "page_id long, base_url string, title string, text string, links array<string>, fetched_at timestamp_ntz"
POSTS = "term string, doc_id long, freq long, positions array<int>, indexed_at timestamp_ntz"
KEYS = "shard int, term string, freq long"
HITS = "hit_id long, q string, doc_id long, url string, title string, score double, snippet string, highlight boolean, served_at timestamp_ntz"
MIX = "source string, target_share double, max_repeats int"
ALIAS = "alias string, lang string"
#: Names that the operators use for columns of their own.
CLASH = ("id", "site", "keys", "sig", "own", "label", "value", "field", "line", "skel", "row", "n_tokens", "__n", "__salt", "times")
SAID = "The queue stores short pages because the reader checks old entries before the next round, and nobody noticed."


def write(spark, folder, rows):
    for name, (schema, data) in rows.items():
        df = spark.createDataFrame(data, schema)
        for c in CLASH:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {"documents": (DOCS, []), "crawl_pages": (PAGES, []), "postings": (POSTS, []), "keywords": (KEYS, []), "hits": (HITS, []), "mix_targets": (MIX, []), "lang_aliases": (ALIAS, [])})


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    long = "\n".join(f"{SAID} {k}" for k in range(12_000))  # over a megabyte
    docs = [(1, "http://www.a.test/1", "T", SAID, "en", "a", 9, AT), (2, None, None, None, None, None, None, None), (3, "http://a.test/3", "", "", "", "", 0, AT), (4, "x", " ", " \n ", "??", " ", 3, AT)]
    docs += [(5, "http://b.test/5", "http://b.test/5", long, "xx", "b", len(long), AT), (6, "http://b.test/6", "Ti\ntle", "x" * 300_000, "en", "b", 300_000, AT), (7, "http://b.test/7", "�", "�\x81 caf�", None, "b", 5, AT)]
    docs += docs[:2] + [(8, "http://b.test/8", "👩‍💻 é", "👩‍💻 " * 500 + "\n" + "é" * 40, "en", "b", 1, AT), (9, "http://c.test/9", "n", "casino bonus, " * 500, "de", "c", 1, AT)]
    docs.append((10, "http://d.test/10", None, f"{SAID}\nEach reader of the queue waits while the small hosts are checked for their entries.", None, None, None, None))
    pages = [(1, "http://a.test/", "T", SAID, ["http://a.test/1", None, ""], AT), (2, None, None, None, None, None), (3, "x", "", "", [], AT), (3, "x", "", "", [], AT), (4, "http://d.test/", None, long, [f"http://e{k}.test/" for k in range(5000)], AT)]
    posts = [("a", 1, 5, [0], AT), ("a", 1, 5, [0], AT), ("a", 1, 7, None, AT), ("a", 2, 6, [], None), (None, 1, 1, None, AT), ("b", None, 1, None, AT), ("b", 3, None, None, AT), ("c", 3, -2, None, AT), ("x" * 70_000, 3, 9, [1], AT)]
    keys = [(1, " A ", 3), (1, None, 3), (None, "a", None), (2, "a", 4)]
    hits = [(1, "a b  a", 1, None, None, None, None, None, None), (1, "a b  a", 1, None, None, 2.0, None, None, None), (2, None, None, None, None, None, None, None, None), (None, "a", 2, None, None, 1.0, None, None, None)]
    mix = [("a", 0.5, 2), ("b", 0.25, None), ("c", 0.25, 1), ("gone", 0.1, 0), (None, 0.1, 1), ("z", None, 1)]
    rows = {"documents": (DOCS, docs), "crawl_pages": (PAGES, pages), "postings": (POSTS, posts), "keywords": (KEYS, keys), "hits": (HITS, hits), "mix_targets": (MIX, mix), "lang_aliases": (ALIAS, [("en", "en"), ("de", "de")])}
    return write(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


#: What is defined of the rows of each query.
CHECKS = {
    "p1_found": lambda r: r == [],
    "p1_clean": lambda r: len(r) == 12 and [x["clean"] for x in r if x["doc_id"] == 2] == [None, None] and {x["clean"] for x in r if x["doc_id"] == 3} == {""},
    "p2_found": lambda r: {(7, "text")} <= {tuple(x) for x in r} and all(x["doc_id"] == 7 for x in r),
    "p3_weights": lambda r: {(x["term"][:1], x["doc_id"], x["freq"]) for x in r} == {("a", 1, 7), ("a", 2, 6), ("b", 3, 0), ("c", 3, -2), ("x", 3, 9)},
    "p3_found": lambda r: [tuple(x) for x in sorted(r)] == [(1, "a"), (2, "a")],
    "p4_counts": lambda r: {x["term"][:1]: (x["freq"], x["n_docs"]) for x in r} == {"a": (13, 2), "b": (0, 1), "c": (-2, 1), "x": (9, 1)},
    "p6_found": lambda r: {("documents", 9)} <= {tuple(x) for x in r} and not {("documents", 1), ("documents", 2), ("crawl_pages", 2)} & {tuple(x) for x in r},
    "p7_found": lambda r: all(x["rec_id"] not in (2, 3, 9) for x in r),
    "p7_bodies": lambda r: len(r) == 17 and all(x["body"] is None for x in r if x["rec_id"] == 2),
    "p8_ids": lambda r: len(r) == 12 and all(x["ids"] == [] for x in r if x["doc_id"] in (2, 3)) and max(len(x["ids"]) for x in r) > 200_000,
    "p9_mix": lambda r: len(r) > 0 and all(1 <= x["times"] <= 2 for x in r) and {x["source"] for x in r} <= {"a", "b", "c"},
    "p10_found": lambda r: all(x["doc_id"] not in (2, 3, 4, 9) for x in r) and (10, -1, "en") in {tuple(x) for x in r},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    assert CHECKS.get(name, lambda _: True)(rows), rows[:20]
