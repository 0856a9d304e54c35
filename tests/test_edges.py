"""Every query of the core on empty tables and on rows of nothing but nulls."""

from __future__ import annotations

import pytest

from corpusloom.plans import fetch, heavy, reference, streams

SCHEMAS = {
    "documents": "doc_id long, url string, title string, text string, lang string, source string, n_chars long, fetched_at timestamp_ntz",
    "crawl_pages": "page_id long, base_url string, title string, text string, links array<string>, fetched_at timestamp_ntz",
    "postings": "term string, doc_id long, freq long, positions array<int>, indexed_at timestamp_ntz",
    "keywords": "shard int, term string, freq long",
    "edges": "src string, dst string, seen_at timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
QUERIES = {**reference.QUERIES, **heavy.QUERIES, **fetch.QUERIES, **streams.QUERIES}
#: Queries that sum up give a row of nothing; the site is generated.
ROWS = {"index_stats": 1, "bloom_filter": 1, "service_cards": 5, "site_crawl": 5}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == ROWS.get(name, 0)


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nulls")
    for name, schema in SCHEMAS.items():
        n = schema.count(",") + 1
        spark.createDataFrame([(None,) * n, (None,) * n], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls(spark, nulls, name):
    """No query fails, and none makes rows of what is not there but for one of each row."""
    assert QUERIES[name](spark, nulls).count() <= max(2, ROWS.get(name, 0))


def test_every_query_has_its_sql():
    assert all(name in mod.SQL for mod in (reference, heavy, fetch, streams) for name in mod.QUERIES)
