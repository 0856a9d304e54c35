"""Golden values of the engine's operators, on small inputs."""

from __future__ import annotations

import html as stdlib_html

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import http as P
from corpusloom.functions import misc as M
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.functions import view as V
from corpusloom.operators import crawl as C
from corpusloom.operators import frontier as R
from corpusloom.operators import graph as G
from corpusloom.operators import index as I
from corpusloom.operators import rules as L
from corpusloom.operators import schedule as S
from corpusloom.plans.engine import Engine, Strategy, TaskError


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("网页爬虫 Web Crawlers", ["网页", "页爬", "爬虫", "web", "crawler"]),
        ("倒 café 10s a", ["倒", "caf", "10s"]),
        ("flies dies running string passed need class this", ["fly", "die", "runn", "str", "pass", "need", "class", "thi"]),
        ("the wills", []),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokenize, text) == tokens
    assert text is None or T.tokens_of(text) == tokens


DOCS = [
    (1, "http://x/a", "Mini Index", "A concurrent web crawler builds an inverted index for search."),
    (2, "http://x/b", "Other", "unrelated text about bananas"),
    (3, "http://x/c", "倒排索引", "网页爬虫构建内存倒排索引"),
    (4, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, url string, title string, body string")


def test_search(docs):
    index = I.postings(docs)
    hit = I.search(docs, index, "inverted").collect()
    assert [(h["doc_id"], h["score"]) for h in hit] == [(1, 1.0)]
    assert "<mark>inverted</mark>" in hit[0]["snippet"].lower()
    assert [h["doc_id"] for h in I.search(docs, index, "倒排").collect()] == [3]
    assert I.search(docs, index, "of the").collect() == []
    assert I.search(docs, index, "bananas crawler").collect() == []
    assert I.index_stats(docs, index).first()["docs"] == 4


def test_positions_are_capped_and_title_counts_three_times(spark):
    docs = spark.createDataFrame([(1, "u", "word", "word " * 100)], "doc_id long, url string, title string, body string")
    row = I.postings(docs).first()
    assert row["freq"] == 103
    assert row["positions"] == list(range(32))


def test_remove(spark, docs):
    left = I.remove(I.postings(docs), spark.createDataFrame([(1,)], "doc_id long"))
    assert I.scores(left, "inverted").collect() == []


@pytest.mark.parametrize(("limit", "used"), [(0, 20), (-1, 20), (50, 50), (51, 20), (7, 7)])
def test_hit_limits(limit, used):
    assert I.clamp_hits(limit) == used


def test_highlight_escapes_and_marks(spark):
    got = one(spark, lambda c: T.highlight(c, 'crawler "x"'), 'A Crawler <b> & "x"')
    assert got == "A <mark>Crawler</mark> &lt;b&gt; &amp; <mark>&#34;x&#34;</mark>"
    assert one(spark, T.escape_html, "<&'>") == "&lt;&amp;&#39;&gt;"


def test_snippet_rules(spark):
    body = "a" * 100 + " needle " + "b" * 300
    assert T.cut_snippet(body, "needle") == "…" + body[41:221].strip() + "…"
    assert one(spark, lambda c: T.snippet(c, "needle", False), body) == stdlib_html.escape(T.cut_snippet(body, "needle"))
    assert T.cut_snippet("", "x") == ""
    assert T.cut_snippet("é" * 100 + "needle", "needle").startswith("…")


PAGE = """<html><head><title>Hello</title><script>var x = '<p>no</p>';</script></head><body><nav><a href="/menu">menu</a></nav>
<p>Visible <b>text</b></p><a href="/next">n</a><a href="javascript:x()">j</a><a href="mailto:a@b">m</a></body></html>"""


def test_parse_page(spark):
    df = spark.createDataFrame([(PAGE, "http://ex.test/page"), (None, None)], "h string, b string")
    got = df.select(H.parse_html(F.col("h"), F.col("b")).alias("p")).select("p.*").collect()
    assert (got[0]["title"], got[0]["text"]) == ("Hello", "Hello Visible text n j m")
    assert got[0]["links"] == ["http://ex.test/menu", "http://ex.test/next"]
    assert (got[1]["title"], got[1]["text"], got[1]["links"]) == ("", "", [])


def test_strip_and_count(spark):
    assert one(spark, H.strip_tags, "<style>a</style><p>1 &amp;lt; 2</p>") == "1 &lt; 2"
    assert one(spark, H.word_count, "<p>one, two $3+4</p>") == 3
    assert one(spark, lambda c: H.preview(c, 3), "<p>abcdef</p>") == "abc…"
    assert one(spark, H.title_of, "<TITLE a=1> x &amp; y </TITLE>") == "x & y"


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("HTTP://Example.COM:80/a/../b/?c=2&c=1&b=1#frag", "http://example.com/b?b=1&c=1&c=2"),
        ("http://example.test/items?tag=web&tag=go&sort=new", "http://example.test/items?sort=new&tag=go&tag=web"),
        ("https://u:p@x.test:443", "https://x.test/"),
        ("http://x.test:8080/a//b/./c/", "http://x.test:8080/a/b/c"),
        ("ftp://x.test/", None),
        ("no address", None),
        (None, None),
    ],
)
def test_normalize(spark, raw, key):
    assert U.normalize_one(raw) == key
    assert one(spark, U.normalize_plain, raw) == key
    assert key is None or U.normalize_one(key) == key


def test_normalize_keeps_escapes_once():
    assert U.normalize_one("http://x.test/a%20b/é") == "http://x.test/a%20b/%C3%A9" == U.normalize_one("http://x.test/a%20b/%C3%A9")
    assert U.normalize_one("http://[::1]:8080/a") == "http://[::1]:8080/a"


def test_canonical(spark):
    raw = "HTTPS://U@X.Test:80/a/../b//c/?b=2&a=1&b=1#f"
    assert U.canonical_one(raw) == "https://U@x.test/b/c/?a=1&b=2&b=1"
    assert one(spark, U.canonical_plain, "HTTPS://X.Test:443/a/") == "https://x.test/a/"
    assert one(spark, U.origin, "HTTP://X.Test:443/a") == "http://x.test"
    assert one(spark, lambda c: U.collapse_path(c), "/a/../../b/") == "/b/"


def test_hosts(spark):
    for host, private in (("localhost:80", True), ("a.localhost", True), ("10.1.2.3", True), ("172.32.0.1", False), ("8.8.8.8", False), ("169.254.1.1", True)):
        assert one(spark, U.private_host, host) is private is U.private_one(host)
    assert U.private_one("::1") and U.private_one("fd00::1") and not U.private_one("2001:4860::1")
    assert one(spark, U.should_skip, "http://x.test/a.JPG") and one(spark, U.should_skip, None)
    assert one(spark, U.norm_host, " X.Test.:80 ".replace(".:", ":")) == "x.test"


def test_headers(spark):
    assert one(spark, P.charset_param, 'text/html; a=b; Charset="GBK"') == "gbk"
    assert one(spark, P.charset_of_page, '<meta charset="GB2312">') == "gbk"
    assert one(spark, P.max_age, "public, max-age=0, max-age=60") == 60
    assert one(spark, P.type_of_path, "/a/b.JPeG?x#y") == "image/jpeg"
    assert one(spark, P.is_xml, "image/svg+xml; q=1") is True
    m = spark.createDataFrame([({"etag": '"a"', "content-length": "-1", "last-modified": "Wed, 21 Oct 2015 07:28:00 GMT"},)], "h map<string,string>")
    got = m.select(P.meta_of_headers(F.col("h"), F.lit(200)).alias("m")).select("m.*").first()
    assert (got["etag"], got["length"], str(got["last_modified"])) == ("a", None, "2015-10-21 07:28:00")
    assert m.select(P.conditional_headers(F.lit("a"), F.lit(None).cast("timestamp"))).first()[0] == {"If-None-Match": '"a"'}


def test_hash_and_waits(spark):
    assert one(spark, M.short_id, "abc") == "a9993e36"
    assert [one(spark, M.backoff, n, "int") for n in range(5)] == [0.2, 0.4, 0.8, 1.6, 1.6]
    assert one(spark, lambda c: M.clamp(c, 8, 64), -3, "int") == 8
    assert one(spark, lambda c: M.with_jitter(c, 0.0), 1.5, "double") == 1.5


def test_token_bucket_closed_form(spark):
    df = spark.createDataFrame([(i, "h", 0.0) for i in range(40)], "seq long, host string, arrival double")
    got = [r["release"] for r in S.token_bucket(df, 20).orderBy("seq").collect()]
    assert got[19] == 0.0 and got[-1] == pytest.approx(1.0)
    both = [r["release"] for r in S.two_buckets(df, 20, 10).orderBy("seq").collect()]
    assert both[-1] == pytest.approx(3.0)


def test_token_bucket_against_a_simulation(spark):
    import random

    rng = random.Random(1)
    arrivals, now = [], 0.0
    for _ in range(200):
        now += rng.random() * 0.2
        arrivals.append(now)
    rate, burst = 7.5, 7
    tokens, last, want = float(burst), 0.0, []
    for a in arrivals:
        t = max(a, last)
        tokens = min(burst, tokens + (t - last) * rate)
        if tokens < 1:
            t += (1 - tokens) / rate
            tokens = 1.0
        tokens -= 1
        last = t
        want.append(t)
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrivals)], "seq long, arrival double")
    for size in (1_000_000, 17):
        got = [r["release"] for r in S.token_bucket(df, rate, rows_per_block=size).orderBy("seq").collect()]
        assert got == pytest.approx(want)


def test_blocks_change_nothing(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("h"), F.col("id") % 11)).alias("host"), F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(97)) + F.col("id") / 10).alias("arrival"))
    one, many = ({r["seq"]: r["slot"] for r in S.min_gap(df, 0.7, rows_per_block=n).collect()} for n in (10_000, 23))
    assert one == pytest.approx(many) and len(one) == 500
    items = df.select(F.concat(F.lit("http://"), F.coalesce("host", F.lit("x")), F.lit("/"), "seq").alias("url"), (F.col("seq") % 4).alias("priority"), (F.col("seq") % 5).alias("depth"), "seq")
    one, many = ({r["seq"]: r["rank"] for r in R.ranked_by_host(items, rows_per_block=n).collect()} for n in (10_000, 31))
    assert one == many and min(one.values()) == 1


@pytest.mark.parametrize(("depth", "counts"), [(1, (13, 14, 13)), (2, (20, 21, 49)), (3, (27, 28, 70))])
def test_site_crawl(spark, depth, counts):
    pages, links, robots = C.site(spark)
    rules = C.robots_rules(robots, "corpusloom")
    done = C.crawl(spark.createDataFrame([("http://site.test/index.html",)], "url string"), links, pages, rules, depth)
    edges = C.crawl_graph(done, links, depth)
    assert (done.count(), G.nodes(done.select("url", F.lit("").alias("title")), edges).count(), edges.count()) == counts


def test_page_budget_is_exact(spark):
    pages, links, _ = C.site(spark)
    done = C.crawl(spark.createDataFrame([("http://site.test/index.html",)], "url string"), links, pages, None, 5, max_pages=17)
    assert done.count() == 17


def test_robots_groups(spark):
    body = "User-agent: other\nDisallow: /a\n# note\nUser-agent: corpus\nDisallow: /b # x\nDisallow:\nUSER-AGENT: *\ndisallow : /c"
    rules = C.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "corpusloom/1.0")
    assert sorted(r["prefix"] for r in rules.collect()) == ["/b", "/c"]


def test_host_rules(spark):
    rules = spark.createDataFrame([("*.x.test", False, 1), ("*.a.x.test", True, 2), ("b.a.x.test:80", False, 3), ("b.a.x.test", True, 4)], "pattern string, allow boolean, seq int")
    hosts = spark.createDataFrame([("x.test",), ("c.x.test",), ("a.x.test",), ("B.a.x.test",), ("y.test",)], "host string")
    got = {r["host"]: r["allowed"] for r in L.host_allowed(hosts, rules).collect()}
    assert got == {"x.test": False, "c.x.test": False, "a.x.test": True, "B.a.x.test": True, "y.test": True}


def test_sitemaps(spark):
    xml = """<?xml version="1.0"?><urlset xmlns="http://s"><url><loc> http://x.test/a?b=1&amp;c=2#d </loc><lastmod>2024-02-03</lastmod><changefreq>Weekly</changefreq>
    <priority>7</priority></url><url><loc>/relative</loc></url><url><loc>http://x.test/b</loc><lastmod>2024-02-03T04:05:06Z</lastmod></url></urlset>"""
    index = "<sitemapindex><sitemap><loc>http://x.test/1.xml</loc></sitemap><sitemap><loc>x</loc></sitemap></sitemapindex>"
    maps = spark.createDataFrame([(xml,), (index,)], "xml string")
    got = L.sitemap_urls(maps).orderBy("loc").collect()
    assert [(r["loc"], str(r["lastmod"]), r["changefreq"], r["priority"]) for r in got] == [
        ("http://x.test/a?b=1&c=2", "2024-02-03 00:00:00", "weekly", 1.0),
        ("http://x.test/b", "2024-02-03 04:05:06", "", 0.0),
    ]
    assert [r["loc"] for r in L.sitemap_children(maps).collect()] == ["http://x.test/1.xml"]
    assert one(spark, L.valid_frequency, " Daily ") and not one(spark, L.valid_frequency, "often")


def test_frontier(spark):
    items = spark.createDataFrame([(" http://h/a", 1, 5, 1), ("http://h/a", 0, 9, 2), ("http://h/b", 2, 5, 3), ("http://g/c", 0, 5, 4)], "url string, depth int, priority int, seq long")
    once = R.push_once(items)
    assert [r["url"] for r in R.in_order(once, 2).collect()] == ["http://g/c", "http://h/a"]
    assert {r["host"]: r["pending"] for r in R.pending_per_host(once).collect()} == {"h": 2, "g": 1}
    bits = R.bloom_bits(once, 1000)
    assert len(bits) * 8 == 1024
    sent = spark.sparkContext.broadcast(bits)
    assert once.select(R.may_be_seen(F.col("url"), sent).alias("x")).where("x").count() == 3


def test_bloom_slots_against_loops():
    import pandas as pd

    urls = ["", "a", "http://x.test/" + "q" * 300, "späße", "http://x.test/b"] * 3
    want = []
    for u in urls:
        row = []
        for k in range(3):
            h = 14695981039346656037
            for b in (k, *u.encode()):
                h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
            row.append(h % 1000)
        want.append(row)
    assert R._slots(pd.Series(urls), 1000).tolist() == want and R._slots(pd.Series([], dtype=str), 64).shape == (0, 3)


def test_bloom_grows_with_the_addresses(spark, monkeypatch):
    seen = spark.range(3000).select(F.concat(F.lit("http://s.test/"), F.col("id").cast("string")).alias("url"))
    new = spark.range(3000).select(F.concat(F.lit("http://n.test/"), F.col("id").cast("string")).alias("url"))
    assert R.bits_for(3000) == 48000 and R.bits_for(0) == 64
    assert R.seen_or_not(seen, seen).count() == 0 and R.seen_or_not(new, seen).count() >= 2940
    monkeypatch.setattr(R, "MOST_BITS", 64)
    assert R.bits_for(3000) is None and R.seen_or_not(new, seen).count() == 3000 and R.seen_or_not(seen, seen).count() == 0


def test_throughput_fills_gaps(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (3.2,)], "s double").select(F.timestamp_seconds("s").alias("ts"))
    got = [(r["pages"], r["rps"]) for r in S.throughput(df, "ts", 1, None).orderBy("t").collect()]
    assert got == [(2, 2.0), (2, 0.0), (2, 0.0), (3, 1.0)]
    assert [(r["pages"], r["rps"]) for r in S.throughput(df, "ts", 1, 2).orderBy("t").collect()] == got[2:]
    assert S.throughput(df.limit(0)).collect() == []


def test_graph(spark):
    raw = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("b", ""), ("b", None), ("b", "c")], "src string, dst string")
    edges = G.simple_edges(raw)
    nodes = G.nodes(spark.createDataFrame([("a", "A"), ("z", None)], "url string, title string"), edges)
    got = {r["id"]: (r["title"], r["status"], r["degree"]) for r in nodes.collect()}
    assert got == {"a": ("A", "crawled", 1), "b": ("b", "pending", 2), "c": ("c", "pending", 1), "z": ("z", "crawled", 0)}
    kept, inner = G.truncate(nodes, edges, 2)
    assert sorted(r["id"] for r in kept.collect()) == ["a", "b"] and inner.collect() == [("a", "b")]


def test_engine_tasks(spark, docs):
    engine = Engine(spark, docs.where("doc_id < 3"))
    with pytest.raises(TaskError, match="q is required"):
        engine.search(" ")
    with pytest.raises(TaskError, match="workers"):
        engine.create(Strategy(workers=65))
    pages, links, robots = C.site(spark)
    task = engine.create(Strategy(seeds=("http://site.test/index.html", "http://site.test/x.png"), max_depth=1))
    engine.run(task.id, pages, links, C.robots_rules(robots, "corpusloom"))
    assert (task.status, task.crawled, engine.docs.count()) == ("completed", 13, 15)
    assert engine.search("inverted").count() == 1 and engine.search("leaf number").count() == 12
    nodes, edges = engine.graph()
    assert edges.count() == 13 and nodes.count() == 16
    with pytest.raises(TaskError, match="cannot become"):
        engine.pause(task.id)
    engine.remove([1])
    assert engine.stats().first()["index_docs"] == 14
    engine.clear()
    assert engine.keywords().count() == 0


def test_documents_are_numbered_by_first_use(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0), ("a", 5), (None, 0)], "url string, at int")
    assert {r["url"]: r["id"] for r in I.number_by_first_use(df, "url", "at").collect()} == {"c": 1, "a": 2, "b": 3}


def test_merge_meta(spark):
    old = spark.createDataFrame([("u", 5, "e"), ("v", 1, "f")], "url string, length long, etag string")
    new = spark.createDataFrame([("u", 0, "g"), ("w", 3, "")], "url string, length long, etag string")
    assert {tuple(r) for r in L.merge_meta(old, new).collect()} == {("u", 5, "g"), ("v", 1, "f"), ("w", 3, "")}


def test_views(spark):
    assert one(spark, V.seed_lines, " http://a \n\n b ") == ["http://a", "b"]
    assert one(spark, V.valid_seeds, "HTTP://a\nhttps://b") and one(spark, V.valid_seeds, None) and not one(spark, V.valid_seeds, "ftp://a")
    assert one(spark, V.search_hint, "Page 3 · x") == "Page" and one(spark, V.search_hint, None) == ""
    assert [one(spark, V.node_radius, n, "int") for n in (0, 1, 8, 99)] == pytest.approx([3.6, 3.6, 7.8, 7.8])
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "t int, rps double")
    assert [(r["x"], r["y"]) for r in V.curve(df, 3, 36, 32).orderBy("t").collect()] == [(0.0, 20.0), (50.0, 12.0), (100.0, 4.0)]


def test_rest_of_the_functions(spark):
    assert one(spark, P.sniff_html, " \n<!DOCTYPE html><p>") is True and one(spark, P.sniff_html, "<?xml ?>") is False
    assert one(spark, P.looks_utf8, bytearray(b"\xef\xbb\xbf\xff"), "binary") is True and one(spark, P.looks_utf8, bytearray(b"\xff"), "binary") is False
    assert one(spark, P.head_bytes, bytearray(b"abc"), "binary") == b"abc" and one(spark, lambda c: P.head_bytes(c, 2), bytearray(b"abc"), "binary") == b"ab"
    df = spark.createDataFrame([("text/html", "<meta charset=big-5>"), (None, "<meta charset=big-5>"), (None, "plain"), ("a; charset=Latin1", "x")], "ct string, page string")
    assert [r[0] for r in df.select(P.detect_charset(F.col("page"), F.col("ct"))).collect()] == ["big5", "big5", "utf-8", "iso-8859-1"]
    assert one(spark, P.is_binary, "image/png") and not one(spark, P.is_binary, "") and not one(spark, P.is_binary, "application/json")
    assert one(spark, lambda c: P.redirected(c, F.lit("/x")), 302, "int") and not one(spark, lambda c: P.redirected(c, F.lit("")), 302, "int") and one(spark, P.not_modified, 304, "int")
    assert one(spark, P.may_crawl, None) and not one(spark, P.may_crawl, "application/json")
    ts = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS now, timestamp'2024-01-01 00:00:02' AS until, CAST(NULL AS timestamp) AS none")
    got = ts.select(M.wait_until(F.lit(5.0), F.col("now"), F.col("until")), M.wait_until(F.lit(5.0), F.col("until"), F.col("now")), M.wait_until(F.lit(5.0), F.col("now"), F.col("none"))).first()
    assert tuple(got) == (2.0, 0.0, 5.0)
    assert ts.select(M.local_time(F.col("now")), M.local_time(F.col("none"))).first() == ("2024-01-01 08:00:00", "")
    assert one(spark, M.gap_of_rate, 4.0, "double") == 0.25 and one(spark, M.gap_of_rate, 0.0, "double") == 0.0
    assert 0.8 <= one(spark, lambda c: M.with_jitter(c, 0.2, 1), 1.0, "double") <= 1.2
    assert one(spark, U.default_port, "HTTPS") == "443" and one(spark, U.clean_loc, " http://x.test/a#b ") == "http://x.test/a" and one(spark, U.clean_loc, "ftp://x/") == ""
    assert one(spark, lambda c: U.without_default_port(c, F.lit("http")), "x:443") == "x:443"
    assert one(spark, lambda c: H.has_lang(c, "EN"), "<html LANG='en-US'>") and not one(spark, lambda c: H.has_lang(c, ""), "<html>")
    assert one(spark, lambda c: C.within(c, "http://a/"), "http://a/b") is True
    assert [r["loc"] for r in L.with_prefix(spark.createDataFrame([("http://a/x",), ("http://b/y",)], "loc string"), " http://a/ ").collect()] == ["http://a/x"]
    seen = spark.createDataFrame([("u",)], "url string")
    items = spark.createDataFrame([("u", 1), ("v", 3), ("v", 2), (None, 0)], "url string, depth int")
    assert R.unseen(R.first_depth(items), seen).collect() == [("v", 2)]
    assert one(spark, lambda c: U.private_host_any(c), "[::1]:80") is True


def test_latest_keeps_keys_without_order(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "b", None), (4, "b", 5), (5, None, None), (6, None, 7), (7, None, 7), (8, "c", 5), (9, "d", 1), (9, "e", 2)]
    got = I.latest(spark.createDataFrame(rows, "doc_id long, url string, fetched_at long"), "url", "fetched_at")
    assert sorted((r["doc_id"], r["url"]) for r in got.where("url IS NOT NULL").collect()) == [(2, "a"), (4, "b"), (8, "c"), (9, "d"), (9, "e")]
    assert [r["doc_id"] for r in got.where("url IS NULL").collect()] == [7]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><nav>Menu</div><p>Body</p>", "Body"),
        ("<div><nav>Menu<footer>x</div><p>Body", "Body"),
        ("<table><tr><td><nav>Menu<td>Cell</table>After", "Cell After"),
        ("<table><tr><td><nav>Menu</div>more</td></tr></table>After", "After"),
        ("<nav>Menu<p>x</p></nav>Body</nav>", "Body"),
        ("<p><b>a<nav>Menu</b>more</nav>Body", "a Body"),
        ("<svg><path/><g/>x</svg>Body<br/>y<img src=a>z", "Body y z"),
        ("<nav/>Menu", ""),
        ("<script>if (a < b) x()</script>Body<style>p {}</style>", "Body"),
        ("<ul><li>a<li><nav>m</nav>b</ul>c", "a b c"),
        ("</div></p>Body</nav>", "Body"),
        ("Body" + "<i>" * 3000 + "x", "Body x"),
    ],
)
def test_end_tags_are_implied(page, text):
    assert H.parse(page, None)[1] == text


def test_parse_limit():
    page = "a" * 10 + " b"
    assert H.parse(page, None, 10)[1] == "a" * 10 and H.parse(page, None, None)[1] == page and H.parse(None, None) == ("", "", [])


def test_addresses_are_walked_once_however_spelled(spark):
    links = spark.createDataFrame([("HTTP://A.test:80/x#top", "http://a.test/p#a"), ("http://a.test/x", "http://a.test/p#b"), ("http://a.test/p", "http://a.test/./q?b=2&a=1"), ("http://a.test/p", "http://a.test/q?a=1&b=2"),
                                   ("http://a.test/p", "http://a.test/caf\u00e9"), ("http://a.test/p", "http://a.test/caf%C3%A9"), ("http://a.test/p", "mailto:x"), ("http://a.test/p", None)], "src string, dst string")
    seeds = spark.createDataFrame([("http://a.test/x",), ("http://A.test/x/",), (None,)], "url string")
    got = sorted((r["depth"], r["url"]) for r in C.crawl(seeds, links, max_depth=3).collect())
    assert got == [(0, "http://a.test/x"), (1, "http://a.test/p"), (2, "http://a.test/caf%C3%A9"), (2, "http://a.test/q?a=1&b=2")]
    known = spark.createDataFrame([("http://a.test/p#z",)], "url string")
    assert C.crawl(seeds, links, known=known).count() == 1
    pages = spark.createDataFrame([("http://a.test/x", 200, "text/html"), ("http://a.test/p#1", 200, "text/html; charset=x"), ("http://a.test/q?a=1&b=2", 500, "text/html"), ("http://a.test/caf%c3%a9", 200, "image/png")], "url string, status int, content_type string")
    assert C.crawl(seeds, links, pages).count() == 2 and C.crawl(seeds, links, pages, base="http://b").count() == 0


def test_keys_agree_with_the_exact_rule(spark):
    raw = ["http://x.test", "HTTPS://X.test:443/a/../b/?c=2&c=1&b=1#f", "http://u:p@x.test/%7Ea", "http://x.test/a b", "ftp://x/", None, "", "http://x.test//a//b/", "http://x.test/?", "https://x.test:80/"]
    df = spark.createDataFrame([(x,) for x in raw], "url string")
    want = sorted(k for k in map(U.normalize_one, raw) if k)
    assert sorted(r["url"] for r in U.with_keys(df, "url").collect()) == want


def test_robots_of_many_hosts(spark, monkeypatch):
    rules = spark.createDataFrame([("h", "/a"), ("g", "/")], "host string, prefix string")
    urls = spark.createDataFrame([(f"http://h/{x}{i}",) for x in "ab" for i in range(30)] + [("http://g/z",), ("http://k/a",), (None,)], "url string")
    one = sorted(str(r[0]) for r in C.robots_allowed(urls, rules).collect())
    monkeypatch.setattr(C, "is_small", lambda *_: False)
    monkeypatch.setattr(C, "hot_keys", lambda *_: ["h"])
    assert sorted(str(r[0]) for r in C.robots_allowed(urls, rules).collect()) == one and len(one) == 32


def test_limits_of_reading_are_parameters(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\n" + "#" * 70_000 + "\nDisallow: /x")], "host string, body string")
    assert C.robots_rules(robots, "a").count() == 0 and C.robots_rules(robots, "a", None).count() == 1
    maps = spark.createDataFrame([("<urlset>" + " " * 100 + "<url><loc>http://x.test/a</loc></url></urlset>",)], "xml string")
    assert L.sitemap_urls(maps, limit=50).count() == 0 and L.sitemap_urls(maps, limit=None).count() == 1 and L.sitemap_urls(maps).count() == 1
    page = "x" * 5000 + "charset=big5"
    assert one(spark, P.charset_of_page, page) == "" and one(spark, lambda c: P.charset_of_page(c, None), page) == "big5"
    assert one(spark, P.charset_param, "a" + "; x=1" * 2000 + '; charset="UTF-8"') == "utf-8"
    assert one(spark, P.decoded, bytearray(b"a\xff\xc3\xa9"), "binary") == "a\ufffdé"


def test_index_of_repeated_ids_and_nulls(spark):
    docs = spark.createDataFrame([(1, "u", "cat", "cat dog"), (1, "u", None, "cat"), (2, "v", None, None), (None, "w", "cat", "x"), (3, "x", "", "dog " * 70)], "doc_id long, url string, title string, body string")
    got = {(r["term"], r["doc_id"]): (r["freq"], r["positions"]) for r in I.postings(docs).collect()}
    assert got == {("cat", 1): (5, [0, 0, 1, 2, 3]), ("dog", 1): (1, [4]), ("dog", 3): (70, list(range(32)))}
    assert I.postings(docs.limit(0)).collect() == []


def test_search_is_exact_in_snippets(spark):
    body = "数据" * 40 + " crawler " + "网页" * 100
    docs = spark.createDataFrame([(1, "u", "t", body)], "doc_id long, url string, title string, body string")
    for mark in (True, False):
        got = I.search(docs, I.postings(docs), "crawler", mark=mark).first()["snippet"]
        assert got.replace("<mark>", "").replace("</mark>", "") == T.cut_snippet(body, "crawler") and ("<mark>" in got) == mark


def test_service_answers(spark, docs):
    links = spark.createDataFrame([("http://x/a", "http://x/b"), ("http://x/a", "http://x/new"), ("http://x/a", "http://x/a")], "src string, dst string")
    engine = Engine(spark, docs, links, fixture="http://site.test/index.html")
    assert engine.health().first()["status"] == "ok" and len(engine.health().first()["time"]) == 19
    stats = engine.stats(spark.createDataFrame([(5.0,), (5.5,), (3.0,)], "s double").select(F.timestamp_seconds("s").alias("fetched_at"))).first()
    assert (stats["pages_crawled"], stats["queue_length"], stats["index_docs"], stats["current_rps"], stats["crawl_mode"]) == (0, 1, 4, 2.0, "mock")
    assert {r["card"]: r["value"] for r in engine.cards().collect()}["WORK"] == "0/0"
    found = engine.found(" inverted ")
    assert found["query"] == "inverted" and found["total"] == len(found["hits"]) == 1
    for body, code in (("{", 400), ('{"workers": 65}', 400), ('{"max_depth": -1}', 400), ('{"workers": "3"}', 400), ("[1]", 400)):
        assert engine.request(body)[0] == code and engine.request(body)[1]["error"]["code"] == "VALIDATION_ERROR"
    code, view = engine.request('{"seeds": ["http://q/"], "use_fixture": true, "workers": 2, "other": 1}')
    assert (code, view["status"], view["strategy"]["seeds"], view["strategy"]["workers"], view["strategy"]["max_pages"], view["started_at"]) == (201, "pending", ("http://site.test/index.html",), 2, 200, "")
    assert engine.request("")[0] == 201
    engine.get(view["id"]).move("running")
    assert engine.request("")[0] == 409 and engine.stats().first()["active"] == 2
    with pytest.raises(TaskError) as err:
        engine.get("nope")
    assert err.value.answer()[0] == 404
    engine.pause(view["id"])
    engine.resume(view["id"])
    engine.stop(view["id"])
    assert engine.get(view["id"]).view()["finished_at"] != ""
    with pytest.raises(TaskError):
        engine.resume(view["id"])
    engine.clear()
    assert engine.graph()[1].count() == 0 and engine.graph()[0].count() == 0 and engine.stats().first()["queue_length"] == 0


def test_form(spark):
    df = spark.createDataFrame([("http://a", 1, 1, 1), ("ftp://a", 1, 1, 1), ("", 65, 1, 1), ("", 1, 0, 1), ("", 1, 1, None)], "s string, w int, d int, p int")
    assert [r[0] for r in df.select(V.valid_form(F.col("s"), F.col("w"), F.col("d"), F.col("p"))).collect()] == [True, False, False, False, False]


def test_stored_steps_are_released(spark):
    import os

    from corpusloom.sources import tables

    tables.release(spark)
    df = tables.stored(spark.range(5), "x")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and tables.release(spark) == 1 and not os.path.isdir(folder) and tables.release(spark) == 0


def test_no_private_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from corpusloom.sources.tables import scratch_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://h:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch_dir(far)


def test_broadcasts_are_checked_in_bytes(spark):
    from corpusloom.operators.scale import is_small

    df = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"), F.lit(None).cast("string").alias("a.b"))
    assert is_small(df) and not is_small(df, limit=9) and not is_small(df, most=5000) and is_small(df.limit(0))


def test_a_kept_index_follows_its_table(spark, tmp_path):
    import shutil

    from corpusloom.sources import tables

    def write(n):
        spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")

    made = []

    def make():
        made.append(1)
        return tables.stored(spark.read.parquet(f"{tmp_path}/t.parquet"), "kept")

    get = lambda: tables.kept(spark, str(tmp_path), "t", "x", make)
    write(3)
    assert get().count() == 3 and get().count() == 3 and len(made) == 1
    tables.release(spark)
    assert get().count() == 3 and len(made) == 1
    write(5)
    assert get().count() == 5 and len(made) == 2
    shutil.rmtree(get().inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert get().count() == 5 and len(made) == 3


def test_exact_snippets_against_bytes(spark):
    import random

    rng = random.Random(8)
    bodies = [None, "", "crawler", "x" * 59 + "crawler", "é" * 30 + "crawler" + "z" * 300, "数据" * 100 + "queue", " \n" * 40 + "Crawler  "]
    bodies += ["".join(rng.choice("aé数😀 \n") for _ in range(rng.randrange(0, 300))) + rng.choice(["Crawler Queue", "queue", "none", "CRAWLER"]) + "".join(rng.choice("b é据") for _ in range(rng.randrange(0, 300))) for _ in range(300)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    for query in ("crawler queue", "queue", " ", "数据"):
        got = {r["i"]: r["s"] for r in df.select("i", T.exact_snippet(F.col("body"), query).alias("s")).collect()}
        assert got == {i: T.cut_snippet(b, query) for i, b in enumerate(bodies)}, query
