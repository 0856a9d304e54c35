"""Queries of the operators around fetching, crawling and serving, over values that stand in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import http as P
from corpusloom.functions import misc as M
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.functions import view as V
from corpusloom.operators import crawl as C
from corpusloom.operators import frontier as R
from corpusloom.operators import rules as L
from corpusloom.operators import schedule as S
from corpusloom.operators.index import search
from corpusloom.plans.engine import Engine
from corpusloom.plans.reference import _CANON, _KEY, _MINUTES, _ORIGIN, _PATH, _POSTINGS, _SCORES, ASKED, _esc, _escaped, _pages, _u, documents, index_of
from corpusloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- pages ----------------------------------------------------------------------------------------------------------------

_TEXT = "trim(regexp_replace(coalesce({t}, ''), '[\\s\\x{{85}}\\x{{1c}}-\\x{{1f}}\\p{{Z}}]+', ' ', 'g'))"


@query(
    f"""SELECT page_id, trim(coalesce(title, '')) AS title, {_TEXT.format(t="coalesce(title, '') || ' ' || coalesce(text, '') || ' b'")} AS text,
{_u(_ORIGIN, 'base_url')} || '/a/x ' || {_u(_ORIGIN, 'base_url')} || regexp_replace(regexp_replace({_u(_PATH, 'base_url')}, '[^/]*$', ''), '[^/]+/$', '') || 'b?c=1' AS links FROM crawl_pages WHERE base_url IS NOT NULL"""
)
def parsed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Title, text and links by a walk over the tree of every page."""
    p = H.parse_html(F.col("html"), F.col("base_url"))
    got = _pages(spark, d).where(F.col("base_url").isNotNull()).select("page_id", p.alias("p"))
    return got.select("page_id", F.col("p.title").alias("title"), F.col("p.text").alias("text"), F.array_join("p.links", " ").alias("links"))


@query("SELECT page_id, trim(coalesce(text, '')) = '' AS bare, contains(left(lower(trim(coalesce(text, ''), ' ')), 256), '<html') AS html, true AS utf8, coalesce(text, '') AS decoded FROM crawl_pages")
def page_bytes(spark: SparkSession, d: str) -> DataFrame:
    """What the bytes of every text look like, and their text again."""
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = table(spark, d, "crawl_pages").select("page_id", F.coalesce("text", F.lit("")).alias("text"), body.alias("body"))
    sniffed = F.left(F.trim(F.lower("text")), F.lit(256)).contains("<!doctype html")
    return rows.select("page_id", (F.trim("text") == "").alias("bare"), (P.sniff_html(F.col("text")) & ~sniffed).alias("html"), P.looks_utf8(F.col("body")).alias("utf8"), P.decoded(F.col("body")).alias("decoded"))


_NORMAL = """CASE WHEN c IN ('utf8', 'utf-8', 'unicode-1-1-utf-8') THEN 'utf-8' WHEN c IN ('gbk', 'gb2312', 'gb-2312', 'windows-936') THEN 'gbk' WHEN c IN ('big5', 'big-5', 'cn-big5') THEN 'big5'
WHEN c IN ('iso-8859-1', 'latin1', 'latin-1') THEN 'iso-8859-1' WHEN c IN ('us-ascii', 'ascii') THEN 'ascii' ELSE c END"""


@query(
    f"""WITH p AS (SELECT doc_id, replace(regexp_extract(lower(coalesce(lang, '')), '^[ \\t"'']*([^"'' ;>]*)', 1), '_', '-') AS c FROM documents)
SELECT doc_id, {_NORMAL} AS page, CASE WHEN {_NORMAL} = '' THEN 'utf-8' ELSE {_NORMAL} END AS detected FROM p"""
)
def page_charsets(spark: SparkSession, d: str) -> DataFrame:
    """The character set a page names, here the spellings of `lang`, and what is taken without a header."""
    page = F.concat(F.lit("<meta charset="), F.coalesce("lang", F.lit("")), F.lit(">"))
    rows = table(spark, d, "documents").select("doc_id", page.alias("page"))
    return rows.select("doc_id", P.charset_of_page(F.col("page")).alias("page"), P.detect_charset(F.col("page"), F.lit("text/html")).alias("detected"))


# --- headers --------------------------------------------------------------------------------------------------------------

_STAMP = "strftime(fetched_at, '%a, %d %b %Y %H:%M:%S GMT')"


def _fetched(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the headers that they would have come with."""
    docs = table(spark, d, "documents")
    stamp = F.date_format(F.col("fetched_at").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    pairs = {
        "content-type": F.concat(F.lit("text/html; charset="), F.coalesce("lang", F.lit("utf-8"))), "content-length": F.col("n_chars").cast("string"),
        "etag": F.concat(F.lit('"'), F.sha1(F.col("url").cast("binary")), F.lit('"')), "last-modified": stamp, "cache-control": F.concat(F.lit("max-age="), F.length("url").cast("string")), "location": F.concat(F.lit(" "), F.col("url")),
    }
    headers = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return docs.select("doc_id", "url", headers.alias("headers"))


@query(
    """SELECT doc_id, CAST(200 AS INTEGER) AS status, 'text/html; charset=' || coalesce(lang, 'utf-8') AS content_type, coalesce(n_chars, -1) AS length, sha1(url) AS etag,
date_trunc('second', fetched_at) AS last_modified, 'max-age=' || length(url) AS cache_control, CAST(length(url) AS BIGINT) AS age, trim(url) AS redirect FROM documents"""
)
def fetch_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What the headers of every document say."""
    m = P.meta_of_headers(F.col("headers"), F.lit(200))
    rows = _fetched(spark, d).select("doc_id", m.alias("m"))
    return rows.select("doc_id", "m.status", "m.content_type", F.coalesce("m.length", F.lit(-1)).alias("length"), "m.etag", F.col("m.last_modified").cast("timestamp_ntz").alias("last_modified"), "m.cache_control", P.max_age(F.col("m.cache_control")).alias("age"), "m.redirect")


@query(f"SELECT doc_id, '\"' || sha1(url) || '\"' AS none_match, {_STAMP} AS modified_since, CASE WHEN fetched_at IS NULL THEN 1 ELSE 2 END AS n FROM documents WHERE url IS NOT NULL")
def conditional_requests(spark: SparkSession, d: str) -> DataFrame:
    """The headers that ask whether a document has changed."""
    rows = table(spark, d, "documents").where(F.col("url").isNotNull())
    sent = P.conditional_headers(F.sha1(F.col("url").cast("binary")), F.col("fetched_at").cast("timestamp"))
    return rows.select("doc_id", sent.alias("h")).select("doc_id", F.try_element_at("h", F.lit("If-None-Match")).alias("none_match"), F.try_element_at("h", F.lit("If-Modified-Since")).alias("modified_since"), F.size("h").alias("n"))


_ENDING = "lower(regexp_extract(split_part(split_part({u}, '?', 1), '#', 1), '\\.([^./]*)$', 1))"
_TYPE = "coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in P.TYPES.items()) + "}, e)[1], '')"


@query(
    f"""WITH a AS (SELECT DISTINCT dst AS url, {_ENDING.format(u='dst')} AS e FROM edges WHERE dst <> ''), t AS (SELECT url, {_TYPE} AS media FROM a)
SELECT url, media, media IN ('text/html', 'application/xhtml+xml') AS html, media IN ('application/xml', 'text/xml') OR media LIKE '%+xml' AS xml,
media <> '' AND NOT (media LIKE 'text/%' OR media IN ('application/xhtml+xml', 'application/xml', 'application/json') OR media LIKE '%+xml') AS binary FROM t"""
)
def media_of_links(spark: SparkSession, d: str) -> DataFrame:
    """Media type of every linked address by its ending."""
    urls = table(spark, d, "edges").where(F.col("dst") != "").select(F.col("dst").alias("url")).distinct()
    t = urls.withColumn("media", P.type_of_path(F.col("url")))
    return t.select("url", "media", P.is_html(F.col("media")).alias("html"), P.is_xml(F.col("media")).alias("xml"), P.is_binary(F.col("media")).alias("binary"))


@query(
    """SELECT l_orderkey, l_linenumber, s BETWEEN 200 AND 299 AS ok, s BETWEEN 300 AND 399 AND l_returnflag <> 'N' AS redirected, s = 304 AS not_modified, s IN (408, 429) OR s >= 500 AS retryable
FROM (SELECT *, CAST(100 + l_quantity * 10 AS INTEGER) AS s FROM lineitem)"""
)
def status_of_answers(spark: SparkSession, d: str) -> DataFrame:
    """Rules on status codes; the codes are 100 and ten for each piece of an order line."""
    s = (100 + F.col("l_quantity") * 10).cast("int")
    location = F.when(F.col("l_returnflag") == "N", "").otherwise("/x")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", P.ok(s).alias("ok"), P.redirected(s, location).alias("redirected"), P.not_modified(s).alias("not_modified"), P.retryable(s).alias("retryable")
    )


# --- addresses ------------------------------------------------------------------------------------------------------------


@query(f"SELECT url, {_u(_KEY)} AS key, {_u(_CANON)} AS canonical FROM (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL)")
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    """Crawl key and canonical form of every document's address by the exact rules."""
    u = documents(spark, d).select("url").where(F.col("url").isNotNull()).distinct()
    return u.select("url", U.normalize_url(F.col("url")).alias("key"), U.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT DISTINCT {_escaped('url')} AS url FROM (SELECT {_u(_KEY, 'dst')} AS url FROM edges WHERE dst <> '' UNION ALL SELECT {_u(_KEY, 'src')} FROM edges WHERE src <> '')")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the graph, each once however it is spelled."""
    e = table(spark, d, "edges").select(F.explode(F.array("src", "dst")).alias("url")).where(F.col("url") != "").distinct()
    return U.with_keys(e, "url").distinct()


_CUT = (
    """b AS (SELECT doc_id, text, strlen(substr(lower(text), 1, CAST(i - 1 AS BIGINT))) AS n, i FROM (SELECT doc_id, text, coalesce(nullif(instr(lower(text), 'crawler queue'), 0), nullif(instr(lower(text), 'crawler'), 0),
  nullif(instr(lower(text), 'queue'), 0), 1) AS i FROM documents)),
k AS (SELECT *, CASE WHEN n <= 60 THEN 0 ELSE list_filter(range(0, 61), lambda j: strlen(substr(text, CAST(i - j AS BIGINT), j)) >= 60)[1] END AS j FROM b),
s AS (SELECT *, CASE WHEN n <= 60 THEN 0 ELSE i - 1 - j + strlen(substr(text, CAST(i - j AS BIGINT), j)) - 60 END AS b FROM k),
cut AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE """
    + _esc("(CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, CAST(b AS BIGINT) + 1, 180), '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g') || CASE WHEN b + 180 < length(text) THEN '…' ELSE '' END)")
    + " END AS snippet FROM s)\n"
)


@query("WITH " + _CUT + "SELECT doc_id, snippet FROM cut")
def snippets_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of every document by the byte rule that the search uses, escaped."""
    return documents(spark, d).select("doc_id", T.escape_html(T.exact_snippet(F.col("body"), ASKED)).alias("snippet"))


_MARKED = "regexp_replace({x}, '(?i)(crawler queue|crawler|queue)', '<mark>\\1</mark>', 'g')"


@query(
    _POSTINGS
    + f""", {_CUT}, hit AS (SELECT s.doc_id, score FROM ({_SCORES}) s JOIN documents USING (doc_id) ORDER BY score DESC, url, doc_id LIMIT 50)
SELECT doc_id, url, {_MARKED.format(x=_esc("coalesce(title, '')"))} AS title, CAST(score AS DOUBLE) AS score, {_MARKED.format(x="snippet")} AS snippet, true AS highlight
FROM hit JOIN documents USING (doc_id) JOIN cut USING (doc_id)"""
)
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """A full answer to a search: addresses, marked titles and snippets, scores."""
    return search(documents(spark, d), index_of(spark, d), ASKED, 50)


# --- crawl and frontier ---------------------------------------------------------------------------------------------------

_START = "stiralastonan-notes.test"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT {_escaped(_u(_KEY, 'src'))} AS src, {_escaped(_u(_KEY, 'dst'))} AS dst FROM edges WHERE src <> '' AND dst <> ''),
known AS (SELECT DISTINCT {_u(_KEY)} AS url FROM documents WHERE url IS NOT NULL),
w AS (SELECT url, 0 AS depth FROM (SELECT DISTINCT src AS url FROM e WHERE src NOT IN (SELECT url FROM known) ORDER BY url LIMIT 3)
UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 3 AND e.dst NOT IN (SELECT url FROM known) AND starts_with(e.dst, 'http')),
m AS (SELECT url, min(depth) AS depth FROM w GROUP BY url)
SELECT url, depth FROM m ORDER BY depth, url LIMIT 150"""
)
def crawl_budget(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of at most 150 pages that leaves out what the collection holds already."""
    edges = table(spark, d, "edges").where((F.col("src") != "") & (F.col("dst") != "")).select("src", "dst")
    known = U.with_keys(documents(spark, d).select("url"), "url").distinct()
    seeds = U.with_keys(edges.select(F.col("src").alias("url")).distinct(), "url").distinct().join(known, "url", "left_anti").orderBy("url").limit(3)
    return C.crawl(seeds, edges, max_depth=3, max_pages=150, known=known, base="http")


@query(f"SELECT DISTINCT dst AS url FROM edges WHERE starts_with(dst, 'https://{_START}/p/')")
def links_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Linked addresses under one base."""
    return table(spark, d, "edges").where(C.within(F.col("dst"), f"https://{_START}/p/")).select(F.col("dst").alias("url")).distinct()


@query("SELECT (SELECT count(DISTINCT url) FROM documents) AS added, 0 AS missed, true AS few_mistaken")
def bloom_filter(spark: SparkSession, d: str) -> DataFrame:
    """Addresses added to a filter of bits, added ones that it misses, and whether under 2 % of strangers seem to be seen."""
    urls = documents(spark, d).select("url").where(F.col("url").isNotNull()).distinct()
    strangers = table(spark, d, "edges").where(F.col("dst") != "").select(F.concat(F.lit("urn:"), F.col("dst")).alias("url")).distinct()
    n, m = urls.count(), strangers.count()
    missed, new = R.seen_or_not(urls, urls).count(), R.seen_or_not(strangers, urls).count()
    return spark.createDataFrame([(n, missed, m - new <= 0.02 * m)], "added bigint, missed bigint, few_mistaken boolean")


@query("SELECT DISTINCT url FROM (SELECT base_url AS url FROM crawl_pages) WHERE starts_with(url, 'https://m') AND url <> ''")
def sitemap_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one sitemap for each page whose address begins with a prefix."""
    xml = F.concat(F.lit("<urlset><url><loc>"), F.col("base_url"), F.lit("</loc><lastmod>"), F.date_format(F.col("fetched_at").cast("timestamp"), "yyyy-MM-dd"), F.lit("</lastmod></url></urlset>"))
    maps = table(spark, d, "crawl_pages").where(F.col("base_url").isNotNull()).select(xml.alias("xml"))
    return L.with_prefix(L.sitemap_urls(maps), "https://m").select(F.col("loc").alias("url")).distinct()


@query("SELECT page_id, base_url AS loc, date_trunc('day', fetched_at) AS lastmod FROM crawl_pages WHERE base_url IS NOT NULL AND fetched_at IS NOT NULL")
def sitemap_dates(spark: SparkSession, d: str) -> DataFrame:
    """Address and day of each page, written as a sitemap and read again."""
    xml = F.concat(F.lit("<urlset><url><loc>"), F.col("base_url"), F.lit("#"), F.col("page_id").cast("string"), F.lit("</loc><lastmod>"), F.date_format(F.col("fetched_at").cast("timestamp"), "yyyy-MM-dd"), F.lit("</lastmod><priority>0.5</priority></url></urlset>"))
    maps = table(spark, d, "crawl_pages").where(F.col("base_url").isNotNull() & F.col("fetched_at").isNotNull()).select("page_id", xml.alias("xml"))
    return L.sitemap_urls_of(maps, "page_id").select("page_id", "loc", F.col("lastmod").cast("timestamp_ntz").alias("lastmod"))


@query("SELECT DISTINCT term, lower(trim(term)) IN ('', 'always', 'hourly', 'daily', 'weekly', 'monthly', 'yearly', 'never') AS valid FROM keywords WHERE term IS NOT NULL")
def change_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Which reported terms would be a valid frequency of change."""
    return table(spark, d, "keywords").where(F.col("term").isNotNull()).select("term").distinct().select("term", L.valid_frequency(F.col("term")).alias("valid"))


# --- rates and views ------------------------------------------------------------------------------------------------------


@query(_MINUTES + "SELECT to_timestamp(b * 60)::TIMESTAMP AS t, CASE WHEN n > 0 THEN round(60.0 / n, 6)::DOUBLE ELSE 0 END AS gap FROM x")
def gaps_of_rates(spark: SparkSession, d: str) -> DataFrame:
    """Seconds between two events at the rate of each minute."""
    s = S.throughput(table(spark, d, "events").select("ts"), "ts", 60, None)
    return s.select("t", F.round(M.gap_of_rate(F.col("rps")), 6).alias("gap"))


@query("SELECT l_orderkey, l_linenumber, greatest(least(l_quantity, epoch(o_orderdate) - epoch(l_shipdate) + 8640000), 0)::DOUBLE AS wait FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def waits_to_deadline(spark: SparkSession, d: str) -> DataFrame:
    """Waits of an order line's quantity in seconds, cut at a deadline a hundred days after the order."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    until = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + 8640000)
    return rows.select("l_orderkey", "l_linenumber", M.wait_until(F.col("l_quantity"), F.col("l_shipdate").cast("timestamp"), until).alias("wait"))


@query(
    _MINUTES
    + """, k AS (SELECT b, n / 60.0 AS rps FROM x ORDER BY b DESC LIMIT 48)
SELECT to_timestamp(b * 60)::TIMESTAMP AS t, round((row_number() OVER (ORDER BY b) - 1) / greatest(count(*) OVER () - 1, 1) * 100.0, 6)::DOUBLE AS x,
  round(28 - rps / greatest(max(rps) OVER (), 1) * 24, 6)::DOUBLE AS y FROM k"""
)
def spark_line(spark: SparkSession, d: str) -> DataFrame:
    c = V.curve(S.throughput(table(spark, d, "events").select("ts"), "ts", 60), 48, 28, 24)
    return c.select("t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_TWO = """WITH r AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS a, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
g AS (SELECT *, greatest(a, coalesce(i * 20.0 + max(a - i * 20.0) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS first FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM g)
"""


@query(_TWO + "SELECT event_id AS seq, round(greatest(first, coalesce(k * 500.0 + max(first - k * 500.0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first)), 3)::DOUBLE AS release FROM h")
def global_and_host_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Releases of requests that pass a bucket of all and then one of their host."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("arrival"))
    return S.two_buckets(e, 0.05, 0.002).select("seq", F.round("release", 3).alias("release"))


@query(
    """WITH t AS (SELECT count(*) AS docs FROM documents), q AS (SELECT count(*) AS n FROM (SELECT DISTINCT dst AS url FROM edges WHERE src <> '' AND dst <> '' AND src <> dst) WHERE url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL))
SELECT 'PAGES' AS card, '0' AS value UNION ALL SELECT 'QUEUE', CAST(n AS VARCHAR) FROM q UNION ALL SELECT 'DOCS', CAST(docs AS VARCHAR) FROM t UNION ALL SELECT 'RPS', '0' UNION ALL SELECT 'WORK', '0/0'"""
)
def service_cards(spark: SparkSession, d: str) -> DataFrame:
    """The service's figures before any task has run; `index_stats` checks the number of terms."""
    return Engine(spark, documents(spark, d), table(spark, d, "edges").select("src", "dst")).cards().where(F.col("card") != "TERMS")

