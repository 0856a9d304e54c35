"""Queries of the engine's own operators over the tables, each with the same result in SQL."""

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
from corpusloom.operators import graph as G
from corpusloom.operators import index as I
from corpusloom.operators import rules as L
from corpusloom.operators import schedule as S
from corpusloom.sources.tables import kept, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The query of the search examples.
ASKED = "crawler queue"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "url", "title", F.col("text").alias("body"))


def index_of(spark: SparkSession, d: str) -> DataFrame:
    """The documents' index, stored once; the queries that search or sum it read it."""
    return kept(spark, d, "documents", "index", lambda: I.stored_index(documents(spark, d)))


def _list(*words: str) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- tokens and the index -------------------------------------------------------------------------------------------------

_STEM = """CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y'
 WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3)
 WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, length(w) - 2)
 WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"""


def _tokens(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    han = f"flatten(list_transform(regexp_extract_all({low}, '\\p{{Han}}+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
    words = f"list_filter(list_transform(regexp_extract_all({low}, '[a-z0-9]+'), lambda w: {_STEM}), lambda w: length(w) >= 2 AND w NOT IN ({_list(*T.STOP_WORDS)}))"
    return f"list_concat({han}, {words})"


_POSTINGS = f"""WITH tok AS (SELECT doc_id, list_concat({_tokens("title")}, {_tokens("title")}, {_tokens("title")}, {_tokens("text")}) AS t FROM documents),
pos AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tok),
post AS (SELECT term, doc_id, count(*) AS freq, list_sort(list(pos))[1:32] AS positions FROM pos GROUP BY term, doc_id)
"""


@query(f"SELECT doc_id, array_to_string({_tokens('title')}, ' ') AS tokens FROM documents")
def tokenize_titles(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.array_join(T.tokenize(F.col("title")), " ").alias("tokens"))


@query(f"SELECT doc_id, len(list_distinct({_tokens('text')})) AS n_terms, len({_tokens('text')}) AS n_tokens FROM documents")
def query_terms_texts(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return documents(spark, d).select("doc_id", F.size(T.query_terms(body)).cast("bigint").alias("n_terms"), F.size(T.tokenize(body)).cast("bigint").alias("n_tokens"))


@query(_POSTINGS + "SELECT term, doc_id, freq, array_to_string(positions, ',') AS positions FROM post")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(_POSTINGS + "SELECT term, CAST(sum(freq) AS BIGINT) AS freq FROM post GROUP BY term")
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return I.term_freq(index_of(spark, d))


@query(_POSTINGS + "SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(DISTINCT term) FROM post) AS terms")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return I.index_stats(docs, index_of(spark, d))


@query(_POSTINGS + "SELECT term, CAST(sum(freq) AS BIGINT) AS freq FROM post GROUP BY term ORDER BY freq DESC, term LIMIT 30")
def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return I.top_keywords(I.term_freq(index_of(spark, d)))


_SCORES = "SELECT doc_id, sum(freq) AS score FROM post WHERE term IN ('crawler', 'queue') GROUP BY doc_id HAVING count(*) = 2"


@query(_POSTINGS + f"SELECT doc_id, CAST(score AS DOUBLE) AS score FROM ({_SCORES})")
def search_scores(spark: SparkSession, d: str) -> DataFrame:
    return I.scores(index_of(spark, d), ASKED)


@query(
    _POSTINGS
    + f"""SELECT s.doc_id, url, CAST(score AS DOUBLE) AS score FROM ({_SCORES}) s JOIN documents USING (doc_id)
ORDER BY score DESC, url, doc_id LIMIT 20"""
)
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return I.search(docs, index_of(spark, d), ASKED).select("doc_id", "url", "score")


@query(_POSTINGS + "SELECT term, CAST(sum(freq) AS BIGINT) AS freq FROM post WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang IS NULL) GROUP BY term")
def remove_documents(spark: SparkSession, d: str) -> DataFrame:
    unlabelled = table(spark, d, "documents").where(F.col("lang").isNull()).select("doc_id")
    return I.term_freq(I.remove(index_of(spark, d), unlabelled))


@query("SELECT doc_id, url, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, doc_id DESC) AS r FROM documents) WHERE r = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return I.latest(table(spark, d, "documents").select("doc_id", "url", "title", "fetched_at"), "url", "fetched_at").select("doc_id", "url", "title")


@query("SELECT url, row_number() OVER (ORDER BY first, url) AS id FROM (SELECT url, min(fetched_at) AS first FROM documents WHERE url IS NOT NULL GROUP BY url)")
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    return I.number_by_first_use(table(spark, d, "documents").select("url", "fetched_at"), "url", "fetched_at")


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


@query(f"SELECT doc_id, regexp_replace({_esc('title')}, '(?i)(crawler queue|crawler|queue)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def highlight_titles(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.highlight(F.col("title"), ASKED).alias("marked"))


_AT = "coalesce(nullif(instr(lower(text), 'crawler queue'), 0), nullif(instr(lower(text), 'crawler'), 0), nullif(instr(lower(text), 'queue'), 0), 1)"


@query(
    f"""WITH s AS (SELECT doc_id, text, greatest({_AT} - 61, 0) AS b FROM documents)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE {_esc("(CASE WHEN b > 0 THEN '…' ELSE '' END || regexp_replace(substr(text, CAST(b AS BIGINT) + 1, 180), '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g') || CASE WHEN b + 180 < length(text) THEN '…' ELSE '' END)")} END AS snippet FROM s"""
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.snippet(F.col("body"), ASKED, mark=False).alias("snippet"))


# --- HTML -----------------------------------------------------------------------------------------------------------------

_PAGE = """'<html lang="en"><head><title>' || coalesce(title, '') || '</title><style>p {{x: y}}</style></head><body><nav><a href="/a/x">Home</a></nav><p>' ||
replace(replace(replace(coalesce({text}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><script>var a = 1;</script><a href="../b?c=1">b</a></body></html>'"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    head = F.concat(F.lit('<html lang="en"><head><title>'), F.coalesce("title", F.lit("")), F.lit('</title><style>p {x: y}</style></head><body><nav><a href="/a/x">Home</a></nav><p>'))
    page = F.concat(head, text, F.lit('</p><script>var a = 1;</script><a href="../b?c=1">b</a></body></html>'))
    return table(spark, d, "crawl_pages").select("page_id", "base_url", page.alias("html"))


_HTML = f"WITH pages AS (SELECT page_id, {_PAGE.format(text='text')} AS html FROM crawl_pages),\n"
_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
_STRIPPED = (
    "s AS (SELECT page_id, html, trim(regexp_replace("
    + _UNESCAPE.format(x="regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')")
    + ", '[ \\t\\r\\n\\f]+', ' ', 'g')) AS t FROM pages)\n"
)


@query(_HTML + _STRIPPED + "SELECT page_id, t AS text FROM s")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", H.strip_tags(F.col("html")).alias("text"))


@query(_HTML + _STRIPPED + f"SELECT page_id, trim({_UNESCAPE.format(x="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title FROM s")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", H.title_of(F.col("html")).alias("title"))


@query(_HTML + _STRIPPED + "SELECT page_id, CASE WHEN length(t) <= 100 THEN t ELSE trim(left(t, 100)) || '…' END AS preview FROM s")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", H.preview(F.col("html"), 100).alias("preview"))


@query(_HTML + _STRIPPED + "SELECT page_id, len(regexp_extract_all(t, '[^\\s\\x{85}\\p{Z}\\p{P}]+')) AS words FROM s")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", H.word_count(F.col("html")).cast("bigint").alias("words"))


@query("SELECT doc_id, starts_with(lower(lang), 'en') AS en, starts_with(lower(lang), 'zh') AS zh FROM (SELECT doc_id, coalesce(lang, '') AS lang FROM documents)")
def lang_hints(spark: SparkSession, d: str) -> DataFrame:
    """Languages that the attribute of a page names, here the spellings of `lang`."""
    page = F.concat(F.lit("<html LANG='"), F.coalesce("lang", F.lit("")), F.lit("'>"))
    return table(spark, d, "documents").select("doc_id", H.has_lang(page, "en").alias("en"), H.has_lang(page, " ZH").alias("zh"))


@query("SELECT page_id, generate_subscripts(links, 1) - 1 AS pos, unnest(links) AS link FROM crawl_pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_pages").select("page_id", F.posexplode("links").alias("pos", "link")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


# --- addresses ------------------------------------------------------------------------------------------------------------

_AUTH = "lower(regexp_replace(regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), '^[^@]*@', ''))"
_HOST = f"regexp_replace({_AUTH}, ':[0-9]*$', '')"
_SCHEME = "lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_PATH = "regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_BARE = f"regexp_replace({_AUTH}, ':(?:80|443)$', '')"
_ORIGIN = f"CASE WHEN {_SCHEME} <> '' AND {_AUTH} <> '' THEN {_SCHEME} || '://' || {_BARE} ELSE '' END"


def _u(x: str, u: str = "url") -> str:
    return x.format(u=u)


def _escaped(x: str) -> str:
    """`x` with characters outside ASCII written as escapes."""
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"


@query(f"SELECT doc_id, {_u(_HOST)} AS host, {_u(_ORIGIN)} AS origin, split_part(url, '#', 1) AS bare FROM documents")
def hosts_and_origins(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return documents(spark, d).select("doc_id", U.host_of(u).alias("host"), U.origin(u).alias("origin"), U.strip_fragment(u).alias("bare"))


_QUERY = """CASE WHEN regexp_extract({u}, '[?]([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(list_transform(
string_split(regexp_extract({u}, '[?]([^#]*)', 1), '&'), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') END"""
_KEYPATH = f"regexp_replace(regexp_replace({_PATH}, '/+', '/', 'g'), '/$', '')"
_KEY = f"""{_SCHEME} || '://' || CASE {_SCHEME} WHEN 'http' THEN regexp_replace({_AUTH}, ':80$', '') ELSE regexp_replace({_AUTH}, ':443$', '') END ||
CASE WHEN {_KEYPATH} = '' THEN '/' ELSE {_KEYPATH} END || {_QUERY}"""


@query(f"SELECT dst AS url, {_u(_KEY, 'dst')} AS key FROM (SELECT DISTINCT dst FROM edges WHERE dst <> '')")
def normalize_links(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "edges").where(F.col("dst") != "").select(F.col("dst").alias("url")).distinct()
    return u.select("url", U.normalize_plain(F.col("url")).alias("key"))


_CANON = f"""{_SCHEME} || '://' || {_BARE} || CASE WHEN regexp_replace({_PATH}, '/+', '/', 'g') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+', '/', 'g') END || {_QUERY}"""


@query(f"SELECT doc_id, {_u(_CANON)} AS canonical FROM documents")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", U.canonical_plain(F.col("url")).alias("canonical"))


_SKIP = f"coalesce({_SCHEME} NOT IN ('http', 'https') OR {_AUTH} = '' OR regexp_matches(lower({_PATH}), '\\.(?:{'|'.join(U.SKIPPED_ENDINGS)})$'), true)"


@query(f"SELECT doc_id, {_u(_SKIP)} AS skip, {_u(_SKIP, 'title')} AS title_skip, {_u(_HOST)} = 'stiralastonan-notes.test' AS same FROM documents")
def admission(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return documents(spark, d).select(
        "doc_id", U.should_skip(u).alias("skip"), U.should_skip(F.col("title")).alias("title_skip"), U.same_host(u, F.lit("http://STIRALASTONAN-NOTES.test:81/x")).alias("same")
    )


@query(
    f"""SELECT src, dst, {_u(_ORIGIN, 'src')} <> '' AND {_u(_ORIGIN, 'src')} = {_u(_ORIGIN, 'dst')} AS inside FROM (SELECT DISTINCT src, dst FROM edges
WHERE src <> '' AND dst <> '' AND src <> dst)"""
)
def same_origin_links(spark: SparkSession, d: str) -> DataFrame:
    return G.simple_edges(table(spark, d, "edges")).select("src", "dst", U.same_origin(F.col("src"), F.col("dst")).alias("inside"))


@query(
    """SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN '10.0.0.' || user_id WHEN user_id % 5 = 1 THEN '172.' || user_id || '.1.1' WHEN user_id % 5 = 2 THEN 'LOCALHOST.' ELSE '8.8.8.' || user_id END AS host,
CASE WHEN user_id % 5 IN (0, 2) THEN true WHEN user_id % 5 = 1 THEN user_id BETWEEN 16 AND 31 ELSE false END AS private FROM events"""
)
def private_hosts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("user_id")
    s = n.cast("string")
    host = F.when(n % 5 == 0, F.concat(F.lit("10.0.0."), s)).when(n % 5 == 1, F.concat(F.lit("172."), s, F.lit(".1.1"))).when(n % 5 == 2, "LOCALHOST.").otherwise(F.concat(F.lit("8.8.8."), s))
    return table(spark, d, "events").select(host.alias("host")).distinct().select("host", U.private_host(F.col("host")).alias("private"))


# --- graph ----------------------------------------------------------------------------------------------------------------

_EDGES = "WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> '' AND dst <> '' AND src <> dst),\n"
_ENDS = "ends AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)\n"
_NODES = """, p AS (SELECT base_url AS id, max(coalesce(title, '')) AS title FROM crawl_pages WHERE base_url IS NOT NULL GROUP BY base_url),
n AS (SELECT coalesce(p.id, ends.id) AS id, coalesce(nullif(p.title, ''), p.id, ends.id) AS title, CASE WHEN p.id IS NULL THEN 'pending' ELSE 'crawled' END AS status,
  coalesce(degree, 0) AS degree FROM p FULL JOIN ends ON p.id = ends.id)
"""


@query(_EDGES[:-2] + " SELECT src, dst FROM e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.simple_edges(table(spark, d, "edges"))


@query(_EDGES + _ENDS + "SELECT id, degree FROM ends")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(G.simple_edges(table(spark, d, "edges")))


def _crawled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_pages").where(F.col("base_url").isNotNull()).select(F.col("base_url").alias("url"), "title")


@query(_EDGES + _ENDS + _NODES + "SELECT id, title, status, degree FROM n")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes(_crawled(spark, d), G.simple_edges(table(spark, d, "edges"))).select("id", "title", "status", "degree")


@query(_EDGES + _ENDS + _NODES + ", k AS (SELECT id FROM n ORDER BY degree DESC, id LIMIT 400) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def graph_truncated(spark: SparkSession, d: str) -> DataFrame:
    edges = G.simple_edges(table(spark, d, "edges"))
    return G.truncate(G.nodes(_crawled(spark, d), edges), edges)[1]


# --- crawl ----------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT {_escaped(_u(_KEY, 'src'))} AS src, {_escaped(_u(_KEY, 'dst'))} AS dst FROM edges WHERE src <> '' AND dst <> '' AND NOT contains(dst, '/search/')),
w AS (SELECT {_escaped(_u(_KEY, 'src'))} AS url, 0 AS depth FROM (SELECT DISTINCT src FROM edges ORDER BY src LIMIT 5) WHERE NOT contains(src, '/search/')
UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.url WHERE w.depth < 3)
SELECT url, min(depth) AS depth FROM w GROUP BY url"""
)
def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first levels over the links from the first five pages, robots rules applied; addresses as crawl keys."""
    edges = table(spark, d, "edges").where((F.col("src") != "") & (F.col("dst") != "") & ~F.col("dst").contains("/search/")).select("src", "dst")
    seeds = table(spark, d, "edges").select("src").distinct().orderBy("src").limit(5).select(F.col("src").alias("url")).where(~F.col("url").contains("/search/"))
    return C.crawl(seeds, edges, max_depth=3)


@query("SELECT i AS max_depth, p AS pages, n AS nodes, e AS edges FROM (VALUES (1, 13, 14, 13), (2, 20, 21, 49), (3, 27, 28, 70), (4, 34, 35, 91), (6, 48, 49, 133)) t(i, p, n, e)")
def site_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Pages, nodes and edges of a crawl of the generated site to several depths, against their closed form."""
    pages, links, robots = C.site(spark)
    rules = C.robots_rules(robots, "corpusloom")
    seeds = spark.createDataFrame([("http://site.test/index.html",)], "url string")
    rows = []
    full = C.crawl(seeds, links, pages, rules, 6)
    for depth in (1, 2, 3, 4, 6):
        done = full.where(F.col("depth") <= depth)
        edges = C.crawl_graph(done, links, depth)
        rows.append((depth, done.count(), G.nodes(done.select("url", F.lit("").alias("title")), edges).count(), edges.count()))
    return spark.createDataFrame(rows, "max_depth int, pages int, nodes int, edges int")


@query(
    f"""WITH r AS (SELECT DISTINCT {_u(_HOST)} AS host FROM documents), u AS (SELECT doc_id, url, {_u(_HOST)} AS host, {_u(_PATH)} AS path FROM documents)
SELECT doc_id FROM u WHERE NOT (host IN (SELECT host FROM r) AND (starts_with(path, '/search') OR starts_with(path, '/api/') AND host LIKE 'm.%'))"""
)
def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    hosts = docs.select(U.host_of(F.col("url")).alias("host")).distinct()
    extra = F.when(F.col("host").startswith("m."), "Disallow: /api/ # mobile\n").otherwise("Allow: /\n")
    robots = hosts.select("host", F.concat(F.lit("User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /search\n"), extra).alias("body"))
    return C.robots_allowed(docs.select("doc_id", "url"), C.robots_rules(robots, "corpusloom")).select("doc_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where(F.col("dst") != "")
    seq = F.unix_micros(F.col("seen_at").cast("timestamp"))
    return e.select(F.col("dst").alias("url"), (F.length("dst") % 7).alias("depth"), (F.length("src") % 5).alias("priority"), seq.alias("seq"), "src")


@query("SELECT dst AS url, min(length(dst) % 7) AS depth FROM edges WHERE dst <> '' AND dst NOT IN (SELECT src FROM edges WHERE src IS NOT NULL) GROUP BY dst")
def frontier_unseen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges")
    items = R.first_depth(_items(spark, d).select("url", "depth"))
    return R.unseen(items, e.select(F.col("src").alias("url"))).select("url", F.col("depth").cast("bigint").alias("depth"))


@query("SELECT dst AS url, min(epoch_us(seen_at)) AS seq FROM edges WHERE trim(dst) <> '' GROUP BY dst")
def frontier_push(spark: SparkSession, d: str) -> DataFrame:
    return R.push_once(_items(spark, d).select("url", "seq")).select("url", "seq")


@query("SELECT url, priority, depth FROM (SELECT DISTINCT dst AS url, length(src) % 5 AS priority, length(dst) % 7 AS depth FROM edges WHERE dst <> '') ORDER BY priority DESC, depth, url LIMIT 100")
def frontier_next(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).select("url", "priority", "depth").distinct().withColumn("seq", F.col("url"))
    return R.in_order(items, 100).select("url", F.col("priority").cast("bigint").alias("priority"), F.col("depth").cast("bigint").alias("depth"))


@query(f"SELECT host, count(*) AS pending FROM (SELECT {_u(_HOST, 'dst')} AS host FROM edges) WHERE host <> '' GROUP BY host")
def pending_per_host(spark: SparkSession, d: str) -> DataFrame:
    return R.pending_per_host(table(spark, d, "edges").select(F.col("dst").alias("url")))


_RULES = [("stiralastonan-notes.test", False, 1), ("*.test", False, 2), ("*.zumoziplanar-journal.test", True, 3), ("m.zumoziplanar-journal.test:80", False, 4), ("www.laskikridinem-digest.test", True, 5)]


@query(
    f"""SELECT DISTINCT {_u(_HOST)} AS host, CASE {_u(_HOST)} WHEN 'stiralastonan-notes.test' THEN false WHEN 'm.zumoziplanar-journal.test' THEN false WHEN 'www.laskikridinem-digest.test' THEN true
ELSE {_u(_HOST)} = 'zumoziplanar-journal.test' OR {_u(_HOST)} LIKE '%.zumoziplanar-journal.test' END AS allowed FROM documents"""
)
def host_rules(spark: SparkSession, d: str) -> DataFrame:
    hosts = documents(spark, d).select(U.host_of(F.col("url")).alias("host")).distinct()
    return L.host_allowed(hosts, spark.createDataFrame(_RULES, "pattern string, allow boolean, seq int"))


@query(
    """SELECT 'https://x.test/' || doc_id AS loc, CAST(NULL AS TIMESTAMP) AS lastmod, 'daily' AS changefreq, least(length(coalesce(lang, '')) / 4.0, 1.0)::DOUBLE AS priority FROM documents"""
)
def sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    p = (F.length(F.coalesce("lang", F.lit(""))) / 4.0).cast("string")
    xml = F.concat(F.lit("<urlset><url><loc> https://x.test/"), F.col("doc_id").cast("string"), F.lit("#a</loc><changefreq> Daily</changefreq><priority>"), p, F.lit("</priority></url><url><loc>ftp://x/y</loc></url></urlset>"))
    return L.sitemap_urls(table(spark, d, "documents").select(xml.alias("xml")))


# --- time, rates, headers -------------------------------------------------------------------------------------------------

_MINUTES = """WITH c AS (SELECT floor(epoch(ts))::BIGINT // 60 AS b, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY b),
s AS (SELECT unnest(range((SELECT min(b) FROM c), (SELECT max(b) FROM c) + 1)) AS b),
x AS (SELECT s.b, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY s.b) AS pages FROM s LEFT JOIN c ON c.b = s.b)
"""


@query(_MINUTES + "SELECT to_timestamp(b * 60)::TIMESTAMP AS t, CAST(pages AS BIGINT) AS pages, n / 60.0::DOUBLE AS rps FROM x ORDER BY b DESC LIMIT 120")
def throughput_last(spark: SparkSession, d: str) -> DataFrame:
    return S.throughput(table(spark, d, "events").select("ts"), "ts", 60)


@query(_MINUTES + "SELECT to_timestamp(b * 60)::TIMESTAMP AS t, CAST(pages AS BIGINT) AS pages, n / 60.0::DOUBLE AS rps FROM x")
def throughput_all(spark: SparkSession, d: str) -> DataFrame:
    return S.throughput(table(spark, d, "events").select("ts"), "ts", 60, None)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("arrival"))


_BUCKET = """WITH r AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
"""


@query(_BUCKET + "SELECT event_id AS seq, round((i + 1) * 30.0 + max(a - (i + 1) * 30.0) OVER (PARTITION BY user_id ORDER BY event_id), 3)::DOUBLE AS slot FROM r")
def polite_gaps(spark: SparkSession, d: str) -> DataFrame:
    return S.min_gap(_requests(spark, d), 30.0).select("seq", F.round("slot", 3).alias("slot"))


@query(
    _BUCKET
    + """SELECT event_id AS seq, round(greatest(a, coalesce(i * 500.0 + max(a - i * 500.0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)), 3)::DOUBLE AS release FROM r"""
)
def host_buckets(spark: SparkSession, d: str) -> DataFrame:
    return S.token_bucket(_requests(spark, d), 0.002, by=["host"]).select("seq", F.round("release", 3).alias("release"))


@query("SELECT event_id, least(0.2 * 2 ** (event_id % 6), 1.6)::DOUBLE AS wait, least(CASE WHEN event_id % 90 > 0 THEN event_id % 90 ELSE 8 END, 64)::BIGINT AS workers FROM events")
def backoff_and_limits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, d, "events").select("event_id", M.backoff(n % 6).alias("wait"), M.clamp(n % 90, 8, 64).cast("bigint").alias("workers"))


@query("SELECT event_id, s BETWEEN 200 AND 299 AS ok, s IN (408, 429) OR s >= 500 AS retryable, (s IN (408, 429) OR s >= 500 OR s = 0) AND NOT event_id % 4 >= 3 AS again FROM (SELECT event_id, [0, 200, 204, 301, 304, 404, 408, 429, 500, 503][1 + event_id % 10] AS s FROM events)")
def status_rules(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in (0, 200, 204, 301, 304, 404, 408, 429, 500, 503)])
    s = F.element_at(codes, (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", P.ok(s).alias("ok"), P.retryable(s).alias("retryable"), P.should_retry(s, F.col("event_id") % 4, F.lit(3)).alias("again"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/xml' ELSE 'image/png' END AS media, CASE WHEN event_id % 3 = 0 THEN 'utf-8' ELSE '' END AS charset,
event_id % 3 < 2 AS crawl, event_id % 7 * 10 AS age, event_id % 5 = 0 AS no_store, event_id % 3 = 0 AS page FROM events"""
)
def header_rules(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    ct = F.when(n % 3 == 0, " Text/HTML; charset=\"UTF8\"").when(n % 3 == 1, "application/xml").otherwise("image/png;q=1")
    cc = F.concat(F.when(n % 5 == 0, "Private, ").otherwise("public, "), F.lit("max-age="), (n % 7 * 10).cast("string"))
    return table(spark, d, "events").select(
        "event_id", P.media_type(ct).alias("media"), P.charset_of_header(ct).alias("charset"), P.may_crawl(ct).alias("crawl"), P.max_age(cc).alias("age"), P.no_store(cc).alias("no_store"), P.page_like(ct).alias("page")
    )


@query("SELECT doc_id, left(sha1(url), 8) AS short, left(sha1(url), 40) AS whole, strftime(fetched_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS clock FROM documents")
def ids_and_clock(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", M.short_id(F.col("url")).alias("short"), M.short_id(F.col("url"), 99).alias("whole"), M.local_time(F.col("fetched_at")).alias("clock"))


@query(
    """WITH o AS (SELECT url, max(length(title)) AS length, max(lang) AS etag FROM documents GROUP BY url),
n AS (SELECT base_url AS url, max(coalesce(length(text), 0)) AS length, max(left(title, 6)) AS etag FROM crawl_pages GROUP BY base_url)
SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.length > 0 THEN n.length ELSE coalesce(o.length, n.length) END AS length, CASE WHEN n.etag <> '' THEN n.etag ELSE coalesce(o.etag, n.etag) END AS etag
FROM o FULL JOIN n ON o.url = n.url"""
)
def merged_meta(spark: SparkSession, d: str) -> DataFrame:
    docs, pages = table(spark, d, "documents"), table(spark, d, "crawl_pages")
    old = docs.groupBy("url").agg(F.max(F.length("title")).cast("bigint").alias("length"), F.max("lang").alias("etag"))
    size = F.coalesce(F.length("text"), F.lit(0))
    new = pages.groupBy(F.col("base_url").alias("url")).agg(F.max(size).cast("bigint").alias("length"), F.max(F.left("title", F.lit(6))).alias("etag"))
    return L.merge_meta(old, new)


@query("SELECT term, freq, freq / greatest(1, max(freq) OVER ()) AS bar FROM (" + _POSTINGS + "SELECT term, CAST(sum(freq) AS BIGINT) AS freq FROM post GROUP BY term ORDER BY freq DESC, term LIMIT 18)")
def keyword_bars(spark: SparkSession, d: str) -> DataFrame:
    return S.scaled(I.top_keywords(I.term_freq(index_of(spark, d)), 18), "freq", "bar")


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'url': url}) AS json FROM documents")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.to_json(F.struct("doc_id", "url")).cast("string").alias("json"))


# --- views ----------------------------------------------------------------------------------------------------------------

_HINT = "regexp_extract(coalesce(title, ''), '^([^\\s·]*)', 1)"


@query(f"SELECT doc_id, {_HINT} AS hint, regexp_matches(lower(trim(title)), '^https?://') AS seed FROM documents WHERE title IS NOT NULL AND trim(title) <> '' AND NOT contains(title, chr(10))")
def search_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).where((F.trim("title") != "") & ~F.col("title").contains("\n"))
    return rows.select("doc_id", V.search_hint(F.col("title")).alias("hint"), V.valid_seeds(F.col("title")).alias("seed"))


@query(_EDGES + _ENDS + "SELECT id, round(3 + least(degree, 8) * 0.6, 4)::DOUBLE AS radius FROM ends")
def node_radii(spark: SparkSession, d: str) -> DataFrame:
    nodes = G.degree(G.simple_edges(table(spark, d, "edges")))
    return nodes.select("id", F.round(V.node_radius(F.col("degree")), 4).cast("double").alias("radius"))


@query(
    _MINUTES
    + """, k AS (SELECT b, n / 60.0 AS rps FROM x ORDER BY b DESC LIMIT 40)
SELECT to_timestamp(b * 60)::TIMESTAMP AS t, round((row_number() OVER (ORDER BY b) - 1) / greatest(count(*) OVER () - 1, 1) * 100.0, 6)::DOUBLE AS x,
  round(36 - rps / greatest(max(rps) OVER (), 1) * 32, 6)::DOUBLE AS y FROM k"""
)
def rate_curve(spark: SparkSession, d: str) -> DataFrame:
    c = V.curve(S.throughput(table(spark, d, "events").select("ts"), "ts", 60), 40, 36, 32)
    return c.select("t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
