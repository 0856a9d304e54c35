"""A crawl as a fixpoint: rules of admission, breadth-first levels, and a generated site to test them on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.http import ok, page_like
from corpusloom.functions.url import host_of, path_of, with_keys
from corpusloom.operators.scale import hot_keys, is_small, salted_join, spread
from corpusloom.sources.tables import stored

SITE_PAGES = 120
#: Characters of a robots file that are read unless another limit is given; None reads all.
ROBOTS_LIMIT = 64 * 1024


def robots_rules(robots: DataFrame, agent: str, limit: int | None = ROBOTS_LIMIT) -> DataFrame:
    """(host, prefix): disallowed prefixes of robots files (host, body) that hold for `agent`; of their first `limit` characters.

    The last User-agent line before a rule decides; `*` and a name that begins the agent's apply together.
    """
    body = F.col("body") if limit is None else F.left(F.col("body"), F.lit(limit))
    lines = robots.select("host", F.posexplode(F.split(body, r"\r?\n")).alias("no", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    pairs = lines.select("host", "no", F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"))
    order = Window.partitionBy("host").orderBy("no")
    who = F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(order)
    mine = pairs.withColumn("who", who).where((F.col("key") == "disallow") & (F.col("value") != ""))
    wanted = F.lit(agent.strip().lower())
    return mine.where((F.col("who") == "*") | (F.lit(bool(agent.strip())) & wanted.startswith(F.col("who")))).select("host", F.col("value").alias("prefix")).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose path begins with no rule of their host: an anti-join on the host with the prefix as a further condition.

    Rules are gathered per host first, so a host with many pages meets one array instead of a product of rows; rules of too many
    hosts to send are joined with the rows of large hosts spread over salted tasks.
    """
    per_host = stored(rules.groupBy(F.col("host").alias("__host")).agg(F.collect_set("prefix").alias("__rules")), "rules")
    path = F.when(path_of(F.col(url)) == "", "/").otherwise(path_of(F.col(url)))
    rows = urls.withColumn("__host", host_of(F.col(url))).withColumn("__path", path)
    joined = rows.join(F.broadcast(per_host), "__host", "left") if is_small(per_host) else salted_join(rows, per_host, "__host", url, hot_keys(rows, "__host"))
    free = ~F.coalesce(F.exists("__rules", lambda p: F.col("__path").startswith(p)), F.lit(False))
    return joined.where(free).drop("__host", "__path", "__rules")


def within(url: Column, base: str) -> Column:
    """Whether a page belongs to the site under `base`."""
    return F.startswith(url, F.lit(base))


def fetchable(pages: DataFrame) -> DataFrame:
    """Pages that a fetch would keep: where there is a `status` it is one of success, where there is a `content_type` a page's."""
    if "status" in pages.columns:
        pages = pages.where(ok(F.col("status")))
    return pages.where(page_like(F.col("content_type"))) if "content_type" in pages.columns else pages


def crawl(
    seeds: DataFrame,
    links: DataFrame,
    pages: DataFrame | None = None,
    rules: DataFrame | None = None,
    max_depth: int = 4,
    max_pages: int | None = None,
    known: DataFrame | None = None,
    base: str | None = None,
    keyed: bool = False,
) -> DataFrame:
    """(url, depth) of the crawled pages: levels of a breadth-first walk from `seeds` (url) over `links` (src, dst).

    Pages are known by their crawl key, so an address is walked once however it is spelled, and what has no key is left out. All
    addresses are turned into keys once before the walk, unless they are `keyed`. Only `pages` (url, and perhaps status and
    content_type) exist, all if None. A page keeps its least depth, pages of `known` are not visited again, with `base` only
    addresses under it are, and with `max_pages` the first ones by (depth, url) are kept. Each level is written to the shared
    folder, so plans stay short and a lost executor costs one level.
    """
    spark = seeds.sparkSession
    if not keyed:
        seeds, links = with_keys(seeds, "url"), stored(with_keys(spread(links.select("src", "dst")), "src", "dst"), "keyed-links")
        pages = None if pages is None else stored(with_keys(fetchable(pages).select("url"), "url").distinct(), "keyed-pages")
        known = None if known is None else stored(with_keys(known.select("url"), "url").distinct(), "keyed-known")
    elif pages is not None:
        pages = fetchable(pages).select("url").distinct()
    frontier = seeds.select("url").where(F.col("url").isNotNull()).distinct()
    done = spark.createDataFrame([], "url string, depth int")
    total = 0
    for depth in range(max_depth + 1):
        level = frontier if base is None else frontier.where(within(F.col("url"), base))
        if pages is not None:
            level = level.join(pages, "url", "left_semi")
        if known is not None:
            level = level.join(known.select("url"), "url", "left_anti")
        if rules is not None:
            level = robots_allowed(level, rules)
        level = level.join(done.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"))
        if max_pages is not None:
            level = level.orderBy("url").limit(max(max_pages - total, 0))
        level = stored(level, "level")
        n = level.count()
        total += n
        if not n:
            break
        done = done.unionByName(level)
        if depth == max_depth or max_pages is not None and total >= max_pages:
            break
        frontier = links.join(level.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).where(F.col("url") != "").distinct()
    return done


def crawl_graph(done: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """Simple edges that a crawl records: from every page above the last level, also to pages never fetched."""
    above = done.where(F.col("depth") < max_depth).select(F.col("url").alias("src"))
    return links.join(above, "src", "left_semi").where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def site(spark: SparkSession, base: str = "http://site.test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages (url, title, body), links (src, dst), robots (host, body)) of a generated site.

    A hub links to pages 0 to 11 and to a page that robots must not fetch; page n links to n + 1 and n + 7 modulo 120 and back
    to the hub. Titles and bodies are numbers spelled out; only the links matter.
    """
    n = F.col("id")
    url = lambda i: F.concat(F.lit(f"{base}/page/"), i.cast("string"), F.lit(".html"))
    ids = spark.range(SITE_PAGES)
    figures = F.concat_ws(" ", F.transform(F.split(n.cast("string"), ""), lambda x: F.element_at(F.array(*[F.lit(w) for w in "nil one two three four five six seven eight nine".split()]), (x.cast("int") + 1))))
    hub, hidden = f"{base}/index.html", f"{base}/secret/hidden.html"
    pages = ids.select(url(n).alias("url"), F.concat(F.lit("Leaf "), figures).alias("title"), F.concat(F.lit("This leaf is number "), figures).alias("body"))
    pages = pages.unionByName(spark.createDataFrame([(hub, "Trunk", "All leaves grow here"), (hidden, "Root", "below the ground")], "url string, title string, body string"))
    links = ids.select(url(n).alias("src"), F.explode(F.array(url((n + 1) % SITE_PAGES), url((n + 7) % SITE_PAGES), F.lit(hub))).alias("dst"))
    first = ids.where(n < 12).select(F.lit(hub).alias("src"), url(n).alias("dst"))
    links = links.unionByName(first).unionByName(spark.createDataFrame([(hub, hidden)], "src string, dst string"))
    robots = spark.createDataFrame([("site.test", "User-agent: *\nDisallow: /secret\n")], "host string, body string")
    return pages, links, robots
