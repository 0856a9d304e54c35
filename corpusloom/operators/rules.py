"""Host rules, sitemaps and merged fetch metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.url import clean_loc, norm_host
from corpusloom.operators.scale import sized

#: Characters of a sitemap that are read unless another limit is given; None reads all.
SITEMAP_LIMIT = 4 << 20
# fixed values: how often a page says it changes
FREQUENCIES = ("", "always", "hourly", "daily", "weekly", "monthly", "yearly", "never")


def effective_rules(rules: DataFrame) -> DataFrame:
    """(host, exact, allow, seq): the last rule of every pattern (pattern, allow, seq); `*.name` holds for name and below."""
    host = norm_host(F.col("pattern"))
    rows = rules.select(F.regexp_replace(host, r"^\*\.", "").alias("host"), (~host.startswith("*.")).alias("exact"), "allow", "seq").where(F.col("host") != "")
    return rows.groupBy("host", "exact").agg(F.max_by("allow", "seq").alias("allow"), F.max("seq").alias("seq"))


def host_allowed(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Hosts with `allowed`: an exact rule wins, otherwise the last added suffix rule that fits, otherwise yes.

    Every host is taken apart into itself and the names above it, a handful of rows; equal names meet in a hash join, which
    takes the place of a product with all rules.
    """
    names = hosts.select(host).distinct().withColumn("__n", norm_host(F.col(host)))
    parts = F.split("__n", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = names.select(host, "__n", F.explode(above).alias("__a"))
    eff = effective_rules(rules).select(F.col("host").alias("__a"), "exact", "allow", "seq")
    hit = rows.join(sized(eff), "__a").where(~F.col("exact") | (F.col("__a") == F.col("__n")))
    best = hit.groupBy(host).agg(F.max_by("allow", F.struct("exact", "seq")).alias("__allow"))
    return hosts.join(best, host, "left").withColumn("allowed", F.coalesce("__allow", F.lit(True))).drop("__allow")


def sitemap_urls_of(maps: DataFrame, *keep: str, xml: str = "xml", limit: int | None = SITEMAP_LIMIT) -> DataFrame:
    """(loc, lastmod, changefreq, priority) of all entries of sitemap documents with a readable address, after the columns `keep`."""
    text = F.col(xml) if limit is None else F.left(F.col(xml), F.lit(limit))
    get = lambda tag: F.trim(F.regexp_extract("entry", f"(?s)<{tag}>(.*?)</{tag}>", 1))
    rows = maps.where(~text.contains("<sitemapindex")).select(*keep, F.explode(F.regexp_extract_all(text, F.lit("(?s)<url>(.*?)</url>"), F.lit(1))).alias("entry"))
    date = get("lastmod")
    when = F.coalesce(F.when(date.rlike(r"T\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(date)), F.when(date.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(date)))
    loc = clean_loc(F.replace(get("loc"), F.lit("&amp;"), F.lit("&")))
    priority = F.coalesce(get("priority").try_cast("double"), F.lit(0.0))
    return rows.select(*keep, loc.alias("loc"), when.alias("lastmod"), F.lower(get("changefreq")).alias("changefreq"), F.greatest(F.least(priority, F.lit(1.0)), F.lit(0.0)).alias("priority")).where(F.col("loc") != "")


def sitemap_urls(maps: DataFrame, xml: str = "xml", limit: int | None = SITEMAP_LIMIT) -> DataFrame:
    return sitemap_urls_of(maps, xml=xml, limit=limit)


def sitemap_children(maps: DataFrame, xml: str = "xml", limit: int | None = SITEMAP_LIMIT) -> DataFrame:
    """(loc) of the maps that index documents point to."""
    text = F.col(xml) if limit is None else F.left(F.col(xml), F.lit(limit))
    locs = F.regexp_extract_all(text, F.lit("(?s)<sitemap>.*?<loc>(.*?)</loc>"), F.lit(1))
    rows = maps.where(text.contains("<sitemapindex")).select(F.explode(locs).alias("loc"))
    return rows.select(clean_loc(F.col("loc")).alias("loc")).where(F.col("loc") != "")


def with_prefix(rows: DataFrame, prefix: str, column: str = "loc") -> DataFrame:
    return rows.where(F.startswith(F.col(column), F.lit(prefix.strip())))


def valid_frequency(freq: Column) -> Column:
    return F.lower(F.trim(freq)).isin(*FREQUENCIES)


def merge_meta(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Field by field what is known newer: null, empty and zero in `new` keep the value of `old`; one shuffle on the key."""
    fields = [c for c in old.columns if c != key]
    both = old.select(key, *[F.col(c).alias(f"__o_{c}") for c in fields]).join(new.select(key, *[F.col(c).alias(f"__n_{c}") for c in fields]), key, "full_outer")
    kind = dict(old.dtypes)

    def pick(c: str) -> Column:
        n = F.col(f"__n_{c}")
        known = n.isNotNull() & ((n != "") if kind[c] == "string" else (n > 0) if kind[c] in ("int", "bigint", "double") else F.lit(True))
        return F.when(known, n).otherwise(F.coalesce(f"__o_{c}", f"__n_{c}")).alias(c)

    return both.select(key, *[pick(c) for c in fields])
