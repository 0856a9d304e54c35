"""Media types, character sets and response headers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: media type of each ending
TYPES = {
    "html": "text/html",
    "htm": "text/html",
    "xml": "application/xml",
    "txt": "text/plain",
    "json": "application/json",
    "css": "text/css",
    "js": "application/javascript",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "pdf": "application/pdf",
    "zip": "application/zip",
}
# fixed values: spellings of character sets
CHARSETS = {
    "utf-8": ("utf8", "utf-8", "unicode-1-1-utf-8"),
    "gbk": ("gbk", "gb2312", "gb-2312", "windows-936"),
    "gb18030": ("gb18030",),
    "big5": ("big5", "big-5", "cn-big5"),
    "iso-8859-1": ("iso-8859-1", "latin1", "latin-1"),
    "ascii": ("us-ascii", "ascii"),
}


def media_type(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(F.trim(content_type), F.lit(";"), F.lit(1)))), F.lit(""))


def charset_param(content_type: Column) -> Column:
    """The last charset parameter in lower case, without quotes; empty without one."""
    params = F.filter(F.split(F.coalesce(content_type, F.lit("")), ";"), lambda p, i: i > 0)
    found = F.filter(F.transform(params, lambda p: F.lower(F.trim(p))), lambda p: p.startswith("charset="))
    return F.coalesce(F.trim(F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"""^charset=["' ]*|["' ]+$""", "")), F.lit(""))


def is_html(content_type: Column) -> Column:
    return media_type(content_type).isin("text/html", "application/xhtml+xml")


def is_xml(content_type: Column) -> Column:
    media = media_type(content_type)
    return media.isin("application/xml", "text/xml") | media.endswith("+xml")


def is_text(content_type: Column) -> Column:
    media = media_type(content_type)
    return media.startswith("text/") | is_html(content_type) | is_xml(content_type) | (media == "application/json")


def is_binary(content_type: Column) -> Column:
    return (F.coalesce(content_type, F.lit("")) != "") & ~is_text(content_type)


def may_crawl(content_type: Column) -> Column:
    """No type at all, HTML, XML or plain text."""
    media = media_type(content_type)
    return (media == "") | is_html(content_type) | is_xml(content_type) | (media == "text/plain")


def page_like(content_type: Column) -> Column:
    """The rule while crawling: no type, or one that contains html or text/plain."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return (low == "") | low.contains("html") | low.contains("text/plain")


def type_of_path(path: Column) -> Column:
    """Media type by the ending of the last part; empty for unknown ones. A query and a fragment do not count."""
    bare = F.split_part(F.split_part(path, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    ending = F.lower(F.regexp_extract(bare, r"\.([^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ending), F.lit(""))


def normalize_charset(name: Column) -> Column:
    low = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))
    out = None
    for to, spellings in CHARSETS.items():
        out = F.when(low.isin(*spellings), to) if out is None else out.when(low.isin(*spellings), to)
    return out.otherwise(low)


def charset_of_header(content_type: Column) -> Column:
    """The first charset parameter, normalised; empty without one."""
    parts = F.transform(F.split(F.lower(F.coalesce(content_type, F.lit(""))), ";"), lambda p: F.trim(p))
    first = F.try_element_at(F.filter(parts, lambda p: p.startswith("charset=")), F.lit(1))
    return F.coalesce(normalize_charset(F.regexp_replace(first, """^charset=["']*|["']+$""", "")), F.lit(""))


#: Characters of a page that are searched for its character set unless another limit is given; None searches all.
HEAD_LIMIT = 4096


def charset_of_page(page: Column, limit: int | None = HEAD_LIMIT) -> Column:
    """What follows the first charset= in the first `limit` characters; empty without one."""
    head = F.lower(page if limit is None else F.left(page, F.lit(limit)))
    return F.coalesce(normalize_charset(F.regexp_extract(head, """charset=[ \\t"']*([^"' ;>]*)""", 1)), F.lit(""))


def looks_utf8(body: Column) -> Column:
    return (F.hex(F.substring(body, 1, 3)) == "EFBBBF") | F.is_valid_utf8(body.cast("string"))


def detect_charset(page: Column, content_type: Column) -> Column:
    """Header, then page, then UTF-8 if the bytes are valid."""
    return F.coalesce(F.nullif(charset_of_header(content_type), F.lit("")), F.nullif(charset_of_page(page), F.lit("")), F.when(F.is_valid_utf8(page), "utf-8"), F.lit(""))


def decoded(body: Column, charset: Column | None = None) -> Column:
    """The text of a body: its bytes as UTF-8 whatever the character set is said to be, invalid ones replaced."""
    return F.make_valid_utf8(body.cast("string"))


def sniff_html(page: Column) -> Column:
    head = F.left(F.trim(F.lower(page)), F.lit(256))
    return head.contains("<html") | head.contains("<!doctype html")


def head_bytes(body: Column, limit: int = 0) -> Column:
    """The first bytes; 1 MiB for no limit."""
    return F.substring(body, 1, limit if limit > 0 else 1 << 20)


def meta_of_headers(headers: Column, status: Column) -> Column:
    """STRUCT of what the headers (a map with lower-case names) say; missing ones are null."""
    get = lambda name: F.try_element_at(headers, F.lit(name))
    size = get("content-length").try_cast("bigint")
    return F.struct(
        status.alias("status"),
        get("content-type").alias("content_type"),
        F.when(size >= 0, size).alias("length"),
        F.regexp_replace(get("etag"), '^"+|"+$', "").alias("etag"),
        F.try_to_timestamp(F.regexp_replace(get("last-modified"), r"^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'")).alias("last_modified"),
        get("cache-control").alias("cache_control"),
        F.trim(get("location")).alias("redirect"),
    )


def ok(status: Column) -> Column:
    return status.between(200, 299)


def redirected(status: Column, location: Column) -> Column:
    return status.between(300, 399) & (F.coalesce(location, F.lit("")) != "")


def not_modified(status: Column) -> Column:
    return status == 304


def retryable(status: Column) -> Column:
    return status.isin(408, 429) | (status >= 500)


def should_retry(status: Column, attempt: Column, most: Column) -> Column:
    """408, 429, 500 and above, or no answer (0), unless `most` attempts (if positive) were made."""
    return ~((most > 0) & (attempt >= most)) & (retryable(status) | (status == 0))


def no_store(cache_control: Column) -> Column:
    low = F.lower(F.coalesce(cache_control, F.lit("")))
    return low.contains("no-store") | low.contains("private")


def max_age(cache_control: Column) -> Column:
    """Seconds of the first positive max-age; 0 without one."""
    parts = F.transform(F.split(F.lower(F.coalesce(cache_control, F.lit(""))), ","), lambda p: F.trim(p))
    ages = F.transform(F.filter(parts, lambda p: p.startswith("max-age=")), lambda p: F.substring(p, F.lit(9), F.length(p)).try_cast("bigint"))
    return F.coalesce(F.try_element_at(F.filter(ages, lambda a: a > 0), F.lit(1)), F.lit(0).cast("bigint"))


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """If-None-Match and If-Modified-Since for what is known."""
    date = F.date_format(last_modified, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return F.map_filter(
        F.create_map(F.lit("If-None-Match"), F.when(etag != "", F.concat(F.lit('"'), etag, F.lit('"'))), F.lit("If-Modified-Since"), date), lambda _, v: v.isNotNull()
    )
