"""Addresses: canonical forms, hosts, origins and rules on them.

Column expressions cover addresses without escapes, which is nearly all of a crawl; `normalize_url` and `canonical_url` are exact
for every address and run in Arrow batches.
"""

from __future__ import annotations

import ipaddress
import posixpath
import re
from functools import reduce
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: paths with these endings are not pages
SKIPPED_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "svg", "css", "js", "ico", "woff", "woff2", "ttf", "mp4", "mp3", "zip", "pdf")


def _part(url: Column, group: int) -> Column:
    """scheme, authority, path, query and fragment by the generic pattern of addresses."""
    return F.regexp_extract(F.trim(url), r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port in lower case, without user."""
    return F.lower(F.regexp_replace(_part(url, 2), "^[^@]*@", ""))


def host_of(url: Column) -> Column:
    """Host in lower case; empty if there is none. Brackets of an IPv6 host are left out."""
    return F.regexp_replace(F.regexp_replace(authority(url), r":\d*$", ""), r"^\[|\]$", "")


def path_of(url: Column) -> Column:
    return _part(url, 3)


def without_default_port(auth: Column, of_scheme: Column | None = None) -> Column:
    """Drop :80 for http and :443 for https; without a scheme, drop both."""
    if of_scheme is None:
        return F.regexp_replace(auth, ":(?:80|443)$", "")
    return F.when(of_scheme == "http", F.regexp_replace(auth, ":80$", "")).when(of_scheme == "https", F.regexp_replace(auth, ":443$", "")).otherwise(auth)


def default_port(of_scheme: Column) -> Column:
    return F.when(F.lower(of_scheme) == "http", "80").when(F.lower(of_scheme) == "https", "443").otherwise("")


def origin(url: Column) -> Column:
    """scheme://host without :80 and :443; empty without scheme or host."""
    return F.when((scheme(url) != "") & (authority(url) != ""), F.concat(scheme(url), F.lit("://"), without_default_port(authority(url)))).otherwise("")


def collapse_path(path: Column, keep_slash: bool = True) -> Column:
    """Path without empty, . and .. parts; a slash at the end stays if `keep_slash`."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda out, p: F.when((p == "") | (p == "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)),
    )
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"))
    return F.when(path.endswith("/") & (F.size(parts) > 0), F.concat(joined, F.lit("/"))).otherwise(joined) if keep_slash else joined


def _sorted_query(url: Column) -> Column:
    """?query with its parameters sorted by key and value, all of them kept; empty without any."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    full = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    keyed = F.array_sort(F.transform(full, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p"))))
    return F.when(F.size(full) > 0, F.concat(F.lit("?"), F.array_join(keyed["p"], "&"))).otherwise("")


def normalize_plain(url: Column) -> Column:
    """Crawl key of an address without escapes: http(s) only, host in lower case, default port, user and fragment dropped, path
    collapsed without a slash at its end, parameters sorted. Null for what is no such address."""
    ok = scheme(url).isin("http", "https") & (host_of(url) != "")
    full = F.concat(scheme(url), F.lit("://"), without_default_port(authority(url), scheme(url)), collapse_path(path_of(url), False), _sorted_query(url))
    return F.when(ok, full)


def canonical_plain(url: Column) -> Column:
    """Canonical form of an address without escapes: any scheme, :80 and :443 dropped, a slash at the path's end kept."""
    full = F.concat(scheme(url), F.lit("://"), without_default_port(authority(url)), collapse_path(F.when(path_of(url) == "", "/").otherwise(path_of(url))), _sorted_query(url))
    return F.when((scheme(url) != "") & (authority(url) != ""), full)


_SAFE = "/:@!$&'()*+,;=~-._"


def normalize_one(url: str | None) -> str | None:
    """The crawl key of any address; escapes are made the same way whether they were there before or not."""
    try:
        u = urlsplit((url or "").strip())
        port = u.port
        host = (u.hostname or "").lower()
    except ValueError:
        return None
    if u.scheme not in ("http", "https") or not host:
        return None
    host = f"[{host}]" if ":" in host else host
    if port is not None and (u.scheme, port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    path = posixpath.normpath("/" + quote(unquote(u.path), safe=_SAFE).lstrip("/"))
    query = urlencode(sorted(parse_qsl(u.query, keep_blank_values=True)))
    return f"{u.scheme}://{host}{path}" + (f"?{query}" if query else "")


def canonical_one(url: str | None) -> str | None:
    """The canonical form of any address; user and a slash at the end are kept, parameters of one key keep their order."""
    try:
        u = urlsplit((url or "").strip())
    except ValueError:
        return None
    if not u.scheme or not u.netloc:
        return None
    user, at, host = u.netloc.rpartition("@")
    host = re.sub(r":(?:80|443)$", "", host.lower())
    parts: list[str] = []
    for p in (u.path or "/").split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    path = "/" + "/".join(parts) + ("/" if u.path.endswith("/") and parts else "")
    query = urlencode(sorted(parse_qsl(u.query, keep_blank_values=True), key=lambda kv: kv[0]))
    return f"{u.scheme.lower()}://{user}{at}{host}{quote(unquote(path), safe=_SAFE)}" + (f"?{query}" if query else "")


def _batched(one):
    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        return urls.map(one)

    return run


def normalize_url(url: Column) -> Column:
    return _batched(normalize_one)(url)


def canonical_url(url: Column) -> Column:
    return _batched(canonical_one)(url)


#: An address in which nothing needs escaping or resolving beyond what the column expression does.
_PLAIN = r"^(?i:https?)://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9/._~-]*)?(?:\?[A-Za-z0-9._~&=-]*)?(?:#[A-Za-z0-9/._~&=?-]*)?$"


#: An address that is its own crawl key.
_KEY_FORM = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*/(?:[A-Za-z0-9_~-][A-Za-z0-9._~-]*(?:/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)*)?$"


def with_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with the addresses in `columns` turned into their crawl keys; rows with an address that has none are left out.

    Rows of plain addresses, nearly all, stay in the JVM, and there addresses that are keys already are left as they are; only the
    others go through Arrow batches.
    """
    plain = reduce(lambda x, y: x & y, [F.coalesce(F.col(c).rlike(_PLAIN), F.lit(False)) for c in columns])
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns])
    one = rows.where(plain).withColumns({c: F.when(F.col(c).rlike(_KEY_FORM), F.col(c)).otherwise(normalize_plain(F.col(c))) for c in columns})
    other = rows.where(~plain & known).withColumns({c: normalize_url(F.col(c)) for c in columns})
    return one.unionByName(other).where(known)


def strip_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def should_skip(url: Column) -> Column:
    """Not http(s), without host, or with an ending that is no page's. Null counts as unreadable."""
    bad = ~scheme(url).isin("http", "https") | (authority(url) == "") | F.lower(path_of(url)).rlike(rf"\.(?:{'|'.join(SKIPPED_ENDINGS)})$")
    return F.coalesce(bad, F.lit(True))


def same_host(a: Column, b: Column) -> Column:
    return F.coalesce(host_of(a) == host_of(b), F.lit(False))


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce((origin(a) != "") & (origin(a) == origin(b)), F.lit(False))


def norm_host(host: Column) -> Column:
    """Lower case, without port and without one dot at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r":\d*$", ""), r"\.$", "")


def clean_loc(url: Column) -> Column:
    """Absolute http(s) address without fragment; empty for others."""
    ok = scheme(url).isin("http", "https") & (authority(url) != "")
    return F.when(ok, strip_fragment(F.trim(url))).otherwise("")


def private_host(host: Column) -> Column:
    """Local names and private, loopback, link-local or unspecified IPv4 addresses; IPv6 through `private_host_any`."""
    h = norm_host(host)
    return (h == "localhost") | h.endswith(".localhost") | h.rlike(r"^(?:127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|169\.254\.\d+\.\d+|0\.0\.0\.0)$")


def private_one(host: str | None) -> bool:
    h = (host or "").strip().lower()
    h = h[1:].partition("]")[0] if h.startswith("[") else h if h.count(":") > 1 else h.partition(":")[0]
    h = re.sub(r"\.$", "", h)
    if h == "localhost" or h.endswith(".localhost"):
        return True
    try:
        ip = ipaddress.ip_address(h)
    except ValueError:
        return False
    if ip.version == 6:
        return ip.is_loopback or ip.is_link_local or ip.is_unspecified or ip in ipaddress.ip_network("fc00::/7")
    return ip.is_loopback or ip.is_link_local or ip.is_unspecified or any(ip in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))


def private_host_any(host: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(hosts: pd.Series) -> pd.Series:
        return hosts.map(private_one)

    return run(host)
