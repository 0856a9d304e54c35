"""HTML as text: regular expressions for whole pages in the JVM, and a tree walk where order and nesting matter."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: entities that are resolved, the ampersand's last
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
# fixed values: elements whose text is not shown
SKIPPED = ("script", "style", "noscript", "nav", "footer", "svg")
#: Characters of a page that are parsed unless another limit is given; None reads all.
PARSE_LIMIT = 2 << 20


def unescape(text: Column) -> Column:
    """Resolve seven entities, each once."""
    for raw, plain in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(plain))
    return text


def strip_tags(page: Column) -> Column:
    """Visible text: without scripts, styles and tags, entities resolved, blanks collapsed."""
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)<[^>]+>"):
        page = F.regexp_replace(page, pattern, " ")
    return F.trim(F.regexp_replace(unescape(page), r"[ \t\r\n\f]+", " "))


def title_of(page: Column) -> Column:
    """Text of the first title element; empty without one."""
    return F.trim(unescape(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1)))


def preview(page: Column, size: int) -> Column:
    """The first `size` characters of the visible text and an ellipsis; the whole if it is no longer, or for no size."""
    text = strip_tags(page)
    if size <= 0:
        return text
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.trim(F.left(text, F.lit(size))), F.lit("…")))


def word_count(page: Column) -> Column:
    """Runs without blanks and punctuation; symbols belong to words."""
    return F.size(F.regexp_extract_all(strip_tags(page), F.lit(r"([^\s\u0085\p{Z}\p{P}]+)"), F.lit(1)))


def has_lang(page: Column, lang: str) -> Column:
    """Whether an attribute lang begins with the language."""
    wanted = lang.strip().lower()
    if not wanted:
        return F.lit(False)
    low = F.lower(page)
    return low.contains(f'lang="{wanted}') | low.contains(f"lang='{wanted}")


# fixed values: elements without content, and those that an end tag of an ordinary element does not reach beyond
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html li "
    "main menu nav noscript ol p pre section summary table tbody td template tfoot th thead title tr ul script style svg".split()
)
SCOPES = frozenset("table td th caption template object applet marquee html".split())
CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}


class _Walk(HTMLParser):
    """Title, links and text in document order; skipped elements give links but no text.

    Open elements are kept on a stack. The end tag of a block ends all that is still open inside it, whatever forgot to end; one of
    an ordinary element reaches only up to the next block, and none out of a table's cell. A new cell or row ends the last one.
    """

    def __init__(self, base: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.links, self.texts = base, "", [], []
        self.open: list[str] = []
        self.hidden = 0
        self.in_title = False
        self.parts: list[str] = []

    def _pop_to(self, depth: int) -> None:
        self.hidden -= sum(t in SKIPPED for t in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and not {"script", "style", "noscript"} & set(self.open):
            href = next((v for k, v in attrs if k == "href"), None)
            link = resolve(self.base, href) if href else ""
            if link:
                self.links.append(link)
        if tag in VOID:
            return
        for at in range(len(self.open) - 1, -1, -1) if tag in CELLS else ():
            if self.open[at] == "table":
                break
            if self.open[at] in CELLS[tag]:
                self._pop_to(at)
                break
        self.open.append(tag)
        self.hidden += tag in SKIPPED
        if tag == "title":
            self.in_title, self.parts = True, []

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if "svg" in self.open and tag not in VOID:  # only there a slash ends an element
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.in_title:
            self.in_title = False
            self.title = self.title or "".join(self.parts).strip()
        if tag in ("html", "body"):
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at] == tag:
                self._pop_to(at)
                return
            if self.open[at] in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") or self.open[at] == "table":
                return
            if tag not in BLOCKS and self.open[at] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.parts.append(data)
        if not self.hidden and data.strip():
            self.texts.append(data.strip())


def resolve(base: str | None, href: str) -> str:
    """Absolute address of a link; empty for empty, script and mail links and for what cannot be read."""
    href = href.strip()
    if not href or href.startswith(("javascript:", "mailto:")):
        return ""
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return ""


def parse(page: str | None, base: str | None, limit: int | None = PARSE_LIMIT) -> tuple[str, str, list[str]]:
    """(title, text, links) of one page, of its first `limit` characters."""
    walk = _Walk(base)
    walk.feed((page or "")[:limit])
    walk.close()
    return walk.title, re.sub(r"\s+", " ", " ".join(walk.texts)).strip(), walk.links


def parse_html(page: Column, base: Column, limit: int | None = PARSE_LIMIT) -> Column:
    """STRUCT<title, text, links> of every page, in Arrow batches; a nested tree is beyond regular expressions."""

    @F.pandas_udf("title string, text string, links array<string>")
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(p, b, limit) for p, b in zip(pages, bases, strict=True)], columns=["title", "text", "links"])

    return run(page, base)
