"""Mixed Latin and Han tokenization, highlighting and snippets as Column expressions."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that are not indexed, looked up after stemming
STOP_WORDS = (
    "a an the and or of to in for on is are was be as at by this that with from "
    "it its we you your not but if can will has have had"
).split()


def lower(text: Column) -> Column:
    """Lower case in which a dotted capital I becomes a plain i."""
    return F.lower(F.translate(text, "İ", "i"))


def stem(word: Column) -> Column:
    """Cut one ending: ies (y is put), ing, ed or s; short words and those in ss stay."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.expr("''"), F.left(word, n - 3), F.lit("y")))
        .when((n > 5) & word.endswith("ing"), F.left(word, n - 3))
        .when((n > 4) & word.endswith("ed"), F.left(word, n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )


def _bigrams(run: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.length(run) > 1, pairs).otherwise(F.array(run))


def tokenize(text: Column) -> Column:
    """Tokens in order: pairs of neighbouring Han characters first, then stemmed words of Latin letters and figures.

    Null gives no tokens.
    """
    low = F.coalesce(lower(text), F.lit(""))
    han = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"(\p{IsHan}+)"), F.lit(1)), _bigrams))
    words = F.transform(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), stem)
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    return F.concat(han, kept)


def query_terms(text: Column) -> Column:
    """Distinct tokens in order of first use."""
    return F.array_distinct(tokenize(text))


_HAN_RUN = re.compile(r"[⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎\U00020000-\U000323af]+")
_LATIN_RUN = re.compile("[a-z0-9]+")
_STOPPED = frozenset(STOP_WORDS)


class _Stems(dict):
    """The token of each Latin word, empty for those that are not indexed; made when first asked for."""

    def __missing__(self, word: str) -> str:
        w = word
        if len(w) > 4 and w.endswith("ies"):
            w = w[:-3] + "y"
        elif len(w) > 5 and w.endswith("ing"):
            w = w[:-3]
        elif len(w) > 4 and w.endswith("ed"):
            w = w[:-2]
        elif len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        w = w if len(w) >= 2 and w not in _STOPPED else ""
        if len(self) > 1_000_000:  # bounded in long running workers
            self.clear()
        self[word] = w
        return w


_STEMS = _Stems()


def tokens_of(text: str) -> list[str]:
    """The same tokens for a single string: of a query on the driver, or of a text in an Arrow batch."""
    low = (text.replace("İ", "i") if "İ" in text else text).lower()
    out = [w for w in map(_STEMS.__getitem__, _LATIN_RUN.findall(low)) if w]
    if low.isascii():
        return out
    han: list[str] = []
    for run in _HAN_RUN.findall(low):
        han += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return han + out


def escape_html(text: Column) -> Column:
    """The five characters that HTML reserves."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def needles(query: str) -> list[str]:
    """What is marked: the whole query, its words, and its tokens of two characters or more, each once whatever its case."""
    wanted = [query.strip(), *query.split(), *(t for t in tokens_of(query) if len(t) >= 2)]
    seen: dict[str, str] = {}
    for w in wanted:
        if w:
            seen.setdefault(w.lower(), w)
    return list(seen.values())


def highlight(text: Column, query: str) -> Column:
    """Escaped text with every needle in a mark element; earlier needles win where several begin."""
    safe = escape_html(text)
    parts = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", _escaped(w)) for w in needles(query)]
    return F.regexp_replace(safe, f"(?iu)({'|'.join(parts)})", "<mark>$1</mark>") if parts else safe


def _escaped(text: str) -> str:
    return html.escape(text, quote=False).replace('"', "&#34;").replace("'", "&#39;")


def snippet(body: Column, query: str, mark: bool = True) -> Column:
    """180 characters of `body` that begin 60 before the first occurrence of the query or else of its first word found.

    Positions are counted in characters, see `exact_snippet` for the byte rule that a search uses.
    """
    low = lower(body)
    wanted = [query.strip().lower(), *(w.lower() for w in query.split())]
    at = F.coalesce(*[F.nullif(F.instr(low, w), F.lit(0)) for w in wanted if w], F.lit(1)) if any(wanted) else F.lit(1)
    start = F.greatest(at - 61, F.lit(0))
    piece = F.regexp_replace(F.substring(body, start + 1, F.lit(180)), r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")
    cut = F.concat(F.when(start > 0, "…").otherwise(""), piece, F.when(start + 180 < F.length(body), "…").otherwise(""))
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit("")).otherwise(highlight(cut, query) if mark else escape_html(cut))


def cut_snippet(body: str | None, query: str) -> str:
    """What `exact_snippet` cuts of a single text: 60 bytes before the hit in UTF-8, a stray byte counting as one character."""
    if not body:
        return ""
    low, raw = body.lower().encode("utf-8", "surrogatepass"), body.encode("utf-8", "surrogatepass")
    at = low.find(query.strip().lower().encode())
    for word in query.split() if at < 0 else []:
        at = low.find(word.lower().encode())
        if at >= 0:
            break
    start = 0
    if at > 0:
        head = raw[: min(max(at - 60, 0), len(raw))]
        start = min(len(head.decode("utf-8", "surrogateescape")), len(body))
    end = min(start + 180, len(body))
    return ("…" if start else "") + body[start:end].strip() + ("…" if end < len(body) else "")


def exact_snippet(body: Column, query: str) -> Column:
    """180 characters of `body`, not escaped, that begin 60 bytes before the first occurrence of the query or else of its first word
    found. Bytes are those of UTF-8; of a character that the beginning falls into, every byte before it counts as a character.
    """
    low = F.lower(body)
    wanted = [query.strip().lower(), *(w.lower() for w in query.split())]
    at = F.coalesce(*[F.nullif(F.instr(low, w), F.lit(0)) for w in wanted if w], F.lit(1)) if any(wanted) else F.lit(1)
    cut = F.least(F.greatest(F.octet_length(F.left(low, at - 1)) - 60, F.lit(0)), F.octet_length(body))
    # the length of a piece that ends inside a character counts that character
    chars = F.length(F.substring(body.cast("binary"), F.lit(1), cut).cast("string"))
    whole = F.octet_length(F.left(body, chars)) == cut
    start = F.least(F.when(whole, chars).otherwise(chars - 1 + cut - F.octet_length(F.left(body, chars - 1))), F.length(body))
    piece = F.regexp_replace(F.substring(body, start + 1, F.lit(180)), r"^[\s\u0085\p{Z}\x1c-\x1f]+|[\s\u0085\p{Z}\x1c-\x1f]+$", "")
    text = F.concat(F.when(start > 0, "…").otherwise(""), piece, F.when(start + 180 < F.length(body), "…").otherwise(""))
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, F.lit("")).otherwise(text)
