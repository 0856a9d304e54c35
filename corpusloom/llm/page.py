"""The main body of a record, and whether the record is stuffed: one pass over its lines.

Body (line-block distribution): markup is stripped, every line weighs the characters of its running text, weights are summed
over sliding windows of WINDOW lines, and the text is kept between the surge, the first line of weight whose window reaches the
threshold, and the dive, the last one. Stripping markup takes away what is no running text whatever it says: tags, and the
short pieces of a line that is cut into three or more by separators (menus, paths, bylines). Lines that the site repeats, lines
that recur all over the collection and lines that are links to other records (worded like the collection's titles) weigh
nothing either, and are cut out between surge and dive. So are gaps there: menus as heavy as a block.

Stuffing: the terms of the record's own lines are numbered in order. The gap back to a term's last place, the autocorrelation of
the places over lags, and the spread of gaps of the most frequent term tell unnaturally regular repetition; the share of text
in lists of distinct nouns without function words tells keyword lists, link lists, tags and product lines from statements.

All of it needs only the record and three bounded tables: its site's lines, frequent lines and title openings.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np

#: Lines in a window of the block distribution, the characters that make a block, and those that a line at its border needs.
WINDOW = 3
BLOCK = 80
LIGHT = 20
#: A Han character says as much as so many letters; a piece of fewer words and characters is no running text.
HAN = 2.5
PIECE_WORDS = 4
PIECE = 30
#: Longest lag of the autocorrelation, and the longest gap after which a term still comes back soon.
LAGS = 48
#: Repetition is unnaturally regular if so many of the content words come back within LAGS places and if places agree that often
#: at the mean lag; in the running text of these collections they reach 0.43 and 0.12, but never both.
NEAR = 0.39
AUTO = 0.02
#: In Han text runs are its terms, most of them clauses that never return: names in other scripts do not count there, a run of more
#: characters than a term has is a clause, and fewer returns are regular. So many Han characters say as much as a word.
HAN_TERM = 8
HAN_WORD = 4
HAN_NEAR = 0.28
#: A term that comes so many times as often as there are lines with it is no frame of a log or list, which has it once in each.
IN_LINE = 1.5
#: A single term is strewn in if it makes up so much of the content words, in running text its subject has up to 0.13, and its gaps
#: spread by no more than this part of their mean; by chance they would spread by all of it.
TERM_SHARE = 0.17
GAP_SPREAD = 0.6
#: Neighbouring lags that are taken together when a term's gaps are looked at.
LAG_WINDOW = 3
#: Content words from which repetition says something.
LEAST_WORDS = 12
#: Share of characters in statements below which a text is a list.
SAID = 0.33
#: Own text of fewer characters says too little; the record is then judged by its links.
LITTLE_TEXT = 60
#: Different links to other sites from which links are a list, and the share of the links they must be.
LINKS = 30
OUTWARD = 0.8

# fixed values: common function words
FUNCTION_WORDS = frozenset(
    """
    the a an of and or to in is are was were that this as at by on from but not it so each while when what only before
    after our until into once during because if its be which who they had has have then than there
    der die das den dem des ein eine einen einem und oder zu im ist sind mit auf nach vor bei wird werden nicht wenn was aber
    denn am jede jeden unser dieser dann noch nur erst
    de le la les un une et ou à est sont dans pour par sur avec qui que ne mais car au aux du ce cette chaque notre dès quand puis
    el los las una y o es son en con por para que no pero porque al del este cada nuestro cuando mientras después se su
    os as um uma e é são em no na nos nas por para que não mas porque ao dos das cada nosso quando enquanto depois se
    и в во на не но а что как это по за из к до при с со для этот наш каждый каждого пока если потом чтобы перед после
    """.split()
)
FUNCTION_CHARS = frozenset("的了是和并但而与就之不也把被里后前时每对这其所因为各些此个")

_TAG = re.compile(r"<[^<>]+>")
_URL = re.compile(r"\[[^\]\n]*\]\(\S*\)|(?:https?://|www\.)\S+")
_WORD = re.compile(r"[^\W\d_]+")
_TERM = re.compile(r"[^\W\d_㐀-鿿]+|\n|[㐀-鿿]+")
_HAN = re.compile(r"[㐀-鿿]")
_DIGIT = re.compile(r"\d")
_BULLET = re.compile(r"^[»•*>·‣▪–—-]+\s+")
_COUNT = re.compile(r"\s*[(（]\d+[)）]\s*$")
_PIECES = re.compile(r"\s+[|·/–—>»•→]\s+|\s*[|\t]\s*|\s{2,}")
_COMMA = re.compile(r"\s*[,，]\s+")
_MARK = re.compile("[|·/–—>»•→\t]|  ")
_BULLETS = frozenset("»•*>·‣▪–—-")
_LABEL = re.compile(r"^([^:：]+)[:：]\s*(.+)$")
_ENDED = frozenset(".!?。！？…")


@dataclass
class Known:
    """What the collection says about lines; all of it bounded by shares of the collection. Openings of titles come with the
    length of the longest title that has them."""

    frequent: frozenset[int] = frozenset()
    before_colon: dict[str, int] = field(default_factory=dict)
    before_dash: dict[str, int] = field(default_factory=dict)


def worded_like_title(s: str, known: Known) -> bool:
    """Whether `s` opens like several titles of the collection, `A: b` or `A – b`, and is no longer than they are."""
    a, sep, b = s.partition(": ")
    if sep and b and known.before_colon.get(a, 0) >= len(s):
        return True
    a, sep, b = s.partition(" – ")
    return bool(sep and b and known.before_dash.get(a, 0) >= len(s))


def _is_link(s: str, known: Known) -> bool:
    """Whether a line leads to other records: it is worded like a title, or a label before such ones."""
    if ":" not in s and "–" not in s and "：" not in s:
        return False
    core = _BULLET.sub("", s) if s[0] in _BULLETS else s
    core = _COUNT.sub("", core) if core[-1:] in (")", "）") else core
    if worded_like_title(core, known):
        return True
    m = _LABEL.match(core)
    return bool(m) and all(worded_like_title(p.strip(), known) for p in (re.split(r"\s+·\s+", m[2]) if "·" in m[2] else (m[2],)))


def mass(s: str) -> int:
    """Characters, each Han one as much as HAN letters."""
    return len(s) if s.isascii() else len(s) + int((HAN - 1) * len(_HAN.findall(s)))


def weight(s: str, known: Known) -> tuple[int, bool]:
    """(characters of running text in a line without tags, whether it is a menu: short pieces between marks alone, each once and
    without figures)."""
    marked = _MARK.search(s) is not None
    if marked:
        pieces = [p for p in _PIECES.split(_BULLET.sub("", s)) if p]
    elif "," in s and s[-1] not in _ENDED:
        pieces = _COMMA.split(s)
    else:
        return mass(s), False
    if len(pieces) < 3:
        return mass(s), False
    long = [p for p in pieces if (p.count(" ") + 1 >= PIECE_WORDS or mass(p) >= PIECE) and not worded_like_title(p, known)]
    # the last name of a path may be long
    if 2 * len(long) < len(pieces) and s[-1] not in _ENDED:
        return 0, marked and not _DIGIT.search(s) and len(set(pieces)) == len(pieces)
    return sum(map(mass, long)), False


def span(weights: Sequence[int]) -> tuple[int, int]:
    """(surge, dive): the first and the last line of weight whose window holds a block; (0, -1) if there is none.

    Where no window of the record holds a block, half of its heaviest window is one.
    """
    n, half = len(weights), WINDOW // 2
    block = [sum(weights[max(0, at - half) : at + half + 1]) for at in range(n)] if n >= WINDOW else [sum(weights)] * n
    least = min(BLOCK, max(1, max(block, default=0) // 2))
    light = min(LIGHT, least)
    inside = [at for at, w in enumerate(weights) if w >= light and block[at] >= least]
    return (inside[0], inside[-1]) if inside else (0, -1)


def kinds(lines: list[str], keys: list[int], own: set[int], known: Known, title: str | None, windows: bool = True) -> list[int]:
    """0 for an empty line, 1 for the main body, 2 for known lines, gaps and menus outside the body, 3 for what else stands before
    the surge or after the dive. Without `windows` only known lines and gaps are cut."""
    n = len(lines)
    kind = [0] * n
    weights = [0] * n
    plain = [_TAG.sub(" ", x).strip() if "<" in x else x.strip() for x in lines]
    name = (title or "").strip()
    has_name = bool(name) and "://" not in name and name in plain
    headline = -1
    menus = set()
    for i, s in enumerate(plain):
        if not s:
            continue
        kind[i] = 1
        if has_name and s == name:
            weights[i] = mass(s)
            if headline < 0:
                headline = i
        elif keys[i] in own:
            kind[i] = 2
        elif _is_link(s, known):
            kind[i] = 3
        elif keys[i] in known.frequent and not _DIGIT.search(s):
            kind[i] = 2
        else:
            weights[i], menu = weight(s, known)
            if menu:
                menus.add(i)
                kind[i] = 2 if mass(s) >= BLOCK else 1
    filled = [i for i, k in enumerate(kind) if k]
    if not has_name and 3 in kind:  # the headline is the bare title-like line right above the body
        for i, after in pairwise(filled):
            if kind[i] == 3 and kind[after] == 1 and after not in menus and not _BULLET.match(plain[i]) and not _COUNT.search(plain[i]) and worded_like_title(plain[i], known):
                headline, weights[i] = i, mass(plain[i])
                break
    kind = [2 if k == 3 else k for k in kind]
    if windows:
        surge, dive = span([weights[i] for i in filled])
        for at in (*range(surge), *range(dive + 1, len(filled))):
            if kind[filled[at]] == 1:
                kind[filled[at]] = 2 if filled[at] in menus else 3
    if headline >= 0:
        kind[headline] = 1
    return kind


class _Codes(dict):
    """Number of each term, -1 for function words and -2 for the end of a line; of every number 1 if it stands for a Han term, 2 for
    a Han clause; and the words that a run of Han characters is worth."""

    def __init__(self) -> None:
        super().__init__({"\n": -2})
        self.han = bytearray()
        self.worth = array("i")

    def __missing__(self, term: str) -> int:
        if term in FUNCTION_WORDS:
            self[term] = -1
            return -1
        self[term] = code = len(self.han)
        script = 0 if not "㐀" <= term[0] <= "鿿" else 1 if len(term) <= HAN_TERM else 2
        self.han.append(script)
        self.worth.append(-(-len(term) // HAN_WORD) if script else 1)
        return code


#: Terms of this process; started anew when there are too many.
_CODES = _Codes()
MOST_CODES = 1_000_000


def steady_share(places: np.ndarray, total: int) -> float:
    """Share of a term that comes back at steady gaps; 0 for others. The gaps between its places must spread little, and one
    window of lags must hold half of them."""
    gaps = np.diff(places)
    lags = np.convolve(np.bincount(gaps), np.ones(LAG_WINDOW, dtype=np.int64))
    return len(places) / total if gaps.std() <= GAP_SPREAD * gaps.mean() and 2 * lags.max() >= len(gaps) else 0.0


def recurrence(records: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How regularly terms come back in the lines of each record; all records at once.

    (content words, share of their places whose term came at most LAGS places before, mean autocorrelation of the places over
    LAGS lags, share of a term that comes back at steady gaps, whether most terms are Han). In running text a word seldom
    returns after a short gap or again and again after the same one; keywords strewn into sentences do both. Terms that
    come hardly more than once in a line are the frame of a log or list and do not count.
    """
    global _CODES
    if len(_CODES) > MOST_CODES:
        _CODES = _Codes()
    r = len(records)
    if not any(records):
        return np.zeros(r, dtype=np.int64), np.zeros(r), np.zeros(r), np.zeros(r), np.zeros(r, dtype=bool)
    terms = _TERM.findall("\n".join(chain.from_iterable(records)).lower())
    code = np.fromiter(map(_CODES.__getitem__, terms), dtype=np.int64, count=len(terms))
    line = np.cumsum(code == -2)
    keep = np.flatnonzero(code >= 0)
    owner = np.repeat(np.arange(r), [len(x) for x in records])
    line, code = line[keep], code[keep]
    rec = owner[line]
    n = np.bincount(rec, minlength=r)
    near, auto, steady = np.zeros(r), np.zeros(r), np.zeros(r)
    if not len(code):
        return n, near, auto, steady, np.zeros(r, dtype=bool)
    script = np.frombuffer(bytes(_CODES.han), dtype=np.uint8)[code]
    worth = np.array(_CODES.worth, dtype=np.int64)[code]
    size = np.bincount(rec, weights=worth, minlength=r)
    han = 2 * np.bincount(rec, weights=np.where(script > 0, worth, 0), minlength=r) > size
    key = rec * np.int64(len(_CODES.han)) + code
    order = np.argsort(key, kind="stable")
    by_key, by_line = key[order], line[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = by_key[1:] != by_key[:-1]
    in_line = first.copy()
    in_line[1:] |= by_line[1:] != by_line[:-1]
    run = np.cumsum(first) - 1
    times, held = np.bincount(run), np.bincount(run, weights=in_line)
    strewn = (times > 1) & (times >= IN_LINE * held)
    counts = np.empty(len(order), dtype=bool)
    counts[order] = strewn[run]
    counts &= (script == 1) | ((script == 0) & ~han[rec])
    longest = np.minimum(LAGS, np.maximum(n // 2, 1))
    back = np.zeros(len(order), dtype=bool)
    for lag in range(1, min(LAGS, len(order) - 1) + 1):
        at = np.flatnonzero((key[lag:] == key[:-lag]) & counts[lag:]) + lag
        back[at] = True
        auto += np.where(lag <= longest, np.bincount(rec[at], minlength=r) / np.maximum(n - lag, 1), 0.0)
    auto /= longest
    near = np.bincount(rec, weights=back, minlength=r) / np.maximum(n, 1)
    starts = np.flatnonzero(first)
    of = rec[order[starts]]
    for k in np.flatnonzero(strewn & (times >= np.maximum(6, TERM_SHARE * size[of])) & ~han[of]):
        # places within the record; a stable order keeps them sorted
        steady[of[k]] = max(steady[of[k]], steady_share(order[starts[k] : starts[k] + times[k]], int(size[of[k]])))
    few = n < LEAST_WORDS
    near[few], auto[few], steady[few] = 0.0, 0.0, 0.0
    return n, near, auto, steady, han


def _states(text: str) -> bool:
    """Whether a sentence says something: function words, or words enough that are no enumeration."""
    if not text.isascii() and _HAN.search(text):
        han = len(_HAN.findall(text))
        if han * 3 > len(text):
            if text.count("、") * 6 > han:
                return False
            return sum(map(text.count, FUNCTION_CHARS)) >= 0.045 * han or (han >= 8 and text.rstrip()[-1:] in "。！？")
    low = text.lower()
    words = low.split()
    marks = sum(map(FUNCTION_WORDS.__contains__, words))
    if marks > 1 and marks >= 0.1 * len(words):  # most sentences are settled without looking for word borders
        return True
    words = _WORD.findall(low)
    marks = sum(map(FUNCTION_WORDS.__contains__, words))
    if not words:
        return False
    if len(words) >= 3 and marks >= 0.1 * len(words) and (marks > 1 or len(words) >= 5):
        return True
    return len(words) >= 6 and text.rstrip()[-1:] in ".!?" and text.count(",") * 5 <= len(words)


_TAGGED = re.compile(r"(?<!\S)#\S+")
_ENDS = " .!?。！？…\t"
_SENTENCE = re.compile(r"[^.!?。！？]+(?:[.!?。！？]+(?=\s|$|[^\x00-\x7f])|[.!?](?=\S))*[.!?。！？]*")


def statement_share(lines: list[str], enough: float = 2.0) -> tuple[float, int]:
    """(share of characters in sentences that say something, characters); at least `enough` once that is sure.

    A sentence said again in the record says nothing new. Addresses count only in lines without a statement.
    """
    said = total = 0
    heard: set[str] = set()
    all_chars = sum(map(len, lines))
    for line in lines:
        text = _TAGGED.sub(" ", _URL.sub(" ", line)) if "/" in line or "#" in line or "www." in line else line
        new = 0
        for sentence in _SENTENCE.findall(text):
            if len(sentence) > 5 and _states(sentence):
                key = sentence.strip(_ENDS).lower()
                if key not in heard:
                    heard.add(key)
                    new += len(sentence)
        said += new
        if said >= enough * all_chars:
            return enough, all_chars
        total += len(text.strip()) if new else len(line)
    return (min(said / total, 1.0) if total else 1.0), total


_HOST = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def link_site(url: str) -> str:
    """The site of an address, as `lines.host_site` has it."""
    m = _HOST.match(url.strip(" ").lower())
    return re.sub(r"\.[a-z0-9-]+$", "", re.sub(r"^(?:www|m)\.", "", m[1])) if m else ""


def link_list(links: list[str | None], site: str) -> bool:
    """Whether a record's links are a list of addresses elsewhere: menus and references lead back to the site or are few."""
    apart = {x for x in links if x}
    outward = sum(link_site(x) != site for x in apart)
    return outward >= LINKS and outward >= OUTWARD * len(apart)


def regular(records: list[list[str]]) -> np.ndarray:
    """Which records repeat their terms with unnatural regularity."""
    _, near, auto, steady, han = recurrence(records)
    return ((near >= np.where(han, HAN_NEAR, NEAR)) & (auto >= AUTO)) | (steady > 0)


def listed(lines: list[str]) -> bool:
    """Whether lines are mostly lists without function words: sentences that say something new hold less than SAID of them."""
    said, total = statement_share(lines, SAID)
    return said < SAID and total >= LITTLE_TEXT


def stuffing(records: list[list[str]]) -> list[bool]:
    """Whether the own lines of each record are mostly keywords, links, tags or products.

    Unnaturally regular repetition of terms decides first; what is not repeated is a list if it does without function words.
    """
    return [bool(r) or listed(lines) for r, lines in zip(regular(records), records, strict=True)]
