"""Text decoded with a wrong character encoding: find it, learn what happened, undo it.

1. Pairs of neighbouring characters, at least one of them outside ASCII, are counted over the whole collection in a
   dense array of hashed pairs (fixed size; every task sums its own, the arrays are added). Lines whose pairs are mostly
   rare, and lines with replacement or control characters, are suspects.
2. Suspects are joined with clean near-twins: lines that are equal once everything outside ASCII is stripped. The runs
   between the same ASCII characters are aligned. Each aligned pair of runs votes for the (encoding, wrongly decoded as)
   pairs that turn one into the other; and, where no known pair does, for the transformation itself: which garbled piece
   stands for which character. Rules and pieces with votes are the learned mappings.
3. The learned mappings are applied to all suspects. A change is kept if the restored text is much likelier under the pair
   counts. Lines no mapping can restore take the wording of their twin, if they have exactly one.

Lines that are always garbled in the same way in documents of several sites and never occur clean show it on purpose.

Defined cases: null or empty values and ASCII values are never garbled; texts of any length are read whole; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from unicodedata import category

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.scale import hot_keys, is_small, salted_join, sized
from corpusloom.sources.tables import stored

#: Slots of the array of pair counts.
SLOTS = 1 << 19
#: A pair is rare if less than this share of the values outside ASCII holds it.
RARE = 0.001
#: A line is a suspect if more than this share of its pairs is rare.
SUSPECT = 0.34
#: So many pairs that all turn from rare to common are enough to learn a rule from one line.
SURE_PAIRS = 40
#: Letters that a stripped line needs to be known by.
SKELETON = 4
#: Votes that a garbled piece needs, the share of them that its character must have, and the number of pieces that are learned at most; encodings
#: that are mistaken for one another have some hundred each.
PIECE_VOTES = 2
PIECE_SHARE = 0.9
MOST_PIECES = 20_000
_WIDE = np.dtype("<u4")
_CONTROL = re.compile("[�\x80-\x84\x86-\x9f]")

#: (encoding, wrongly decoded as): what is looked for by alignment.
SINGLE_BYTE = ("cp1252", "latin-1", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "mac-roman", "iso8859-15", "cp1250")
DOUBLE_BYTE = ("gb18030", "big5", "shift_jis", "euc-kr")
CANDIDATES = (
    *(("utf-8", wrong) for wrong in SINGLE_BYTE),
    *(("utf-8", wrong) for wrong in ("gbk", "big5", "shift_jis", "euc-kr")),
    *((right, wrong) for right in DOUBLE_BYTE for wrong in ("latin-1", "cp1252")),
    *((right, wrong) for right in ("cp1251", "koi8-r", "cp866", "mac-cyrillic") for wrong in ("latin-1", "cp1252")),
    *((right, wrong) for right in ("cp1251", "koi8-r", "cp866") for wrong in ("cp1251", "koi8-r", "cp866") if right != wrong),
    *((right, wrong) for right in ("latin-1", "cp1252") for wrong in ("cp437", "cp850", "cp1251", "mac-roman")),
)
#: Well-formed sequences of these hardly occur in clean text of any language, so they make a suspect by themselves.
STRUCTURAL = ("cp1252", "latin-1", "cp437", "cp850", "cp1251")


def _table(encoding: str) -> dict[int, str]:
    """The character of each byte from 0x80; as browsers do, bytes without one keep their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def encode_wide(text: str, encoding: str) -> bytes | None:
    """`text` as bytes of the encoding it was wrongly decoded with; None if a character has none."""
    try:
        return codecs.charmap_encode(text, "strict", _BYTES[encoding])[0] if encoding in _BYTES else text.encode(encoding)
    except UnicodeEncodeError:
        return None


# Western tables mix in practice: cp1252 with the unassigned bytes kept, and latin-1 for the same bytes
_BACK = {e: {c: b for b, c in _table(e).items()} for e in SINGLE_BYTE}
for _e in ("cp1252", "latin-1"):
    for _b, _c in _table("latin-1").items():
        _BACK[_e].setdefault(_c, _b)
for _b, _c in _table("cp1252").items():
    _BACK["latin-1"].setdefault(_c, _b)

_BYTES = {e: {**{b: b for b in range(0x80)}, **{ord(c): b for c, b in back.items()}} for e, back in _BACK.items()}


def _utf8_runs(wrong: str) -> re.Pattern:
    """What well-formed multi-byte sequences look like after decoding with a single-byte encoding."""
    back = _BACK[wrong]
    if wrong in ("cp1252", "latin-1"):
        back = {c: b for c, b in back.items() if b >= 0x80}
    by: dict[str, list[str]] = {"c": [], "2": [], "3": [], "4": []}
    for c, b in back.items():
        kind = "c" if b < 0xC0 else "2" if 0xC2 <= b < 0xE0 else "3" if 0xE0 <= b < 0xF0 else "4" if 0xF0 <= b < 0xF5 else ""
        if kind:
            by[kind].append(re.escape(c))
    s = {k: "[" + "".join(v) + "]" for k, v in by.items()}
    return re.compile(f"(?:{s['2']}{s['c']}|{s['3']}{s['c']}{{2}}|{s['4']}{s['c']}{{3}})+")


_RUNS = {_w: _utf8_runs(_w) for _w in SINGLE_BYTE}


def _classes() -> np.ndarray:
    """For each character below 0x2600 the encodings of STRUCTURAL, as bits, in which it leads two or three bytes or continues."""
    out = np.zeros((3, 0x2600), dtype=np.uint8)
    for bit, wrong in enumerate(STRUCTURAL):
        for c, b in _BACK[wrong].items():
            row = 2 if 0x80 <= b < 0xC0 else 0 if 0xC2 <= b < 0xE0 else 1 if 0xE0 <= b < 0xF0 else -1
            if row >= 0 and ord(c) < 0x2600:
                out[row, ord(c)] |= 1 << bit
    return out


_LEAD2, _LEAD3, _CONT = _classes()


def run_starts(text: str) -> np.ndarray:
    """Where a well-formed sequence of any encoding of STRUCTURAL begins; all characters at once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=_WIDE)
    if len(points) < 3:
        return np.empty(0, np.int64)
    at = np.flatnonzero(points[:-2] > 127)
    a, b, c = (np.where(x < 0x2600, x, 0) for x in (points[at], points[at + 1], points[at + 2]))
    return at[((_LEAD2[a] & _CONT[b]) | (_LEAD3[a] & _CONT[b] & _CONT[c])) > 0]

_ASCII = frozenset(map(chr, range(128)))
_RUN = re.compile(r"[^\x00-\x7f]+")
_FIGURES = re.compile(r"[0-9]+")
_LATIN = re.compile(r"[A-Za-z]")
_PAIRS = re.compile(r"(?:[^\x00-\x7f][^\x00-\x3f\x7f])+(?: (?:[^\x00-\x7f][^\x00-\x3f\x7f])+)*")
_OUTSIDE = re.compile(r"[^\x00-\x7f]+(?:[ \x40-\x7e]{0,1}[^\x00-\x7f]+)*")


def pair_slots(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs with a character outside ASCII, and their slots; case is kept."""
    if len(points) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = points > 127
    wide &= (points != 0xA0) & (points != 0x3000)
    at = np.flatnonzero(wide[:-1] | wide[1:])
    a, b = points[at].astype(np.uint64), points[at + 1].astype(np.uint64)
    for x in (a, b):  # figures, blanks and line ends are alike
        x[((x < 65) & (x > 0)) | (x == 0xA0) | (x == 0x3000)] = 32
    return at, ((a * np.uint64(2654435761) + b * np.uint64(40503) * np.uint64(65599)) >> np.uint64(7)).astype(np.int64) % SLOTS


def points_of(text: str) -> np.ndarray:
    """Code points in lower case."""
    text = text.lower()
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=_WIDE)


def pair_counts(values: DataFrame) -> np.ndarray:
    """Number of `value`s with each hashed pair; at most SLOTS numbers reach the driver, whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            texts = batch["value"].tolist()
            for at in range(0, len(texts), 128):
                part = texts[at : at + 128]
                places, slots = pair_slots(points_of("\n".join(part)))
                ends = np.cumsum([len(x.lower()) + 1 for x in part])
                once = np.unique(np.searchsorted(ends, places, side="right") * SLOTS + slots)
                sums += np.bincount(once % SLOTS, minlength=SLOTS)
        used = np.flatnonzero(sums)
        yield pd.DataFrame({"slot": used, "n": sums[used]})

    rows = values.select("value").mapInPandas(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, dtype=np.int64)
    got = rows.toPandas()
    out[got["slot"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


@dataclass
class Model:
    """Log shares of pairs, and the rules to try."""

    counts: np.ndarray
    rules: tuple[tuple[str, str], ...] = CANDIDATES
    pieces: dict[str, str] = field(default_factory=dict)
    log: np.ndarray = field(init=False)
    last_logs: dict[str, np.ndarray] = field(init=False, default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        # the commonest pairs are those of blanks and punctuation; nearly every value has some
        total = max(float(self.counts.max(initial=0)) * 2.0, 1.0)
        self.log = np.log((self.counts + 0.3) / total).astype(np.float32)
        # a small collection knows few pairs; those of a single value are rare in any
        self.rare = float(np.log(max(RARE * total, 1.5) / total))

    def logs(self, text: str) -> np.ndarray:
        """Log shares of a text's pairs; those of the last texts are remembered, as each is asked for several times."""
        if text not in self.last_logs:
            if len(self.last_logs) >= 64:
                self.last_logs.clear()
            self.last_logs[text] = self.log[pair_slots(points_of(text))[1]]
        return self.last_logs[text]

    def rare_share(self, text: str) -> tuple[float, int]:
        logs = self.logs(text)
        return (float(np.count_nonzero(logs < self.rare)) / len(logs), len(logs)) if len(logs) else (0.0, 0)

    def mean(self, text: str) -> float:
        logs = self.logs(text)
        return float(logs.sum(dtype=np.float64)) / len(logs) if len(logs) else -7.0

    def suspects(self, lines: list[str]) -> np.ndarray:
        """Which of the lines are suspects; one pass over all their characters."""
        out = np.zeros(len(lines), dtype=bool)
        if not lines:
            return out
        points = points_of("\n".join(lines))
        at, slots = pair_slots(points)
        if len(at):
            line = np.searchsorted(np.flatnonzero(points == 10), at, side="left")
            n = np.bincount(line, minlength=len(lines))
            rare = np.bincount(line, weights=self.log[slots] < self.rare, minlength=len(lines))
            out = rare[: len(lines)] > SUSPECT * np.maximum(n[: len(lines)], 1)
        whole = "\n".join(lines)
        marks = np.concatenate([run_starts(whole + "  "), np.fromiter((m.start() for m in _CONTROL.finditer(whole)), dtype=np.int64)])
        if len(marks):
            starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
            out[np.searchsorted(starts, marks, side="right") - 1] = True
        return out

    def better(self, old: list[str], new: list[str]) -> bool:
        """Whether restored pieces, each with the character before and after it, are likelier than what stood there."""
        if old == new:
            return False
        before, after = "\n".join(old), "\n".join(new)
        if not len(self.logs(before)):
            return False
        if not len(self.logs(after)):
            return True
        return self.rare_share(after)[0] <= self.rare_share(before)[0] and self.mean(after) > self.mean(before) + 0.7

    def settled(self, line: str) -> bool:
        """Whether nothing in a line looks wrong any more."""
        return not self.rare_share(line)[0] and not _CONTROL.search(line) and not len(run_starts(line + "  "))

    def by_pieces(self, line: str) -> str:
        """The line with every run outside ASCII that learned pieces cover put back, longest pieces first; if that is likelier."""
        if not self.pieces:
            return line
        longest = max(map(len, self.pieces))
        found, new = [], []
        for m in _RUN.finditer(line):
            out, at = "", 0
            while at < len(m[0]):
                for size in range(min(longest, len(m[0]) - at), 0, -1):
                    if m[0][at : at + size] in self.pieces:
                        out += self.pieces[m[0][at : at + size]]
                        at += size
                        break
                else:
                    break
            if at == len(m[0]) and out != m[0]:
                found.append(m)
                new.append(out)
        if not found or not self.better(_in_place(line, found, [m[0] for m in found]), _in_place(line, found, new)):
            return line
        put = dict(zip((m.start() for m in found), new, strict=True))
        return _RUN.sub(lambda m: put.get(m.start(), m[0]), line)

    def sure_rule(self, line: str) -> tuple[str, str] | None:
        """The rule after which a line of at least 10 pairs has hardly a rare one left, if most were rare before."""
        share, n = self.rare_share(line)
        if n < 10 or share < 0.5:
            return None
        self.last = None
        new, changed = self.restore(line)
        return self.last if changed and self.rare_share(new)[0] < 0.1 else None

    def restore(self, line: str) -> tuple[str, bool]:
        """The restored line, and whether anything was changed. Rules are applied again as long as they help, as text may have been
        decoded wrongly several times; each time it gets shorter or likelier. Learned pieces come last."""
        now, changed = self._by_rules(line)
        if self.pieces and not (changed and self.settled(now)):
            new = self.by_pieces(now)
            return new, changed or new != now
        return now, changed

    def _by_rules(self, line: str) -> tuple[str, bool]:
        now, changed = line, False
        past = {line}
        while True:
            best, mean = now, -np.inf
            chars = set(now) - _ASCII
            for right, wrong in self.rules:
                if not _may_apply(chars, right, wrong):
                    continue
                new = apply_rule(now, right, wrong, self)
                if new != now and (m := self.mean(new)) > mean + 1e-6:
                    best, mean = new, m
                    self.last = (right, wrong)
                    if right == "utf-8" and self.settled(new):
                        break
            if best in past:  # nothing helps any more, or a circle
                break
            past.add(best)
            now, changed = best, True
            if self.settled(now):
                break
        return now, changed


def _may_apply(chars: set[str], right: str, wrong: str) -> bool:
    """Whether a line with these characters outside ASCII can hold anything the rule changes."""
    if wrong in SINGLE_BYTE:
        other = len(chars - _BACK[wrong].keys())
        return other < len(chars) and (right == "utf-8" or 3 * other <= len(chars))
    return any(c >= "\u2e80" for c in chars)


def _decoded(wrong: str):
    def back(m: re.Match) -> str:
        raw = encode_wide(m[0], wrong)
        try:
            return raw.decode("utf-8") if raw else m[0]
        except UnicodeDecodeError:
            return m[0]

    return back


def _in_place(line: str, found: list[re.Match], pieces: list[str]) -> list[str]:
    return [line[max(0, m.start() - 1) : m.start()] + x + line[m.end() : m.end() + 1] for m, x in zip(found, pieces, strict=True)]


def apply_rule(line: str, right: str, wrong: str, model: Model | None = None) -> str:
    """`line` with the pieces changed back that were written in `right` and decoded as `wrong`."""
    if right == "utf-8" and wrong in SINGLE_BYTE:
        runs = _RUNS[wrong]
        found = list(runs.finditer(line))
        old = pieces = [m[0] for m in found]
        # marks without width have no usual neighbours; nothing else looks like them
        marks = {x: y for x in old if x != (y := runs.sub(_decoded(wrong), x)) and all(category(c) == "Cf" for c in y)}
        if marks:
            return apply_rule(runs.sub(lambda m: marks.get(m[0], m[0]), line), right, wrong, model)
        while True:  # text decoded wrongly several times makes sense only at the end; each time its pieces get shorter
            before, pieces = pieces, [runs.sub(_decoded(wrong), x) for x in pieces]
            if pieces == before:
                break
            if model is None or model.better(_in_place(line, found, old), _in_place(line, found, pieces)):
                new = iter(pieces)
                line = runs.sub(lambda _, new=new: next(new), line)
                return apply_rule(line, right, wrong, model) if model else line
        return line

    pattern = _PAIRS if wrong in SINGLE_BYTE and right in DOUBLE_BYTE else _OUTSIDE
    changes: dict[int, str] = {}
    found = []
    for m in pattern.finditer(line):
        if wrong in SINGLE_BYTE:
            if len(m[0]) < 3 or not _BACK[wrong].keys() >= set(m[0]) - _ASCII:
                continue
            if sum(c > "\x7f" for c in m[0]) < 3 or right not in DOUBLE_BYTE and _LATIN.search(line[max(0, m.start() - 1) : m.end() + 1]):
                continue
            raw = encode_wide(m[0], wrong)
        else:
            parts = [encode_wide(x, wrong) for x in m[0].split("\ufffd")]
            raw = None if None in parts else b"\xff".join(parts)
        if raw is None:
            continue
        try:
            new = raw.decode(right, "strict" if wrong in SINGLE_BYTE else "replace")
        except (UnicodeDecodeError, LookupError):
            continue
        if new != m[0]:
            found.append(m)
            changes[m.start()] = new
    if not found or model is not None and not model.better(_in_place(line, found, [m[0] for m in found]), _in_place(line, found, list(changes.values()))):
        return line
    return pattern.sub(lambda m: changes.get(m.start(), m[0]), line)


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Pairs of the runs outside ASCII of two lines with equal ASCII characters, figures being alike; none of others."""
    if garbled == clean or _FIGURES.sub("0", _RUN.sub("", garbled)) != _FIGURES.sub("0", _RUN.sub("", clean)):
        return []
    return list(zip(_RUN.findall(garbled), _RUN.findall(clean), strict=False))


def votes(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The rules that turn the aligned runs of two lines with equal ASCII characters into one another."""
    runs = aligned(garbled, clean)
    if not runs:
        return []
    out = []
    chars = set(garbled) - _ASCII
    for right, wrong in CANDIDATES:
        if not _may_apply(chars, right, wrong):
            continue
        good = 0
        for g, c in runs:
            raw = encode_wide(g, wrong)
            try:
                good += raw is not None and g != c and raw == c.encode(right)
            except UnicodeEncodeError:
                pass
        if good and good * 2 >= sum(g != c for g, c in runs):
            out.append((right, wrong))
    if not out:  # decoded wrongly twice
        for right, wrong in CANDIDATES[:4]:
            once = apply_rule(garbled, right, wrong)
            if once != garbled and (again := votes(once, clean)) and (right, wrong) in again:
                out.append((right, wrong))
    return out


def inferred(garbled: str, clean: str) -> list[tuple[str, str]]:
    """(garbled piece, character) by aligning the characters of two lines whose ASCII is equal.

    Runs must pair one to one, and most of them stand inside words, next to a letter: then both lines are the same words, which
    equal blanks and marks alone do not say. A run is taken apart evenly if its length is a multiple of the clean one's, or else by
    the number of bytes of each character in UTF-8; a piece must stand for one character throughout the line and a character for
    one piece, and all runs must come out.
    """
    g_runs, c_runs = list(_RUN.finditer(garbled)), _RUN.findall(clean)
    if len(g_runs) != len(c_runs) or not aligned(garbled, clean):
        return []
    if 2 * sum(bool(_LATIN.search(garbled[max(0, m.start() - 1) : m.start()] + garbled[m.end() : m.end() + 1])) for m in g_runs) <= len(g_runs):
        return []
    for even in (True, False):
        known: dict[str, str] = {}
        good = True
        for m, c in zip(g_runs, c_runs, strict=True):
            g = m[0]
            sizes = [len(g) // len(c)] * len(c) if even else [len(x.encode("utf-8", "surrogatepass")) for x in c]
            if sum(sizes) != len(g):
                good = False
                break
            at = 0
            for x, size in zip(c, sizes, strict=True):
                good &= known.setdefault(g[at : at + size], x) == x
                at += size
        if good and len(set(known.values())) == len(known) and not any("\ufffd" in p for p in known):
            return sorted((p, x) for p, x in known.items() if p != x)
    return []


def values_of(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """(id, field, value) of the values with a character outside ASCII; two narrow scans, no shuffle."""
    parts = [docs.where(F.col(f).rlike(r"[^\x00-\x7F]")).select(F.col(id_col).alias("id"), F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stripped(text: Column) -> Column:
    """What is left of a line without everything outside ASCII, figures being alike."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]+", ""), r"[0-9]+", "0")


def suspect_lines(values: DataFrame, model: Model) -> DataFrame:
    """(id, field, line_no, line, rare): stored; a small part of the collection."""
    sent = values.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            ids, fields, texts = batch["id"].tolist(), batch["field"].tolist(), batch["value"].tolist()
            for at in range(0, len(ids), 64):
                lines, owner = [], []
                for r in range(at, min(at + 64, len(ids))):
                    parts = texts[r].split("\n")
                    lines += parts
                    owner += [(ids[r], fields[r], k) for k in range(len(parts))]
                for k in np.flatnonzero(sent.value.suspects(lines)):
                    out.append((*owner[k], lines[k], sent.value.rare_share(lines[k])[0]))
            yield pd.DataFrame(out, columns=["id", "field", "line_no", "line", "rare"])

    return stored(values.mapInPandas(run, "id bigint, field string, line_no bigint, line string, rare double"), "suspects")


def _even(df: DataFrame) -> DataFrame:
    """Rows spread evenly over tasks: little data, much work in each row."""
    return df.repartition(max(12, 2 * df.sparkSession.sparkContext.defaultParallelism))


def _skeleton(line: Column) -> tuple[Column, Column]:
    """(number of a line's stripped text, whether it has SKELETON letters to tell it by)."""
    text = stripped(line)
    return F.xxhash64(text), F.length(F.regexp_replace(text, r"[^A-Za-z]", "")) >= SKELETON


def twins(values: DataFrame, suspects: DataFrame) -> DataFrame:
    """(skel, twin, n_twins), stored: of each suspect's stripped text the most frequent clean line and the number of different ones.

    Stripped texts of hardly any letter tell nothing, and all lines of a script without ASCII share them: they have no twins.
    """
    skel, told = _skeleton(F.col("line"))
    keys = stored(suspects.where(told).select(skel.alias("skel")).distinct(), "skeletons")
    bad = stored(suspects.select(F.xxhash64("line").alias("h")).distinct(), "suspect-lines")
    lines = values.select(F.explode(F.split("value", "\n", -1)).alias("line")).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    lines = lines.where(told).withColumn("skel", skel).withColumn("h", F.xxhash64("line"))
    if is_small(keys, 200_000):
        near = lines.join(F.broadcast(keys), "skel", "left_semi")
    else:
        near = salted_join(lines, keys, "skel", "h", hot_keys(lines, "skel"), "inner")
    clean = near.join(sized(bad, 200_000), "h", "left_anti")
    counts = clean.groupBy("skel", "h").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))
    return stored(counts.groupBy("skel").agg(F.max(F.struct("n", "line"))["line"].alias("twin"), F.count(F.lit(1)).alias("n_twins")), "twins")


def learn(paired: DataFrame, model: Model, least: int = 1, sure: int = 2) -> tuple[tuple[tuple[str, str], ...], dict[str, str]]:
    """(rules, pieces): rules with votes of `least` twins, or of `sure` lines without a twin that turn from rare pairs into common
    ones; and the pieces inferred from twins that no rule explains.

    Scripts other than Latin leave little ASCII to find a twin by; there the pairs of the clean collection are the witness, and a
    line of SURE_PAIRS pairs is witness enough. A piece must stand for the same character in PIECE_SHARE of its votes, PIECE_VOTES
    at least, and every vote comes of a different line that its twin's wording makes likelier.
    Most votes first. At most as many rules as candidates reach the driver, and MOST_PIECES pieces.
    """

    sent = paired.sparkSession.sparkContext.broadcast(Model(model.counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for line, twin in zip(batch["line"], batch["twin"], strict=True):
                found = votes(line, twin) if isinstance(twin, str) else []
                out += [("rule", *r, 1, 0, 0) for r in found]
                if not found and (r := sent.value.sure_rule(line)):
                    out.append(("rule", *r, 0, 1 if sent.value.rare_share(line)[1] < SURE_PAIRS else sure, 0))
                elif not found and isinstance(twin, str) and sent.value.better([line], [twin]):
                    out += [("piece", *r, 1, 0, zlib.crc32(line.encode("utf-8", "surrogatepass"))) for r in inferred(line, twin)]
            yield pd.DataFrame(out, columns=["kind", "right", "wrong", "by_twin", "by_pairs", "of"])

    got = _even(paired.select("line", "twin")).mapInPandas(run, "kind string, right string, wrong string, by_twin bigint, by_pairs bigint, of bigint")
    got = stored(got.groupBy("kind", "right", "wrong").agg(F.sum("by_twin").alias("t"), F.sum("by_pairs").alias("p"), F.count_distinct("of").alias("lines")), "votes")
    rows = sorted((r for r in got.where("kind = 'rule'").collect() if r["t"] >= least or r["p"] >= sure), key=lambda r: (-r["t"] - r["p"], CANDIDATES.index((r["right"], r["wrong"]))))
    best = got.where("kind = 'piece'").groupBy(F.col("right").alias("piece")).agg(F.max_by("wrong", F.struct("lines", "wrong")).alias("char"), F.max("lines").alias("most"), F.sum("lines").alias("all"))
    pieces = best.where((F.col("most") >= PIECE_VOTES) & (F.col("most") >= F.col("all") * PIECE_SHARE)).orderBy(F.desc("most"), "piece").limit(MOST_PIECES).collect()
    return tuple((r["right"], r["wrong"]) for r in rows), {r["piece"]: r["char"] for r in pieces}


def repaired_lines(docs: DataFrame, id_col: str = "doc_id", site: Column | None = None, model: Model | None = None) -> DataFrame:
    """(id, field, line_no, line, restored, state) of every suspect line; stored.

    state: `restored` by a learned rule, `twin` when the wording was taken from the only clean twin, `lost` when it is garbled
    beyond both, `shown` when it is garbled on purpose, `clean` when it only looked rare.
    """
    values = values_of(docs, id_col)
    model = model or Model(pair_counts(values))
    suspects = suspect_lines(values, model)
    keyed = suspects.withColumn("skel", _skeleton(F.col("line"))[0])
    near = twins(values, suspects)
    joined = keyed.join(F.broadcast(near), "skel", "left") if is_small(near) else salted_join(keyed, near, "skel", "id", hot_keys(keyed, "skel"))
    paired = stored(joined, "paired")
    sent = values.sparkSession.sparkContext.broadcast(Model(model.counts, *learn(paired, model)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = [sent.value.restore(x) for x in batch["line"]]
            batch["restored"] = [x for x, _ in new]
            batch["changed"] = [c for _, c in new]
            yield batch[["id", "field", "line_no", "line", "rare", "skel", "twin", "n_twins", "restored", "changed"]]

    done = _even(paired).mapInPandas(run, "id bigint, field string, line_no bigint, line string, rare double, skel bigint, twin string, n_twins bigint, restored string, changed boolean")
    where = docs.select(F.col(id_col).alias("id"), (site if site is not None else F.lit("")).alias("site"))
    done = stored(done, "restored")
    shown = (
        done.where(F.col("twin").isNull() & F.col("changed") & (F.length(F.regexp_replace("line", r"[^A-Za-z]", "")) >= 40))
        .join(where, "id")
        .groupBy("skel")
        .agg(F.count_distinct("id").alias("docs"), F.count_distinct("site").alias("sites"))
        .where((F.col("docs") >= 3) & (F.col("sites") >= 3))
        .select("skel", F.lit(True).alias("shown"))
    )
    letters = F.length(F.regexp_replace("line", r"[^A-Za-z]", ""))
    lost = F.col("line").contains("�") | F.col("line").rlike(r"[\x80-\x84\x86-\x9f]")
    state = (
        F.when(F.col("shown"), "shown")
        .when(F.col("changed"), "restored")
        .when(lost & (F.col("n_twins") == 1) & (letters >= 12), "twin")
        .when(lost, "lost")
        .otherwise("clean")
    )
    out = done.join(sized(shown), "skel", "left").withColumn("state", state)
    return out.select("id", "field", "line_no", "line", F.when(F.col("state") == "twin", F.col("twin")).when(F.col("state") == "restored", F.col("restored")).otherwise(F.col("line")).alias("restored"), "state", "rare")
