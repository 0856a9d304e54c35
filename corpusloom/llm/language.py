"""The language of documents and of the stretches of mixed ones, by hierarchical discrimination.

First the family: Han and Cyrillic by their script; a linear support vector machine tells the Germanic from the Romance family.
Inside a family one linear machine per pair of languages separates close relatives, and each pair votes by its margin.
Features are the hashed words of a line and their character trigrams, in lower case; of words that the sample hardly knows only
their ends, as most are names. A fixed number of slots makes the machines a small array that is sent to all tasks. They are fitted on the driver on a bounded sample of labelled documents (SAMPLE rows, drawn by a hash
of the id), twice: labels may be wrong, so lines that the first fit clearly contradicts are left out of the second.

Lines that are not the record's own (site lines, furniture) are ignored, garbled ones are read as they were written. The main
language has the most characters of own text. The confidence is a logistic of the margin.

Defined cases: null, empty and very short texts get no language (null); a label is understood only in the spellings of the
alias table; ties between main languages go to the alphabetically first; repeated rows are judged each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np

LATIN_FAMILIES = {"germanic": ("de", "en"), "romance": ("es", "fr", "pt")}
LANGUAGES = ("de", "en", "es", "fr", "pt", "ru", "zh")
SLOTS = 1 << 13
#: Bounds of the sample that the machines are fitted on: labelled documents, lines of each language and of each document, and
#: characters of a line. Only fitting is bounded; every line of every document is classified.
SAMPLE = 1_500
LINES = 700
RECORD_LINES = 20
LINE_CHARS = 2_000
#: What a Latin word inside another script counts that hardly occurs in the sample; most are names.
UNKNOWN = 0.5
#: Letters that say as much as a Han character.
HAN_LETTERS = 4

_HAN = re.compile(r"[㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_OTHER_SCRIPT = re.compile(r"[㐀-鿿Ѐ-ӿ]")
_LATIN_WORD = re.compile(r"[a-zÀ-ɏ]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
_WORD = re.compile(r"[^\W\d_]+|\n")


def word_slots(word: str, known: bool = True) -> list[int]:
    """Slots of a word and of its trigrams, with its borders; of a word that the sample hardly knows, of its beginning and endings,
    which tell most of its language."""
    padded = f" {word} ".encode("utf-8", "surrogatepass")
    if not known:
        return [zlib.crc32(padded[:4]) % SLOTS, zlib.crc32(padded[-4:]) % SLOTS, zlib.crc32(padded[-3:]) % SLOTS]
    padded = f" {word} "
    return [zlib.crc32(padded.encode("utf-8", "surrogatepass")) % SLOTS, *(zlib.crc32(padded[i : i + 3].encode("utf-8", "surrogatepass")) % SLOTS for i in range(len(padded) - 2))]


def without_addresses(line: str) -> str:
    return _ADDRESS.sub(" ", line) if "://" in line or "www." in line else line


def words_of(text: str) -> list[str]:
    """The words of lines in lower case, taken apart at apostrophes too, without figures; the ends of lines stand among them."""
    return _WORD.findall(text.lower())


class _Rows(dict):
    """Row of each word in the table of a process, made when first asked for; -1 for the end of a line."""

    def __init__(self, machines: Machines) -> None:
        super().__init__({"\n": -1})
        self.machines = machines

    def __missing__(self, word: str) -> int:
        self[word] = row = self.machines.add(word)
        return row


@dataclass
class Machines:
    """Weights of the linear machines: one column for the family, one for each pair inside a family."""

    weights: np.ndarray
    bias: np.ndarray
    columns: tuple[tuple[str, str], ...]
    vocabulary: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        # caches of this process: summed weights of each word, the last column counting its features
        self._table = np.zeros((1024, self.weights.shape[1] + 1))
        self._used = 0
        self._rows = _Rows(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def add(self, word: str) -> int:
        if self._used == len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        slots = word_slots(word, word in self.vocabulary)
        self._table[self._used, :-1] = self.weights[slots].sum(axis=0)
        self._table[self._used, -1] = len(slots)
        self._used += 1
        return self._used - 1

    def margins(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margin of every line under every machine, and its number of words; feature counts are scaled to unit length. The words of
        all lines are found at once."""
        out, words = np.zeros((len(lines), len(self.columns))), np.zeros(len(lines), dtype=np.int64)
        rows = np.fromiter(map(self._rows.__getitem__, words_of("\n".join(map(without_addresses, lines)))), dtype=np.int64)
        line = np.cumsum(rows < 0)[rows >= 0]
        rows = rows[rows >= 0]
        if len(rows):
            starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            sums = np.add.reduceat(self._table[rows], starts, axis=0)
            out[line[starts]] = sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1.0))
            words[line[starts]] = np.diff(np.append(starts, len(rows)))
        if self._used > 200_000:
            self.__post_init__()
        return out + self.bias, words

    def classify(self, lines: list[str]) -> tuple[list[str | None], np.ndarray]:
        """Language and confidence of every line; None for a line without letters."""
        langs: list[str | None] = [None] * len(lines)
        conf = np.zeros(len(lines))
        latin = []
        for i, x in enumerate(lines):
            if x.isascii():
                latin.append(i)
                continue
            if not _OTHER_SCRIPT.search(x):
                latin.append(i)
                continue
            x = _ADDRESS.sub(" ", x) if "://" in x else x
            han, cyr = len(_HAN.findall(x)), len(_CYRILLIC.findall(x))
            if not han and not cyr:
                latin.append(i)
                continue
            # names and units are in Latin letters inside any script, and a quotation may be in another one
            lat = sum(len(w) * (1.0 if w in self.vocabulary else UNKNOWN) for w in _LATIN_WORD.findall(x.lower()))
            if 2 * han >= lat and 2 * han >= cyr and han:
                langs[i], conf[i] = "zh", HAN_LETTERS * han / (HAN_LETTERS * han + lat + cyr)
            elif cyr and cyr >= 0.7 * lat:
                langs[i], conf[i] = "ru", cyr / (han + lat + cyr)
            else:
                latin.append(i)
        if latin:
            m, words = self.margins([lines[i] for i in latin])
            names, sure = self.decide(m)
            for row, i in enumerate(latin):
                if words[row] and _LATIN.search(lines[i]):
                    langs[i], conf[i] = names[row], sure[row]
        return langs, conf

    def decide(self, m: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each row of margins: the family first, then the votes of the pairs inside it."""
        names = [lang for f in LATIN_FAMILIES.values() for lang in f]
        votes = np.zeros((len(m), len(names)))
        for k, (a, b) in enumerate(self.columns[1:], 1):
            votes[:, names.index(a)] += m[:, k]
            votes[:, names.index(b)] -= m[:, k]
        german = np.array([n in LATIN_FAMILIES["germanic"] for n in names])
        inside = np.where((m[:, :1] > 0) == german, votes, -np.inf)
        order = np.argsort(-inside, axis=1, kind="stable")
        at = np.arange(len(m))
        pairs = np.where(m[:, 0] > 0, len(LATIN_FAMILIES["germanic"]), len(LATIN_FAMILIES["romance"])) - 1
        gap = (inside[at, order[:, 0]] - inside[at, order[:, 1]]) / pairs
        return [names[i] for i in order[:, 0]], 1 / (1 + np.exp(-2.0 * np.minimum(np.abs(m[:, 0]), gap)))


def _columns() -> tuple[tuple[str, str], ...]:
    pairs = [(a, b) for f in LATIN_FAMILIES.values() for i, a in enumerate(f) for b in f[i + 1 :]]
    return (("germanic", "romance"), *pairs)


def _svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, lam: float = 5e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """A linear machine by stochastic sub-gradients of the hinge loss, averaged over the last half."""
    w, b = np.zeros(SLOTS), 0.0
    total, total_b, n, t = np.zeros(SLOTS), 0.0, 0, 1.0
    rng = np.random.default_rng(seed)
    scale = 1.0
    for epoch in range(epochs):
        for i in rng.permutation(len(x)):
            slots, values = x[i]
            rate = 1 / (lam * (t + 400))
            t += 1
            margin = y[i] * (scale * (w[slots] @ values) + b)
            scale *= 1 - rate * lam
            if margin < 1:
                w[slots] += rate * y[i] * values / scale
                b += 0.05 * rate * lam * y[i]
        if scale < 1e-3:
            w, scale = w * scale, 1.0
        if epoch >= epochs // 2:
            total, total_b, n = total + scale * w, total_b + b, n + 1
    return total / max(n, 1), total_b / max(n, 1)


def fit(samples: list[tuple[str, str]], rounds: int = 2) -> Machines:
    """Machines from (language, line) pairs, of which some labels may be wrong; only Latin-script lines are used."""
    by: dict[str, list[str]] = {}
    seen = Counter(w for line in {line for _, line in samples} for w in set(words_of(without_addresses(line))))
    vocabulary = frozenset(w for w, n in seen.items() if n >= 3)
    for lang, line in samples:
        if any(lang in f for f in LATIN_FAMILIES.values()) and len(_LATIN.findall(line)) >= 0.6 * len(line.replace(" ", "")) and len(line) >= 15:
            by.setdefault(lang, []).append(without_addresses(line))
    kept = {lang: lines[:LINES] for lang, lines in by.items()}
    machines = Machines(np.zeros((SLOTS, len(_columns()))), np.zeros(len(_columns())), _columns(), vocabulary)
    family_of = {lang: f for f, langs in LATIN_FAMILIES.items() for lang in langs}
    for r in range(rounds):
        rows = [(lang, line) for lang, lines in kept.items() for line in lines]
        feats = []
        for _, line in rows:
            words = words_of(line)
            slots, counts = np.unique(np.array([x for w in words for x in word_slots(w, w in vocabulary)], dtype=np.int64), return_counts=True)
            feats.append((slots, counts / np.sqrt(max(counts.sum(), 1))))
        machines.__post_init__()
        for k, (a, b) in enumerate(machines.columns):
            side = [(1.0 if (family_of[lang] if k == 0 else lang) == a else -1.0 if (family_of[lang] if k == 0 else lang) == b else 0.0) for lang, _ in rows]
            pick = [i for i, s in enumerate(side) if s]
            if len({side[i] for i in pick}) < 2:
                machines.bias[k] = side[pick[0]] if pick else 0.0
                continue
            machines.weights[:, k], machines.bias[k] = _svm([feats[i] for i in pick], np.array([side[i] for i in pick]), seed=k)
        if r + 1 < rounds:
            for lang, lines in kept.items():
                said, sure = machines.decide(machines.margins(lines)[0])
                good = [x for x, s, c in zip(lines, said, sure, strict=True) if s == lang or c < 0.7]
                kept[lang] = good if len(good) >= 0.5 * len(lines) else lines
    return machines
