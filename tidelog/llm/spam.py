"""Pages made of repeated keywords, link lists or product tags instead of sentences.

Every line is cut into units (sentences, list entries, cells) and each unit is reduced to a Shape: what
separates it, whether it is a link, its number of words, its capitals, and whether its words are worn
(seen again and again beside it or over the whole page). A shape alone says whether it is a sentence,
an entry of a spam list, or structure (logs, settings, tables, code). A page's words are grouped by
shape, and the page is spam if few shapes of spam entries hold more than half of its words.

Defined results: null, empty and blank texts and texts without a word are no spam; a page is judged
over its whole text; repetition of fewer than 12 words is not judged; repeated rows come out once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A page is spam if so many shapes at most hold more than this share of its words.
FEW_SHAPES, SPAM_SHARE = 8, 0.5
#: Words around a unit among which repetition is measured, and distinct words per word below which they are worn.
WINDOW, WORN = 60, 0.48
#: Entries between commas name things without the words of a sentence, so all those of a page are judged together, and
#: sooner; a glossary repeats few of its words.
ENTRY_WORN = 0.75
#: Number of words from which WORN holds. From SHORT_WORDS on SHORT_WORN does, as a few words of prose may
#: repeat by chance; plain pages of that length were measured at 0.39 and more. Fewer words are never worn.
LEAST_WORDS = 40
SHORT_WORDS, SHORT_WORN = 12, 0.36
#: A unit of so many words of which so many are distinct is a sentence, even if the page repeats it (unless it
#: is a reordering, see MIXED); one shorter than LONG_WORDS only where the words around it are not as few as SPARSE or fewer than LEAST_WORDS.
SENTENCE_WORDS, SENTENCE_DISTINCT, LONG_WORDS, SPARSE = 8, 0.85, 11, 0.33
#: Over the whole page, units most of whose words recur are worn if they share few distinct words and their
#: neighbouring words repeat no more often than words in random order would: at most MIXED times as often, with
#: LEAST_PAIRS repeats to be expected. Prose and templates repeat pairs more than twice as often, in any language.
RECURRING, MIXED, LEAST_PAIRS = 0.8, 1.5, 5
#: Entries that make a list; fewer links or tags in a page are ordinary. Cells that make a line a row of them.
LEAST_ENTRIES, LEAST_CELLS, LEAST_PIECES = 3, 4, 8

_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\"']+")
#: Endings of file names, which look like hosts.
FILE_ENDINGS = "c cfg conf cpp csv gz h html ini java jpg js json log md parquet pdf png py rs sh sql toml ts txt xml yaml yml zip".split()
_HOST = re.compile(r"(?:https?://)?(?:[a-z0-9][\w-]*\.)+(?!(?:" + "|".join(FILE_ENDINGS) + r")\b)[a-z]{2,}(?::\d+)?(?:/\S*)?", re.I)
_FILE = re.compile(r"[\w./\\-]*\w\.(?:" + "|".join(FILE_ENDINGS) + r")", re.I)
_LOG = re.compile(r"^\W*\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d")
_SETTING = re.compile(r"^\s*[\w.\-]+\s*=\s*\S*\s*$")
_CODE = re.compile(r"[A-Za-z_]\w*\([^()]*[),]|[{}]\s*$|[=!<>]=|^\s*(?:def|class|import|return|const|function|public|private)\b.*[(={]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])\s*(?=\S)")
_TAG = re.compile(r"(?:^|\s)(?:#[\w-]+|[^\W\d_][\w-]*:[\w-]+)(?=\s|$|[,;])")
_ANCHOR = re.compile(r"<a\s[^>]*href", re.I)
_ANCHOR_END = re.compile(r"</li>|<br\s*/?>|</a>", re.I)
_CELL = re.compile(r" [|·•] ")
_PIECE = re.compile(r"[,;]")
_CODE_SIGNS = frozenset("({}=")

LIST_KINDS = ("link", "tag", "product")


class Shape(NamedTuple):
    """separator: line, comma, cell, tag, row, log, setting or code; links: the unit is an address, perhaps with its title;
    words: their number, in steps of a power of two from 4 on; capitals: A, a, Aa or aA; worn: its words are repeated."""

    separator: str
    links: bool
    words: int
    capitals: str
    worn: bool

    @property
    def kind(self) -> str | None:
        """link, tag, product or keyword for entries of spam lists; None for sentences and structure."""
        if self.separator in ("log", "row", "setting", "code"):
            return None
        if self.links:
            return "link"
        if self.separator == "tag":
            return "tag"
        if self.separator == "cell" and self.words <= 8:
            return "product"
        return "keyword" if self.worn else None


def _numbers(cells: list[str]) -> float:
    """The share of cells that have digits and no letters."""
    return sum(any(c.isdigit() for c in x) and not any(c.isalpha() for c in x) for x in cells) / len(cells)


def _units(text: str) -> Iterator[tuple[str, bool, str]]:
    """(separator, whether it is a link, unit) in order. A pattern is tried only where a line has its characters."""
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            continue
        if _LOG.match(line):
            yield "log", False, line
        elif bare[0] == "|":
            yield "row", False, line
        elif "=" in line and _SETTING.match(line):
            yield "setting", False, line
        elif "<" in line and _ANCHOR.search(line):
            for part in _ANCHOR_END.split(line):
                yield "line", bool(_ANCHOR.search(part)), part
        elif not _CODE_SIGNS.isdisjoint(line) and _CODE.search(line) and not _address(line):
            yield "code", False, line
        else:
            yield from _of_line(line)


def _address(text: str) -> bool:
    return ("://" in text or "www." in text) and bool(_URL.search(text))


def _of_line(line: str) -> Iterator[tuple[str, bool, str]]:
    if line.count(" | ") + line.count(" · ") + line.count(" • ") >= LEAST_CELLS - 1:
        cells = _CELL.split(line)
        separator = "row" if _numbers(cells) >= 0.25 or sum(len(_WORD.findall(c)) < 2 for c in cells) > len(cells) / 2 else "cell"
        for cell in cells:
            yield separator, False, cell
        return
    if line.count(".") >= 0.4 * len(line.split()):  # separators may stand between the addresses
        tokens = [t.strip(",;()<>[]\"'") for t in line.split() if _WORD.search(t)]
        dotted = sum("." in t for t in tokens)
        if dotted >= 0.8 * len(tokens):
            if sum(bool(_FILE.fullmatch(t)) for t in tokens) >= 0.8 * len(tokens):
                yield "code", False, line
                return
            if sum(bool(_HOST.fullmatch(t)) for t in tokens) >= 0.8 * len(tokens):
                for token in tokens:
                    yield "line", True, token
                return
    if line.count(",") + line.count(";") >= LEAST_PIECES - 1 and not _address(line):
        pieces = _PIECE.split(line)
        if sum(len(_WORD.findall(p)) for p in pieces) <= 4 * len(pieces):
            separator = "row" if _numbers(pieces) >= 0.25 else "comma"
            for piece in pieces:
                yield separator, False, piece
            return
    for part in _SENTENCE.split(line):
        yield "line", False, part


def _is_link(unit: str) -> bool:
    """An address with a short title before it."""
    if not _address(unit):
        return False
    outside = len(_WORD.findall(_URL.sub(" ", unit)))
    return outside <= 10 and len(_WORD.findall(_URL.split(unit)[-1])) <= 2


def _capitals(words: list[str]) -> str:
    """How the words begin: A for all capitals, a for none, Aa for the first only, aA for some."""
    upper = sum([w[0].isupper() for w in words])
    return "a" if not upper else "A" if upper == len(words) else "Aa" if upper == 1 and words[0][0].isupper() else "aA"


def _mixed(units: list[list[str]]) -> list[bool]:
    """Which units are keywords in random order, as reordered or cycled over the page; lines as they are in sentences are not."""
    seen = Counter(w for words in units for w in words)
    recurring = [sum([seen[w] > 1 for w in words]) >= RECURRING * len(words) for words in units]
    chosen = [words for words, recurs in zip(units, recurring, strict=True) if recurs]
    if sum(map(len, chosen)) < LEAST_WORDS:
        return [False] * len(units)
    counts = Counter(w for words in chosen for w in words)
    total = counts.total()
    if len(counts) >= WORN * total:
        return [False] * len(units)
    pairs = Counter(pair for words in chosen for pair in zip(words, words[1:], strict=False))
    n = pairs.total()
    expected = n * (n - 1) / 2 * sum((c / total) ** 2 for c in counts.values()) ** 2
    repeats = sum(c * (c - 1) / 2 for c in pairs.values())
    return recurring if expected >= LEAST_PAIRS and repeats <= MIXED * expected else [False] * len(units)


def _step(words: int) -> int:
    return words if words < 4 else 1 << (words.bit_length() - 1)


class _Unit(NamedTuple):
    separator: str
    links: bool
    entries: int
    words: list[str]
    capitals: str


def _read(text: str) -> list[_Unit]:
    found = []
    for separator, links, unit in _units(text):
        words = _WORD.findall(unit)
        if not words:
            continue
        entries = 1
        if separator == "line" and not links:
            links = _is_link(unit)
            tags = [] if links or not ("#" in unit or ":" in unit) else _TAG.findall(unit)
            if tags and sum(len(_WORD.findall(t)) for t in tags) >= 0.8 * len(words):
                separator, entries = "tag", len(tags)
        found.append(_Unit(separator, links, entries, " ".join(words).lower().split(), _capitals(words)))
    return found


def _worn(units: list[_Unit]) -> list[bool]:
    """Which units have words that repeat around them or over the page; only what may be a sentence or a keyword is judged."""
    judged = [u.separator == "line" and not u.links for u in units]
    listed = [w for u in units if u.separator == "comma" for w in u.words]
    listed_worn = len(listed) >= SHORT_WORDS and len(set(listed)) < ENTRY_WORN * len(listed)
    flow_units = [u.words for u, j in zip(units, judged, strict=True) if j]
    flow = [w for words in flow_units for w in words]
    mixed = iter(_mixed(flow_units))
    result, at = [], 0
    for unit, counts in zip(units, judged, strict=True):
        if not counts:
            result.append(listed_worn and unit.separator == "comma")
            continue
        words = unit.words
        middle = at + len(words) // 2
        at += len(words)
        distinct = len(set(words)) >= SENTENCE_DISTINCT * len(words)
        if distinct and len(words) >= LONG_WORDS:  # a sentence whatever stands around it
            result.append(next(mixed))
            continue
        low = max(0, min(middle - WINDOW // 2, len(flow) - WINDOW))
        window = flow[low : low + max(WINDOW, len(words))]
        novelty = len(set(window)) / len(window) if len(window) >= SHORT_WORDS else 1.0
        short = len(window) < LEAST_WORDS
        sentence = distinct and len(words) >= SENTENCE_WORDS and (novelty >= SPARSE or short)
        result.append(next(mixed) or (novelty < (SHORT_WORN if short else WORN) and not sentence))
    return result


def shapes(text: str) -> list[tuple[Shape, int, int]]:
    """(shape, words, entries) of every unit with words, in order."""
    units = _read(text)
    return [(Shape(u.separator, u.links, _step(len(u.words)), u.capitals, worn), len(u.words), u.entries) for u, worn in zip(units, _worn(units), strict=True)]


def spam_share(text: str | None) -> float:
    """The share of a text's words in the few shapes of spam entries that hold most of them."""
    if not text:
        return 0.0
    words: Counter[Shape] = Counter()
    entries: Counter[Shape] = Counter()
    for shape, n, listed in shapes(text):
        words[shape] += n
        entries[shape] += listed
    of_kind: Counter[str | None] = Counter()
    for shape, n in entries.items():
        of_kind[shape.kind] += n
    total = words.total()
    spam = [n for shape, n in words.items() if shape.kind == "keyword" or (shape.kind in LIST_KINDS and of_kind[shape.kind] >= LEAST_ENTRIES)]
    return sum(sorted(spam, reverse=True)[:FEW_SHAPES]) / total if total else 0.0


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "share": [spam_share(t) for t in batch["text"]]})


def spam_pages(documents: DataFrame, share: float = SPAM_SHARE) -> DataFrame:
    """(doc_id, share) of the documents of which few spam shapes hold more than ``share`` of the words."""
    texts = documents.select("doc_id", "text").where("text is not null")
    return texts.mapInPandas(_judged, "doc_id long, share double").where(F.col("share") > share).distinct()
