"""Evaluation texts inside training texts.

The normalised test items make one suffix automaton; each document's words are streamed through it
with the length of the longest match, and wherever that reaches the limit the items are noted that
hold the last words. Documents are not shuffled, and a document of any length is one pass. Items
beyond the size of one automaton are split over several, each with its own pass.

Defined results: a word is a run of letters and digits, compared without case; null texts hold
nothing; items of fewer words than the limit are held by no document; repeated rows come out once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.automaton import SuffixAutomaton

LEAST_WORDS = 12
#: Characters of items in one automaton, which is sent to every Python worker: measured at 7 MB for words of 3 characters, less for longer ones.
AUTOMATON_CHARACTERS = 1 << 19

_WORD = re.compile(r"[^\W_]+")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _automata(items: DataFrame, least: int, characters: int) -> Iterator[tuple]:
    """(broadcast of (item ids, automaton)) for parts of the items of bounded size."""
    kept = items.where("text is not null and item_id is not null").select("item_id", "text")
    total = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // characters)
    for part in range(parts):
        mine = kept if parts == 1 else kept.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = sorted((r.item_id, r.text) for r in mine.collect())
        automaton = SuffixAutomaton([normalised(text) for _, text in rows], least)
        yield items.sparkSession.sparkContext.broadcast(([i for i, _ in rows], automaton))


def _holding(automaton: SuffixAutomaton, text: str) -> set[int]:
    """Numbers of the automaton's items that the text holds."""
    holding: set[int] = set()
    last = None
    for _, _, held in automaton.matches(normalised(text)):
        if held is not last:
            holding.update(held)
            last = held
    return holding


def _noted(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Add what one automaton finds to the items held; the text goes on to the next one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_ids, automaton = shared.value
        for batch in batches:
            held = [[*before, *[item_ids[i] for i in _holding(automaton, text)]] for text, before in zip(batch["text"], batch["held"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "held": held})

    return run


def _search(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_ids, automaton = shared.value
        for batch in batches:
            found = []
            for doc_id, text, before in zip(batch["doc_id"], batch["text"], batch["held"], strict=True):
                found += [(doc_id, item) for item in (*before, *[item_ids[i] for i in _holding(automaton, text)])]
            yield pd.DataFrame(found, columns=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, characters: int = AUTOMATON_CHARACTERS) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``least`` consecutive words of the item.

    However many automata there are, the documents are read once and pass through them one after the other.
    """
    shared = list(_automata(items, least, characters))
    if not shared:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long")
    rows = documents.where("text is not null").select("doc_id", "text", F.array().cast("array<long>").alias("held"))
    for part in shared[:-1]:
        rows = rows.mapInPandas(_noted(part), "doc_id long, text string, held array<long>")
    return rows.mapInPandas(_search(shared[-1]), "doc_id long, item_id long").distinct()


def _mark(shared) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Add what one automaton finds in the text to the hits: first word and the one after the last, alternately."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, automaton = shared.value
        for batch in batches:
            hits = []
            for text, before in zip(batch["text"], batch["hits"], strict=True):
                spans = list(before)
                for last, length, _ in automaton.matches(m.group().lower() for m in _WORD.finditer(text or "")):
                    first = last - length + 1
                    if len(spans) > len(before) and first <= spans[-1]:
                        spans[-2:] = [min(first, spans[-2]), last + 1]
                    else:
                        spans += [first, last + 1]
                hits.append(spans)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": batch["text"], "hits": hits})

    return run


def _cut(coverage: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def cleaned(text: str | None, spans: list[int]) -> tuple[int, float, str | None]:
        if not text:
            return 0, 0.0, text
        places = [m.span() for m in _WORD.finditer(text)]
        hit = [False] * len(places)
        for first, end in zip(spans[::2], spans[1::2], strict=True):
            hit[first:end] = [True] * (end - first)
        share = sum(hit) / len(hit) if hit else 0.0
        if share > coverage:
            return sum(hit), share, None
        pieces, at = [], 0
        for i, (begin, end) in enumerate(places):
            if hit[i]:
                if i == 0 or not hit[i - 1]:
                    pieces.append(text[at:begin])
                at = end
        return sum(hit), share, "".join([*pieces, text[at:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *cleaned(t, h)) for d, t, h in zip(batch["doc_id"], batch["text"], batch["hits"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "removed_words", "share", "text"])

    return run


def decontaminated(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, coverage: float = 0.5, characters: int = AUTOMATON_CHARACTERS) -> DataFrame:
    """(doc_id, removed_words, share, text) with leaked spans cut out; text is null where they cover more than ``coverage``.

    Every automaton sees the original text; the spans of all of them are united and cut once.
    """
    rows = documents.select("doc_id", "text", F.array().cast("array<int>").alias("hits"))
    for shared in _automata(items, least, characters):
        rows = rows.mapInPandas(_mark(shared), "doc_id long, text string, hits array<int>")
    return rows.mapInPandas(_cut(coverage), "doc_id long, removed_words long, share double, text string")
