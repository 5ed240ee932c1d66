"""Held-out evaluation texts inside a corpus, found by one Aho-Corasick automaton.

A passage of ``min_words`` words shared with an item contains a shorter run of words that begins in
the item at a multiple of a stride; the automaton holds these runs only, a small part of all that
could be shared.  Each document is normalised once and read once; a run that is met is extended in
document and item alike as far as their words agree, which gives the longest passages exactly.  The
place of a passage is given in characters of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.words import WORD, words

MIN_WORDS = 12
#: Characters of evaluation text in one automaton (some 50 bytes of memory for each); more items take another pass over the corpus.
AUTOMATON_CHARS = 5_000_000

PASSAGES = "doc string, item string, start long, end long, item_word long, n_words long"


@dataclass
class ItemAutomaton:
    """The runs of items' words, each with the places (text number, first word) it stands at."""

    min_words: int
    items: list[tuple[str, list[str], int]] = field(default_factory=list)  # identifier, words, least words of a passage
    automaton: Any = None


def build_automaton(items: list[tuple[str, str]], min_words: int, whole_from: int | None = None) -> ItemAutomaton | None:
    """Automaton over the items; None where none of them can be found.

    Items of fewer words than ``min_words`` but ``whole_from`` or more are found where they stand whole.
    """
    import ahocorasick

    run = max(1, min_words // 2)
    stride = min_words - run + 1
    made, places = ItemAutomaton(min_words), {}
    for item, text in items:
        normal = words(text)
        short = len(normal) < min_words
        if short and (whole_from is None or len(normal) < max(1, whole_from)):
            continue
        made.items.append((item, normal, min(len(normal), min_words)))
        for at in [0] if short else range(0, len(normal) - run + 1, stride):
            places.setdefault(" " + " ".join(normal if short else normal[at : at + run]) + " ", []).append((len(made.items) - 1, at))
    if not places:
        return None
    made.automaton = ahocorasick.Automaton()
    for key, where in places.items():
        made.automaton.add_word(key, (len(key), where))
    made.automaton.make_automaton()
    return made


def passages(text: str, held: ItemAutomaton) -> list[tuple[str, int, int, int, int]]:
    """(item, first character, end, first word of the item, words) of every longest shared passage."""
    found = words(text)
    line = " " + " ".join(found) + " "
    hits = [(end + 1 - size, where) for end, (size, where) in held.automaton.iter(line)]
    if not hits:
        return []
    number, at = {}, 0  # offset in the line -> number of the word that begins there
    for n, word in enumerate(found):
        number[at] = n
        at += len(word) + 1
    reached: dict[tuple[int, int], int] = {}  # (item, word in document - word in item) -> where the last passage there ends
    done = set()
    for begin, where in hits:
        place = number[begin]
        for item, at in where:
            shift = place - at
            if place < reached.get((item, shift), 0):
                continue
            name, own, least = held.items[item]
            first, last = at, at
            while first and shift + first and own[first - 1] == found[shift + first - 1]:
                first -= 1
            while last < len(own) and shift + last < len(found) and own[last] == found[shift + last]:
                last += 1
            reached[item, shift] = shift + last
            if last - first >= least:
                done.add((name, shift + first, shift + last, first))
    if not done:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    return sorted((name, spans[a][0], spans[b - 1][1], at, b - a) for name, a, b, at in done)


def _batches(items: list[tuple[str, str]], most: int) -> list[list[tuple[str, str]]]:
    batches, size = [[]], 0
    for item, text in items:
        if batches[-1] and size + len(text) > most:
            batches.append([])
            size = 0
        batches[-1].append((item, text))
        size += len(text)
    return batches


_last: list = []


def _automaton(shared, min_words: int, whole_from: int | None) -> ItemAutomaton | None:
    """The automaton of a broadcast block of items, built once in a Python worker."""
    block = shared.value
    if not _last or _last[0] is not block or _last[1:3] != [min_words, whole_from]:
        _last[:] = [block, min_words, whole_from, build_automaton(block, min_words, whole_from)]
    return _last[3]


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    whole_from: int | None = None,
    automaton_chars: int = AUTOMATON_CHARS,
) -> DataFrame:
    """``doc, item, start, end, item_word, n_words``: each longest passage of at least ``min_words`` words.

    ``start`` and ``end`` are characters of the document, ``item_word`` is the passage's first word
    in the item.  Only letters and digits count, in any case and layout.  Items of fewer words give
    nothing, or with ``whole_from`` those of so many words and more are reported where they stand
    whole.  Null texts and null identifiers give nothing; repeated items of one identifier are one;
    repeated documents are each reported.  Evaluation text is held-out material of stated size: it
    is sent to the executors in blocks of ``automaton_chars`` characters, one pass over the
    documents each.
    """
    held = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).cast("string").alias("_d"), F.col(text).cast("string").alias("_t")).where("_d is not null and _t is not null")
    found = None
    for batch in _batches([tuple(r) for r in held.distinct().orderBy("i", "t").toLocalIterator()], automaton_chars):
        shared = spark.sparkContext.broadcast(batch)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton = _automaton(shared, min_words, whole_from)
            for frame in frames:
                out = []
                if automaton is not None:
                    for doc, value in frame.itertuples(index=False, name=None):
                        out += [(doc, *p) for p in passages(value, automaton)]
                yield pd.DataFrame(out, columns=["doc", "item", "start", "end", "item_word", "n_words"])

        part = rows.mapInPandas(run, PASSAGES)
        found = part if found is None else found.unionByName(part)
    return found


def leaks(passages_found: DataFrame) -> DataFrame:
    """``doc, item, passages, longest``: which items leaked into which documents."""
    return passages_found.groupBy("doc", "item").agg(F.countDistinct("start", "end").alias("passages"), F.max("n_words").alias("longest"))
