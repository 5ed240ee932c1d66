"""Splitting texts over a token limit at natural boundaries, with overlap.

Recursive bisection: a span whose tokens exceed the limit less the overlap is cut at the strongest
boundary near its middle, or without one there at the boundary nearest to it, and both halves are
treated alike; then every piece but the first is extended backwards by ``overlap`` tokens, so that
it shares exactly those with the piece before.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.words import TOKEN, data_of

#: Limit where a shelf states none, or has no row.
DEFAULT_LIMIT = 8192

#: Boundaries by falling strength, as patterns whose match end starts a new piece: before a heading,
#: after a blank line, after a sentence's end, after a line's end, after a clause, after white space.
_HEADING = re.compile(r"(?m)^(?=#{1,6}\s)")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][”’」』）]*\s*")
_LINE = re.compile(r"\n\s*")
_CLAUSE = re.compile(r"[,;:]\s+|[，；：、]")
_SPACE = re.compile(r"\s+")
_STRENGTHS = ((6, _HEADING), (5, _PARAGRAPH), (4, _SENTENCE), (3, _LINE), (2, _CLAUSE), (1, _SPACE))


def token_starts(text: str) -> list[int]:
    return [m.start() for m in TOKEN.finditer(text)]


def boundary_strengths(text: str, starts: list[int]) -> dict[int, int]:
    """For tokens that follow a boundary: its strength.  Other tokens follow none (strength 0)."""
    found: dict[int, int] = {}
    for strength, pattern in _STRENGTHS:
        for match in pattern.finditer(text):
            token = bisect_left(starts, match.end())
            if 0 < token < len(starts):
                found.setdefault(token, strength)
    return found


def cut_points(n: int, strengths: dict[int, int], room: int, overlap: int = 0) -> list[int]:
    """Token numbers at which pieces begin.

    No piece exceeds ``room`` tokens, but for the first, which has more than ``overlap`` as it gives
    those to the next, and so ``overlap`` + 1 where ``room`` is no larger.
    """
    if n <= room:
        return [0]
    order = sorted(strengths)
    cuts, open_spans = [0], [(0, n)]
    while open_spans:
        low, high = open_spans.pop()
        size = high - low
        if size <= room or high <= overlap + 1:
            continue
        # The middle half of the span; in it the strongest boundary, of equals the one nearest the middle.
        middle, reach = low + size / 2, max(1, size // 4)
        least = max(low, overlap) + 1
        near = order[bisect_left(order, max(least, middle - reach)) : bisect_left(order, min(high, middle + reach + 1))]
        if not near:  # the closest boundary on either side
            at = bisect_left(order, middle)
            near = [t for t in order[max(0, at - 1) : at + 1] if least <= t < high]
        cut = min(near, key=lambda t: (-strengths[t], abs(t - middle), t)) if near else max(least, low + size // 2)
        cuts.append(cut)
        open_spans += [(low, cut), (cut, high)]
    return sorted(cuts)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces of a text as (first character, end, first token, tokens).

    A text within the limit is one piece.  An overlap as large as the limit is lowered to the limit
    less 1, the most with which pieces advance; a limit below 1 counts as 1.
    """
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    starts = token_starts(text)
    n = len(starts)
    if n <= limit:
        return [(0, len(text), 0, n)]
    cuts = cut_points(n, boundary_strengths(text, starts), limit - overlap, overlap)
    pieces = []
    for number, cut in enumerate(cuts):
        last = number == len(cuts) - 1
        end_token = n if last else cuts[number + 1]
        first_token = max(0, cut - overlap)
        begin = 0 if number == 0 else starts[first_token]
        end = len(text) if last else starts[end_token]
        pieces.append((begin, end, first_token, end_token - first_token))
    return pieces


PIECES = "id string, piece int, pieces int, start long, end long, first_token long, n_tokens long, text string"


def split_oversized(df: DataFrame, id: str, text: str, limit: Column, overlap: Column, json_data: bool = False, only_split: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of every text: ``id, piece, pieces, start, end, first_token, n_tokens, text``.

    ``limit`` and ``overlap`` are column expressions over ``df`` in tokens; a null limit is
    ``DEFAULT_LIMIT``, a null overlap 0.  With ``json_data`` the text is field ``data`` of the JSON
    in that column.  Pieces cover the whole text; each but the first begins ``overlap`` tokens
    before the end of the one before.  Null texts and content without data give no row; an empty
    text is one empty piece; a null id is kept as it is; repeated rows give repeated pieces.
    ``only_split`` leaves out texts that are one piece: a text of no more characters than the limit
    is then not even tokenised, for a token is at least one character.
    """
    rows = df.select(F.col(id).cast("string").alias("_id"), F.col(text).cast("string").alias("_text"), F.coalesce(limit.cast("long"), F.lit(DEFAULT_LIMIT)).alias("_limit"), F.coalesce(overlap.cast("long"), F.lit(0)).alias("_overlap"))
    rows = rows.where(F.col("_text").isNotNull())
    if only_split:
        rows = rows.where(F.length("_text") > F.col("_limit"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, value, most, shared in frame.itertuples(index=False, name=None):
                if json_data and (value := data_of(value)) is None or only_split and len(value) <= most:
                    continue
                pieces = split_text(value, int(most), int(shared))
                if only_split and len(pieces) == 1:
                    continue
                out += [(key, i, len(pieces), a, b, first, n, value[a:b] if with_text else None) for i, (a, b, first, n) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["id", "piece", "pieces", "start", "end", "first_token", "n_tokens", "text"])

    return rows.mapInPandas(run, PIECES)


def split_knowledge(knowledge: DataFrame, local_config: DataFrame, only_split: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of ``content.data`` of each knowledge row, by the limit and overlap of its shelf.

    Columns as for :func:`split_oversized`, ``id`` being the name.  Rows of a shelf without
    configuration, or with a null shelf, have the default limit and no overlap.  Of several
    configurations of a shelf the one with the smallest limit counts.  Copies of a name that were
    delivered more than once give their pieces more than once.
    """
    config = local_config.where(F.col("shelf").isNotNull()).groupBy("shelf").agg(F.min(F.struct(F.coalesce("max_seq_length", F.lit(DEFAULT_LIMIT)).alias("m"), F.coalesce("chunk_overlap", F.lit(0)).alias("o"))).alias("_c"))
    rows = knowledge.select(F.col("name").alias("_name"), F.col("shelf"), F.col("content").alias("_content")).where(F.col("_content").isNotNull())
    joined = rows.join(config, "shelf", "left")
    return split_oversized(joined, "_name", "_content", F.col("_c.m"), F.col("_c.o"), json_data=True, only_split=only_split, with_text=with_text)
