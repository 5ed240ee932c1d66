"""How runs of CJK ideographs are cut into words, for the index and for queries alike."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_IDEOGRAPH = r"[\x{4E00}-\x{9FFF}]"
_RUN = re.compile("[一-鿿]+")


class Segmenter(Protocol):
    """Cuts a text by spaces; the column form and the string form must agree."""

    def column(self, text: Column) -> Column: ...

    def text(self, text: str) -> str: ...


class Pairs:
    """Overlapping pairs of ideographs between spaces, a lone one staying one: a word is found inside a longer one."""

    def column(self, text: Column) -> Column:
        paired = F.regexp_replace(text, f"({_IDEOGRAPH})(?=({_IDEOGRAPH}))", "$1$2\u0001")
        paired = F.regexp_replace(paired, f"\u0001{_IDEOGRAPH}(?!{_IDEOGRAPH})", " ")
        spaced = F.regexp_replace(F.replace(paired, F.lit("\u0001"), F.lit(" ")), f"({_IDEOGRAPH}+)", " $1 ")
        return F.when(text.rlike(_IDEOGRAPH), spaced).otherwise(text)

    def text(self, text: str) -> str:
        return _RUN.sub(lambda m: " " + (m[0] if len(m[0]) == 1 else " ".join(m[0][i : i + 2] for i in range(len(m[0]) - 1))) + " ", text)


class Dictionary:
    """The longest word of a word list at each place, from left to right; ideographs in no word stand alone."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(w for w in words if _RUN.fullmatch(w))
        self.longest = max(map(len, self.words), default=1)

    def _cut(self, run: str) -> str:
        out, at = [], 0
        while at < len(run):
            size = next((n for n in range(min(self.longest, len(run) - at), 1, -1) if run[at : at + n] in self.words), 1)
            out.append(run[at : at + size])
            at += size
        return " " + " ".join(out) + " "

    def text(self, text: str) -> str:
        return _RUN.sub(lambda m: self._cut(m[0]), text)

    def column(self, text: Column) -> Column:
        cut = self.text

        @F.pandas_udf(StringType())
        def segmented(texts: pd.Series) -> pd.Series:
            return texts.map(cut, na_action="ignore")

        return F.when(text.rlike(_IDEOGRAPH), segmented(text)).otherwise(text)


PAIRS = Pairs()
