"""Porter's suffix stripping (M. F. Porter, 1980) and accent folding, for vocabularies.

Rules are tables of (suffix, replacement); a rule applies where the rest of the word has the
measure its step asks for.  Stemming is meant for distinct words, not for running text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: The suffix tables of the algorithm's steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_LONGEST = 63


def _shape(word: str) -> str:
    """The word as v (vowels) and c (consonants); y is a vowel after a consonant."""
    shape = []
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or letter == "y" and i > 0 and shape[-1] == "c"
        shape.append("v" if vowel else "c")
    return "".join(shape)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for size in range(min(7, len(word)), 1, -1):
        suffix = word[-size:]
        if suffix in table:
            stem = word[:-size]
            return stem + table[suffix] if _measure(stem) >= least else word
    return word


@lru_cache(100_000)
def porter(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters and very long ones stay."""
    if len(word) < 3 or len(word.encode()) > _LONGEST:
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past forms and -ing
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word.removesuffix(suffix)
                if _has_vowel(stem):
                    if stem.endswith(("at", "bl", "iz")) or _measure(stem) == 1 and _short_end(stem) and not _double(stem):
                        stem += "e"
                    elif _double(stem) and stem[-1] not in "lsz":
                        stem = stem[:-1]
                    word = stem
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP_2, 1)
    word = _replace(word, STEP_3, 1)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word.removesuffix(suffix)
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    # a final e, and double l
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold(word: str) -> str:
    """Lower case without diacritics."""
    plain = unicodedata.normalize("NFD", word.lower())
    return unicodedata.normalize("NFC", "".join(c for c in plain if unicodedata.category(c) != "Mn"))


def _each_once(words: pd.Series, change: Callable[[str], str]) -> pd.Series:
    """Apply a function to the different words of a batch."""
    number, different = pd.factorize(words)
    changed = np.array([change(w) for w in different] + [None], object)
    return pd.Series(changed[number])


@pandas_udf(StringType())
def fold_column(words: pd.Series) -> pd.Series:
    return _each_once(words, fold)


@pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return _each_once(words, lambda w: porter(fold(w)))
