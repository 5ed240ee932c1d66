"""Words, tokens and JSON data as the operators of this package define them."""

from __future__ import annotations

import json
import re

import numpy as np
import xxhash

#: A run of letters and digits without underscore; a CJK ideograph stands alone.
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
#: A word, or any other single character that is not white space.
TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+|\S")


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text; none for null."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def data_of(content: str | None) -> str | None:
    """Field ``data`` of JSON content; None for null, invalid or cut-off JSON and for data that is no string."""
    if not content:
        return None
    try:
        parsed = json.loads(content)
    except (ValueError, RecursionError):
        return None
    data = parsed.get("data") if isinstance(parsed, dict) else None
    return data if isinstance(data, str) else None


def hash32(items: list[str]) -> np.ndarray:
    """A 32-bit hash for each string."""
    return np.fromiter((xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in items), np.uint32, len(items))


def mix64(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value for each 64-bit value (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
