"""Vector distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine of a vector column with a fixed vector, in double; NaN where either has no length.

    Arrow batches and one matrix product each: several times faster than the same as array
    expressions, which Spark interprets element by element.
    """
    q = np.asarray(query, np.float64)
    norm = math.sqrt(float(q @ q))

    @pandas_udf(DoubleType())
    def distance(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        known = vectors.notna().to_numpy()
        fits = np.array([len(v) == len(q) for v in vectors[known]], bool)
        at = np.flatnonzero(known)[fits]
        if len(at):
            x = np.array([np.asarray(v, np.float64) for v in vectors.iloc[at]])
            with np.errstate(divide="ignore", invalid="ignore"):
                out[at] = 1 - (x @ q) / (np.sqrt((x * x).sum(1)) * norm)
        return pd.Series(out)

    # Arrow turns NaN from pandas into null.
    return F.when(vector.isNotNull(), F.coalesce(distance(vector), F.lit(math.nan)))


def vector_literal(values: Sequence[float]) -> list[float]:
    """A vector as it is stored: eight decimals, no infinities."""
    return [round(float(v), 8) if math.isfinite(v) else 0.0 for v in values]


def normalised(values: Sequence[float]) -> list[float]:
    """Unit length; a zero vector stays."""
    norm = math.sqrt(sum(v * v for v in values))
    return [v / norm for v in values] if norm else list(values)


def dimensions(vector: Column) -> Column:
    return F.size(vector)
