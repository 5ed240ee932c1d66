"""Exact percentiles of numeric columns by bisection of value intervals.

For every group and percentile an interval of values that holds the wanted one is kept.  A pass
counts the rows of the interval below its midpoints and keeps the part in which the target rank
lies, until each interval is a single value.  A pass takes ``levels`` halvings at once: the
midpoints of the halves, quarters and so on cut the interval into 2**levels equal parts, and one
count of rows by part answers all of them.  Fractional values are bisected by their bit patterns,
whole numbers in the same order as the values, so that these too are resolved in at most 64 / levels
passes whatever their magnitudes.

What a pass counts is additive: value counts (:func:`value_counts`) of separate runs or days are
united with :func:`merge_counts` and give the same percentiles as their rows together.  Stopping
early leaves an interval, a stated bound of the error (``tolerance``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType, LongType

from graphmill.session import materialise

LEVELS = 8
#: Intervals are broadcast up to this many rows (about 64 bytes each); beyond, the join shuffles by group and salt.
BROADCAST_ROWS = 250_000
SALTS = 32


def _turn(bits: np.ndarray) -> np.ndarray:
    """Bit patterns of doubles to whole numbers of the same order, and back: all but the sign of negative ones is flipped."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(LongType())
def ordered(value: pd.Series) -> pd.Series:
    """A whole number for each double, in the order of the doubles; 0 for null."""
    return pd.Series(_turn(value.fillna(0.0).to_numpy(np.float64).view(np.int64)))


@F.pandas_udf(DoubleType())
def restored(number: pd.Series) -> pd.Series:
    """The double that :func:`ordered` gave this number."""
    return pd.Series(_turn(number.to_numpy(np.int64)).view(np.float64))


def value_counts(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """``g, v, c``: how often each value occurs in each group.

    ``v`` is a long for whole numbers and a double for fractional ones; decimals must be cast to one
    of these first, and columns of other types are an error.  Null groups, null values and NaN are
    left out; -0.0 counts as 0.0.
    """
    rows = df.select(group.alias("g"), value.alias("v"))
    kind = rows.schema["v"].dataType
    if isinstance(kind, FloatType | DoubleType):
        rows = rows.select("g", (F.col("v").cast("double") + F.lit(0.0)).alias("v")).where(~F.isnan("v"))
    elif isinstance(kind, IntegralType):
        rows = rows.select("g", F.col("v").cast("long").alias("v"))
    else:
        raise TypeError(f"{'cast the decimal' if isinstance(kind, DecimalType) else 'not a number'}: {kind.simpleString()}")
    return rows.where(F.col("g").isNotNull() & F.col("v").isNotNull()).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Unite value counts of separate runs, days or partitions."""
    return reduce(DataFrame.unionByName, counts).groupBy("g", "v").agg(F.sum("c").alias("c"))


def _wide(interval_from: str = "lo", interval_to: str = "hi") -> Column:
    """Length of an interval less one, as a decimal: the whole range of longs fits."""
    return F.col(interval_to).cast("decimal(20)") - F.col(interval_from).cast("decimal(20)")


def _split_ranks(counts: DataFrame, intervals: DataFrame, levels: int) -> DataFrame:
    """One pass: each interval narrowed to the part, of about 2**levels, that holds its rank.

    Parts begin at multiples of their width, which no difference of values can overflow.
    """
    width = F.least(F.ceil((_wide() + 1) / F.lit(1 << levels)), F.lit(1 << 62).cast("decimal(20)")).cast("long")
    open_ones = intervals.withColumn("w", F.greatest(width, F.lit(1)))
    inside = counts.join(open_ones, (counts["g"] == open_ones["_g"]) & (counts["_salt"] == open_ones["_salt"]) & F.col("v").between(F.col("lo"), F.col("hi")))
    past = F.pmod("v", "w")
    first = F.greatest("lo", F.try_subtract("v", past))
    last = F.least("hi", F.try_add("v", F.col("w") - 1 - past))
    cells = inside.groupBy("_g", "q", "rank", first.alias("lo"), last.alias("hi")).agg(F.sum("c").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_g", "q").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.col("upto") - F.col("n")
    held = cells.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= before))
    return held.select("_g", "q", "lo", "hi", (F.col("rank") - before).alias("rank"))


def bisect_percentiles(counts: DataFrame, percents: list[int], min_rows: int = 1, levels: int = LEVELS, tolerance: float = 0) -> DataFrame:
    """``g, q, n, lo, hi``: the value at position floor(n * q / 100), counted from 0, is in [lo, hi].

    With ``tolerance`` 0 ``lo`` equals ``hi`` and is the percentile; otherwise hi - lo is at most the
    tolerance.  ``percents`` are from 0 to 100; 100 gives the largest value.  Groups of fewer than
    ``min_rows`` values are left out.  Equal values are counted, not stored again; empty counts give
    an empty result.  ``lo`` and ``hi`` have the type of ``v``.  ``counts`` is read once a pass and
    should be cheap to read, as a table is.
    """
    if any(not 0 <= q <= 100 for q in percents):
        raise ValueError(percents)
    fractional = isinstance(counts.schema["v"].dataType, DoubleType)
    if fractional:
        counts = materialise(counts.select("g", ordered("v").alias("v"), "c"), "ordered")
    wide = restored("hi") - restored("lo") if fractional and tolerance else _wide()
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n") >= min_rows)
    start = sizes.select(F.col("g").alias("_g"), F.explode(F.array(*[F.lit(q) for q in percents])).alias("q"), "n", "lo", "hi")
    start = start.withColumn("rank", F.least(F.expr("n * q div 100"), F.col("n") - 1))
    intervals = materialise(start, "intervals")
    sizes = intervals.select("_g", "q", "n")
    done = intervals.where(wide <= tolerance).drop("n")
    intervals = intervals.where(wide > tolerance).drop("n")
    left = intervals.count()
    while left:
        small = left <= BROADCAST_ROWS
        salted = counts.withColumn("_salt", F.lit(0) if small else F.pmod(F.hash("v"), F.lit(SALTS)))
        spread = intervals.withColumn("_salt", F.lit(0) if small else F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        narrowed = materialise(_split_ranks(salted, F.broadcast(spread) if small else spread, levels), "intervals")
        done = done.unionByName(narrowed.where(wide <= tolerance))
        intervals = narrowed.where(wide > tolerance)
        left = intervals.count()
    lo, hi = (restored("lo"), restored("hi")) if fractional else (F.col("lo"), F.col("hi"))
    return done.join(sizes, ["_g", "q"]).select(F.col("_g").alias("g"), "q", "n", lo.alias("lo"), hi.alias("hi"))


def tidy_type(column: str) -> Column:
    """A question type trimmed, lower-cased and without a final ``_abs``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"^\s+|\s+$", ""))), r"_abs$", "")


def latency_counts(eval_result: DataFrame) -> DataFrame:
    """Value counts of both latencies of evaluation results; ``g`` is struct(run_id, question_type, side).

    One value for each run and question: copies count once.  Of differing copies of a question the
    one with the smallest type and latencies counts.  Null latencies and those of 0 or below are
    clock faults and left out, as are rows with a null run, question or type.
    """
    rows = eval_result.select("run_id", "question_id", tidy_type("question_type").alias("t"), F.col("fts_latency_us").alias("f"), F.col("vec_latency_us").alias("x"))
    rows = rows.where(F.col("run_id").isNotNull() & F.col("question_id").isNotNull() & F.col("t").isNotNull())
    once = rows.groupBy("run_id", "question_id").agg(F.min(F.struct("t", "f", "x")).alias("r"))
    sides = F.inline(F.array(F.struct(F.lit("fts").alias("side"), F.col("r.f").alias("v")), F.struct(F.lit("vec").alias("side"), F.col("r.x").alias("v"))))
    long = once.select("run_id", F.col("r.t").alias("t"), sides).where(F.col("v") > 0)
    return value_counts(long, F.struct("run_id", F.col("t").alias("question_type"), "side"), F.col("v"))
