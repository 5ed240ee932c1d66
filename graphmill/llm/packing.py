"""Packing texts into fixed-capacity sequences: bounded-space best fit, then a merge of leftovers.

Every partition keeps ``windows`` open sequences for each bin group.  An item goes to the open
window that it fills best; if it fits in none and all windows are in use, the fullest is closed,
and what is closed stays so.  What is still open at the end of a partition is left over; leftovers
of ``fan`` partitions at a time are packed again as whole units, level by level, until the
partitions of a group have been merged.
"""

from __future__ import annotations

import base64
import functools
import os
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.session import materialise

DEFAULT_CAPACITY = 8192
WINDOWS = 64
#: Partitions whose leftovers meet in one task; at most fan * windows units of each group.
FAN = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how a text is cut into pieces before byte pairs are merged, as published with this vocabulary.
PIECE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = TOKENIZER, spark: SparkSession | None = None) -> Callable[[str], int]:
    """Counts the tokens of a text by a vocabulary file of ranks; special tokens are ordinary text.

    With ``spark`` the file is sent to the executors, which then need none of their own.
    """
    if spark is None:
        return lambda text: len(_encoding(path).encode_ordinary(text))
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda text: len(_encoding(SparkFiles.get(name)).encode_ordinary(text))


class OpenWindows:
    """The open sequences of one bin group: best fit among a fixed number."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.free: list[tuple[int, int]] = []  # (room, number), ascending
        self.made = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        """(window, offset, window closed for it or None) of an item no larger than the capacity."""
        at = bisect_left(self.free, (size, -1))
        closed = None
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if len(self.free) >= self.windows:
                closed = self.free.pop(0)[1]  # least room: the fullest
            room, number = self.capacity, self.made
            self.made += 1
        if room > size:  # a full sequence is closed
            insort(self.free, (room - size, number))
        return number, self.capacity - room, closed


PLACED = "id string, piece int, pieces int, first_token long, n_tokens long, bin string, capacity long, partition int, window long, offset long"


def _pack_partition(count: Callable[[str], int] | None, windows: int):
    columns = [c.split()[0] for c in PLACED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition = TaskContext.get().partitionId()
        open_: dict[tuple[str, int], OpenWindows] = {}
        offsets: dict[tuple[str, int], int] = {}
        for frame in frames:
            out = []
            for key, text, group, capacity in frame.itertuples(index=False, name=None):
                capacity = max(1, int(capacity))
                size = count(text) if count else int(text)
                pieces = max(1, -(-size // capacity))
                bins = open_.setdefault((group, capacity), OpenWindows(capacity, windows))
                base = offsets.setdefault((group, capacity), len(offsets) << 40)
                for piece in range(pieces):
                    n = min(capacity, size - piece * capacity)
                    window, offset, _ = bins.place(n)
                    out.append((key, piece, pieces, piece * capacity, n, group, capacity, partition, base + window, offset))
            yield pd.DataFrame(out, columns=columns)
        # What is open now, one row each with its tokens and piece -1.
        still = [(None, -1, 0, 0, capacity - room, group, capacity, partition, offsets[group, capacity] + window, 0) for (group, capacity), bins in open_.items() for room, window in bins.free]
        yield pd.DataFrame(still, columns=columns)

    return run


MOVES = "home string, into string, shift long, bin string, capacity long, part int, left long"


def _merge_group(windows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit, largest first, of whole leftover windows: each gets its new window and how far it moves.

        ``left`` is the tokens of a window that goes on to the next level: of the emptiest ``windows``.
        """
        pdf = pdf.sort_values(["used", "home"], ascending=[False, True], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        bins, homes, out = OpenWindows(capacity, 1 << 62), {}, []
        for used, home in zip(pdf["used"], pdf["home"]):
            number, offset, _ = bins.place(int(used))
            out.append([home, homes.setdefault(number, home), offset, None])
        open_ = {homes[number]: capacity - room for room, number in bins.free[-windows:]}
        for row in out:
            row[3] = open_.get(row[0])
        moves = pd.DataFrame(out, columns=["home", "into", "shift", "left"]).astype({"left": "Int64"})
        return moves.assign(bin=pdf["bin"].iloc[0], capacity=capacity, part=pdf["part"].iloc[0])

    return run


def pack(df: DataFrame, id: str, size: Column, group: Column, capacity: Column, counter: Callable[[str], int] | None = None, windows: int = WINDOWS, fan: int = FAN) -> DataFrame:
    """Place every item: ``id, piece, pieces, first_token, n_tokens, bin, capacity, sequence, offset``.

    ``size`` is the text whose tokens ``counter`` counts, or without a counter the size itself.
    Items of the same ``group`` and ``capacity`` share sequences; ``sequence`` names one and
    ``offset`` is the item's first token in it.  An item larger than the capacity is divided into
    full pieces and a rest, all others stay whole.  Null text or size counts as empty and takes no
    room; a null group is one group; a null capacity is ``DEFAULT_CAPACITY``, one below 1 counts as 1.
    Repeated rows are separate items.  An empty table gives no row.
    """
    kind = "string" if counter else "long"
    rows = df.select(F.col(id).cast("string").alias("_id"), F.coalesce(size.cast(kind), F.lit("" if counter else 0).cast(kind)).alias("_size"), F.coalesce(group.cast("string"), F.lit("")).alias("_bin"), F.coalesce(capacity.cast("long"), F.lit(DEFAULT_CAPACITY)).alias("_capacity"))
    # Written once: what is left over and what is not must come from the same run of the packing.
    written = materialise(rows.mapInPandas(_pack_partition(counter, windows), PLACED), "placed")
    home = F.concat_ws("/", F.col("partition").cast("string"), F.col("window").cast("string"))
    placed, open_ = written.where(F.col("piece") >= 0), written.where(F.col("piece") < 0)
    left = open_.select("bin", "capacity", F.col("partition").alias("part"), home.alias("home"), F.col("n_tokens").alias("used"))
    moves = None
    parts = (placed.agg(F.max("partition")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan)
        left = left.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        step = materialise(left.groupBy("bin", "capacity", "part").applyInPandas(_merge_group(windows), MOVES), "moves")
        if moves is None:
            moves = step.select("home", "into", "shift")
        else:
            later = step.select(F.col("home").alias("into"), F.col("into").alias("_next"), F.col("shift").alias("_more"))
            moves = moves.join(later, "into", "left").select("home", F.coalesce("_next", "into").alias("into"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift"))
        if parts == 1:
            break
        left = step.where(F.col("left").isNotNull()).select("bin", "capacity", "part", "home", F.col("left").alias("used"))
    moves = moves.where((F.col("into") != F.col("home")) | (F.col("shift") != 0))
    final = placed.withColumn("home", home).join(moves, "home", "left")
    into = F.coalesce("into", "home")
    name = F.concat_ws("/", "bin", F.col("capacity").cast("string"), into)
    return final.select("id", "piece", "pieces", "first_token", "n_tokens", "bin", "capacity", name.alias("sequence"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(documents: DataFrame, local_config: DataFrame, tokenizer: str = TOKENIZER, **settings: int) -> DataFrame:
    """Documents into sequences of their shelf's ``max_seq_length``: columns of :func:`pack`.

    The shelf is the second part of ``source`` (``shelf/<name>/...``).  Documents without a source
    or of a shelf without configuration share sequences of the default capacity.
    """
    config = local_config.where(F.col("shelf").isNotNull()).groupBy("shelf").agg(F.min(F.coalesce("max_seq_length", F.lit(DEFAULT_CAPACITY))).alias("_capacity"))
    rows = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.regexp_extract("source", r"^shelf/([^/]+)/", 1).alias("shelf"))
    joined = rows.join(config, "shelf", "left")
    known = F.when(F.col("_capacity").isNotNull(), F.col("shelf"))
    packed = pack(joined, "_doc", F.col("_text"), known, F.col("_capacity"), token_counter(tokenizer, documents.sparkSession), **settings)
    return packed.select(F.col("id").cast("long").alias("doc_id"), "piece", "pieces", "first_token", "n_tokens", F.col("bin").alias("shelf"), "capacity", "sequence", "offset")
