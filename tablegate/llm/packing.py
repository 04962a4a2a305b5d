"""Best-fit packing of tokenised documents into sequences.

1. Documents are encoded whole and closed with an end id; only those over the capacity are
   cut, into full pieces after a shorter first one.  Pieces (no texts) are range-sorted by
   length and stored; a piece's rank among those of its length follows from its place.
2. Bulk-synchronous best fit: lengths are whole numbers up to the capacity, so documents and
   gaps fall into at most ``capacity`` classes each, and sweeping the classes is sweeping all
   rows.  In each step the longest class left meets its successor among the gaps, the
   smallest that can take it.  Rank resolves conflicts: the r-th piece goes to the r-th gap of
   the class, as many to a gap as fit.  The gaps shrink, and the next step follows, until no
   piece is left; where no gap can take a piece, new sequences open.  A step is a run of
   ranks, never a row; what the driver holds is the histogram (at most ``capacity`` rows) and
   the list of steps.
3. Every task gives its pieces their places by binary search of (length, rank) in the steps.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each;
an empty table gives an empty result; extra columns are ignored; ties go by id and piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegate.llm.bpe import encoder
from tablegate.llm.common import slices, stored, whole

CAPACITY, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(frames: Iterator[pd.DataFrame], path: str, capacity: int, end: int) -> Iterator[pd.DataFrame]:
    closing, width = np.array([end], dtype="<u4").tobytes(), 4 * capacity
    for frame in slices(frames, size=5 << 20):  # larger batches hold fewer different units for their size
        rows = []
        for doc, ids in zip(frame["doc_id"], encoder(path, joined=True).ids(frame["text"].tolist())):
            ids += closing
            stop = len(ids) if len(ids) <= width else len(ids) % width or width
            start = piece = 0
            while start < len(ids):
                rows.append((doc, piece, start // 4, (stop - start) // 4, zlib.crc32(ids[start:stop])))
                start, stop, piece = stop, stop + width, piece + 1
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def steps(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces to a gap, offset in the sequence)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    sizes: list[int] = []
    opened, out = 0, []

    def give(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            runs = gaps[gap]
            if runs and sum(runs[-1]) == first:
                runs[-1] = (runs[-1][0], runs[-1][1] + number)
            else:
                runs.append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, fit = capacity, capacity // length
                first, number = opened, -(-left // fit)
                opened += number
            each = min(gap // length, left)
            used = min(number, left // each)
            out.append((length, rank, first, each, capacity - gap))
            give(gap, first + used, number - used)
            give(gap - each * length, first, used)
            left -= used * each
            rank += used * each
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def _places(frames: Iterator[pd.DataFrame], plan: np.ndarray) -> Iterator[pd.DataFrame]:
    keys = (plan[:, 0] << 40) + plan[:, 1]
    for frame in frames:
        length, rank = frame["length"].to_numpy(np.int64), frame.pop("rank").to_numpy(np.int64)
        step = plan[keys.searchsorted((length << 40) + rank, "right") - 1] if len(frame) else plan[:0]
        number = rank - step[:, 1]
        frame["sequence_id"] = step[:, 2] + number // np.maximum(step[:, 3], 1)
        frame["offset"] = step[:, 4] + number % np.maximum(step[:, 3], 1) * length
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The pieces with their rank among those of their length, and the histogram of lengths."""
    pieces = stored(pieces)  # range bounds are sampled: texts are encoded once all the same
    spread = (pieces.repartitionByRange("length", "doc_id", "piece", "ids_crc32")
              .sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
              .withColumn("row", F.monotonically_increasing_id()))
    rows = stored(spread).withColumn("part", F.shiftright("row", 33))
    # Range-sorted: as many rows as there are partitions and lengths together, at most.
    blocks = stored(rows.groupBy("part", "length").agg(F.min("row").alias("first"), F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("part", "length", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    histogram = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    return (rows.join(F.broadcast(offsets), ["part", "length"])
            .withColumn("rank", F.col("row") + F.col("shift")).drop("row", "part", "shift")), histogram


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row for each piece."""
    pieces = docs.select("doc_id", whole().alias("text")).mapInPandas(
        partial(_pieces, path=path, capacity=capacity, end=end), PIECES)
    rows, histogram = ranked(pieces)
    out = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInPandas(partial(_places, plan=steps(histogram, capacity)),
                           PIECES + ", sequence_id long, offset long")
