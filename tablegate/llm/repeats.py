"""Repeated windows of texts: anchors, occurrences and first places, shared by two operators.

A window is ``size`` consecutive units (bytes or words) of one document.  Its anchor is its
``gram`` of units with the smallest hash, the leftmost of equals; so windows of equal content
have equal anchors at equal places.  Consecutive windows with one anchor form a run, a short
string of at most ``2 * size - gram`` units.  Every window is in exactly one run.

1. Anchors are counted (pre-aggregated on the map side); runs of anchors seen once hold no
   repeat and go no further.
2. Equal runs are found by their hash: each but the first occurrence is covered whole.
3. Where one anchor has runs of different content, the windows of their first occurrences
   are compared: that is left to the operator.

All joins have one row per key on the other side, so hot anchors multiply nothing and
adaptive execution can split them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import discard, same_document, slices, stored

#: Units handled at once: few enough for a core's cache.
CHUNK = 1 << 16
#: A run's place: its start times this, plus its number of windows.
PLACES = 256
RUN = "shiftright(place, 8) AS start, CAST(place & 255 AS int) AS n"
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 17) - 1)


class Kind(NamedTuple):
    words: bool
    size: int
    gram: int


def word_list(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def units_of(text: str, kind: Kind) -> np.ndarray:
    """A text's bytes, or the hashes of its words."""
    if not kind.words:
        return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = word_list(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _grams(values: np.ndarray, gram: int) -> np.ndarray:
    """Polynomial hashes of ``gram`` consecutive values, built up by doubling."""
    def joined(a, la, b, lb):
        n = len(values) - la - lb + 1
        return a[:n] * np.uint64(pow(_BASE, lb, 1 << 64)) + b[la:la + n]

    power, length, out, done = values, 1, None, 0
    while True:
        if gram & length:
            out, done = (power, length) if out is None else (joined(out, done, power, length), done + length)
        if done == gram:
            break
        power, length = joined(power, length, power, length), 2 * length
    out = out * _MIX
    return (out ^ (out >> np.uint64(32))) * _MIX


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:len(values) - span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:]) if width > span else values


def runs(units: np.ndarray, ends: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and anchor hash of each run in units of documents put end to end."""
    starts, numbers, anchors = [], [], []
    size = kind.size
    limit = np.repeat(ends, np.diff(ends, prepend=0))  # where a unit's document ends
    for low in range(0, len(units) - size + 1, CHUNK):
        part = units[low:low + CHUNK + size - 1]
        values = part if kind.words else _TABLE[part]
        hashes = _grams(values, kind.gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = _least((hashes & ~_PLACE) | place, size - kind.gram + 1)
        at = (least & _PLACE).astype(np.int64)
        first = np.arange(low, low + len(at))
        inside = first + size <= limit[low:low + len(at)]
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        begin = np.nonzero(new)[0]
        total = np.append(0, np.cumsum(inside))
        stop = np.append(begin[1:], len(at))
        starts.append(begin + low)
        numbers.append(total[stop] - total[begin])
        anchors.append(hashes[at[begin]])
    none = [np.zeros(0, np.int64)]
    return (np.concatenate(starts or none), np.concatenate(numbers or none),
            np.concatenate(anchors or [np.zeros(0, np.uint64)]))


def _occurrences(frames: Iterator[pd.DataFrame], kind: Kind, placed: bool = True) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    for frame in slices(frames, size=1 << 21):
        units = [units_of(t, kind) for t in frame["text"]]
        ends = np.cumsum([len(u) for u in units])
        flat = np.concatenate(units)
        start, n, anchor = runs(flat, ends, kind)
        if not placed:
            yield pd.DataFrame({"anchor": anchor.view(np.int64)})
            continue
        row = ends.searchsorted(start, "right")
        data, width = flat.tobytes(), flat.itemsize
        stop = (start + n + kind.size - 1) * width
        content = [digest(data[a:b]) for a, b in zip((start * width).tolist(), stop.tolist())]
        base = ends - [len(u) for u in units]
        yield pd.DataFrame({
            "doc_id": frame["doc_id"].astype("Int64").to_numpy()[row] if frame["doc_id"].isna().any()
            else frame["doc_id"].to_numpy(np.int64)[row],
            "tag": frame["tag"].to_numpy()[row], "anchor": anchor.view(np.int64),
            "content": np.array(content, dtype=np.uint64).view(np.int64),
            "place": (start - base[row]) * PLACES + n})


def occurrences(docs: DataFrame, kind: Kind, placed: bool = True) -> DataFrame:
    """All runs of keyed documents, or (not ``placed``) their anchors alone."""
    return docs.mapInPandas(
        partial(_occurrences, kind=kind, placed=placed),
        "doc_id long, tag long, anchor long, content long, place long" if placed else "anchor long")


def repeated_runs(docs: DataFrame, kind: Kind) -> DataFrame:
    """The runs whose anchor occurs twice or more, stored.

    Texts are hashed twice, which costs less than keeping the runs of all texts on disk.
    """
    # Stored on its own: a join of two plain shuffles can be split where an anchor is hot.
    twice = stored(occurrences(docs, kind, placed=False).groupBy("anchor").agg(F.count("*").alias("times"))
                   .where("times > 1").select("anchor"))
    rows = stored(occurrences(docs, kind).join(twice, "anchor", "left_semi"), compression="zstd")
    discard(twice)
    return rows


def first_places(rows: DataFrame) -> DataFrame:
    """``anchor, content, first`` (id, tag, place), ``times`` of each distinct run, stored."""
    return stored(rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "tag", "place")).alias("first"),
                                                        F.count("*").alias("times")), compression="zstd")


def covered(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``doc_id, tag, place``: runs that occur earlier as a whole, stored."""
    place = F.struct("doc_id", "tag", "place")
    repeated = firsts.where("times > 1").select("anchor", "content", "first")
    return stored(rows.join(repeated, ["anchor", "content"]).where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "tag", "place"), compression="zstd")


def variants(firsts: DataFrame) -> DataFrame:
    """``anchor, doc_id, tag, place, kinds``: first places of runs whose anchor has other contents too."""
    many = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    return firsts.join(many, "anchor").select("anchor", "first.*", "kinds")


def fetched(docs: DataFrame, wanted: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``body`` over documents with their wanted runs (``runs``: anchor, start, n), texts joined once.

    Repeated rows give their runs once each.
    """
    lists = wanted.groupBy("doc_id", "tag").agg(F.expr(f"collect_list(struct(anchor, {RUN}))").alias("runs"))
    return (docs.join(lists, same_document(docs, lists)).select(lists["doc_id"], lists["tag"], "text", "runs")
            .mapInPandas(body, schema))


def _windows(frames: Iterator[pd.DataFrame], kind: Kind) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    for frame in slices(frames, size=1 << 21):
        out = []
        for doc, tag, text, wanted in zip(frame["doc_id"], frame["tag"], frame["text"], frame["runs"]):
            units = units_of(text, kind)
            data, width = units.tobytes(), units.itemsize
            for run in wanted:
                for at in range(run["start"], run["start"] + run["n"]):
                    window = digest(data[at * width:(at + kind.size) * width])
                    out.append((doc, tag, run["anchor"], window - (1 << 63), at * PLACES + 1))
        out = pd.DataFrame(out, columns=["doc_id", "tag", "anchor", "window", "place"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def later_windows(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """``doc_id, tag, place``: windows of the wanted runs that start earlier in another of them."""
    rows = stored(fetched(docs, wanted, partial(_windows, kind=kind),
                          "doc_id long, tag long, anchor long, window long, place long"))
    place = F.struct("doc_id", "tag", "place")
    firsts = stored(rows.groupBy("anchor", "window").agg(F.min(place).alias("first"), F.count("*").alias("times"))
                    .where("times > 1"))
    later = stored(rows.join(firsts, ["anchor", "window"]).where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "tag", "place"))
    discard(rows, firsts)
    return later


def lists_of(removed: DataFrame) -> DataFrame:
    """A document's removed windows in one row (``spans``: places, 8 bytes each), stored."""
    return stored(removed.groupBy("doc_id", "tag").agg(F.collect_list("place").alias("spans")))


def joined_lists(*lists: DataFrame) -> DataFrame:
    """The lists of each document put together, stored."""
    rows = reduce(DataFrame.unionByName, lists)
    return stored(rows.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def with_spans(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Keyed documents with ``spans``, null where nothing goes."""
    return docs.join(lists, same_document(docs, lists), "left").select(docs["doc_id"], docs["tag"], "text", "spans")


def mask(spans, units: int, size: int) -> np.ndarray:
    """Which units lie in a removed window."""
    edge = np.zeros(units + 1, dtype=np.int64)
    if spans is not None and len(spans):
        start, n = np.divmod(np.asarray(spans, dtype=np.int64), PLACES)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n + size - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def merged(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
