"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are identical),
at least ``max(6, 4 q)`` words long, that no neighbouring word extends.

1. Splitting.  Every word of a run stands in it four times or more.  A word that occurs less
   often within its segment (at first the whole text) can be in no run and splits the segment;
   words are counted again in the pieces that changed, until nothing changes.  Pieces shorter
   than the shortest run go.
2. Lag scan.  A run of period q holds four words that are q apart, at multiples of q, and equal.
   For each lag only such places are compared (the harmonic sum, not all pairs of words).
3. Each find is proved and extended both ways to its whole run by names of blocks of 2, 4,
   8... words: equal blocks have equal names, so a comparison of any length is exact.  A run found
   under several lags is kept with its smallest.

Words become numbers once for a batch of texts, and all steps are numpy over the batch; texts
are cut into batches by their size, and a row's work stays in its task (no shuffle).

Defined cases: a null or empty text has no words and no runs; repeated rows give repeated
results; equal runs at several places are several runs; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored, whatever their names; a ``doc_id`` may be null.
``ROUNDS`` only ends the splitting of texts made to peel off word by word: what is split less is
scanned more, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import slices, whole

TIMES, SHORTEST = 4, 6
ROUNDS = 64
WORD = re.compile("[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:long,length:long,period:long>>"


def _pieces(at: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Numbers of the stretches of consecutive places within one segment."""
    return np.cumsum((np.diff(at, prepend=at[:1]) != 1) | (np.diff(segment, prepend=segment[:1]) != 0))


def split(words: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in surviving segments, and the segment of each."""
    at, segment = np.arange(len(words)), document
    done = []
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, which, count = np.unique(segment * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        keep = count[which] >= TIMES
        changed = np.zeros(int(segment.max()) + 1, bool)
        changed[segment[~keep]] = True
        same = ~changed[segment]
        done.append((at[same], segment[same]))
        at, segment = at[keep & ~same], segment[keep & ~same]
        piece = _pieces(at, segment)
        long = np.bincount(piece, minlength=1)[piece] >= SHORTEST if len(at) else np.zeros(0, bool)
        at, segment = at[long], piece[long]
    done.append((at, segment))
    places = np.concatenate([a for a, _ in done])
    order = np.argsort(places, kind="stable")
    # Segments of different rounds are told apart by the round; neighbours by their places.
    turns = np.concatenate([np.full(len(a), k) for k, (a, _) in enumerate(done)])[order]
    segments = np.concatenate([s for _, s in done])[order]
    places = places[order]
    new = (np.diff(places, prepend=-2) != 1) | (np.diff(turns, prepend=-1) != 0) | (np.diff(segments, prepend=-1) != 0)
    return places, np.cumsum(new) - 1


class Names:
    """Names of all blocks of 1, 2, 4... symbols: equal blocks, and only these, share a name."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.levels, self.size = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)], len(symbols)
        while (2 << len(self.levels) - 1) <= min(longest, self.size):
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            pairs = last[:-half].astype(np.int64) * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the blocks of these lengths (one or more) at ``a`` and ``b`` are the same."""
        level, out = np.log2(length).astype(int), np.zeros(len(a), bool)
        level -= (1 << level) > length
        for k in np.unique(level):
            rows, names = level == k, self.levels[k]
            x, y, rest = a[rows], b[rows], length[rows] - (1 << k)
            out[rows] = (names[x] == names[y]) & (names[x + rest] == names[y + rest])
        return out

    def shared(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many symbols from (before, for ``way`` -1) ``a`` and ``b`` > ``a`` are equal, fewer than ``b - a`` of them."""
        n = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            names, step = self.levels[k], 1 << k
            x, y = (a + n, b + n) if way > 0 else (a - n - step, b - n - step)
            fits = (x >= 0) & (y < len(names))
            n += step * (fits & (names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)]))
        return n


def scan(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs; ``longest`` is the length of the longest segment."""
    lags, places = [], []
    for lag in range(1, longest // TIMES + 1):
        sample = symbols[::lag]
        same = sample[1:] == sample[:-1]
        found = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(found):
            lags.append(np.full(len(found), lag))
            places.append(found)
    if not lags:
        return (np.zeros(0, np.int64),) * 3
    lag, place = np.concatenate(lags), np.concatenate(places)
    names = Names(symbols, 2 * int(lag.max()) + 1)
    proved = names.equal(place * lag, place * lag + lag, 2 * lag + 1)
    lag, place = lag[proved], place[proved]
    first = (np.diff(lag, prepend=0) != 0) | (np.diff(place, prepend=-2) != 1)
    last = np.append(first[1:], True)[:len(lag)]
    lag, low, high = lag[first], place[first] * lag[first], (place[last] + 2) * lag[last] + 1
    low = low - names.shared(low, low + lag, -1)
    high = high + names.shared(high, high + lag, 1)
    length = high - low + lag
    enough = length >= np.maximum(SHORTEST, TIMES * lag)
    low, length, lag = low[enough], length[enough], lag[enough]
    order = np.lexsort((lag, length, low))
    low, length, lag = low[order], length[order], lag[order]
    once = (np.diff(low, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    return low[once], length[once], lag[once]


def runs(words: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``words``), length and period of the runs of several documents, by start, then period."""
    at, segment = split(words, document)
    none = (np.zeros(0, np.int64),) * 3
    if not len(at):
        return none
    size = np.bincount(segment)
    # A separator of its own before each segment: nothing is equal across it.
    symbols = np.empty(len(at) + len(size), np.int64)
    place = np.arange(len(at)) + segment + 1
    symbols[place] = words[at]
    heads = np.cumsum(size + 1) - (size + 1)
    symbols[heads] = -1 - np.arange(len(size))
    origin = np.empty(len(symbols), np.int64)
    origin[place] = at
    start, length, period = scan(symbols, int(size.max()))
    start = origin[start]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames, size=1 << 20):
        texts = [WORD.findall(t) for t in frame["text"]]
        size = np.array([len(t) for t in texts], np.int64)
        flat = [w for t in texts for w in t]
        words = pd.factorize(np.array(flat, object))[0] if flat else np.zeros(0, np.int64)
        document = np.repeat(np.arange(len(size)), size)
        start, length, period = runs(words, document)
        base = np.cumsum(size) - size
        cut = np.searchsorted(start, np.append(base, len(words)))
        dropped = np.zeros(len(words) + 1, np.int64)
        np.add.at(dropped, start + period, 1)
        np.add.at(dropped, start + length, -1)
        kept = np.cumsum(dropped)[:-1] == 0
        out, collapsed = [], []
        for k, text in enumerate(texts):
            a, b = cut[k], cut[k + 1]
            out.append([{"start": int(s - base[k]), "length": int(n), "period": int(p)}
                        for s, n, p in zip(start[a:b], length[a:b], period[a:b])])
            stays = kept[base[k]:base[k] + size[k]]
            collapsed.append(" ".join(text if a == b else [w for w, stay in zip(text, stays) if stay]))
        yield pd.DataFrame({"id": frame["id"], "n_words": size, "runs": out, "collapsed": collapsed})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs (by start, then period), collapsed`` of every row.

    ``collapsed`` is the text's words joined by one space, without those that any run holds after
    its first ``period`` words.
    """
    # An id travels as text: a null among whole numbers would make them floats.
    found = docs.select(F.col("doc_id").cast("string").alias("id"), whole().alias("text")).mapInPandas(
        _found, f"id string, n_words long, runs {RUNS}, collapsed string")
    return found.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equals the first, null if there is none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(
        x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def listed(runs: Column) -> Column:
    """Every run's ``start,length,period`` on a line of its own."""
    return F.array_join(F.transform(runs, lambda x: F.concat(
        F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
