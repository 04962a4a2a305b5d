"""Benchmark decontamination by suffix arrays over the training texts.

1. The benchmark's items are a query set, taken in blocks of ``BLOCK`` bytes of text, kept as flat arrays.
   What was hit is stored between two blocks, so that the driver and a task hold one block at a time.
2. Every task cuts its documents into shards of bounded size and sorts, per shard, the
   suffixes (by word numbers of the block's vocabulary) that could begin a match.  Words
   outside the vocabulary, and the ends of documents, are number 0 and match nothing.
3. Every test suffix is binary-searched in every shard's array: the run of training suffixes
   that begin with its first ``window`` words (or with the whole item, if shorter).  Places
   that follow one another in document and item make up the longest verbatim matches.

Documents are judged by the stretches of words that matches cover and by the set of their items, and
affected ones are removed.  No shuffle on the way.

Words are lower-cased (A-Z) runs of digits, a-z and non-ASCII characters.  Defined cases: a null
or empty text has no words and is clean; an item without words (null, empty) matches nothing;
repeated items count each; null item ids are left out of the lists; repeated documents give
repeated results; empty tables give empty results or clean documents; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import TAG, discard, slices, stored, whole

WINDOW = 10
#: Bytes of benchmark text in a block, characters of training text in a shard.
BLOCK, SHARD = 2 << 20, 3 << 20
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
               else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class TestSet:
    """A block of items: vocabulary, the distinct test windows, and the items of each, all in flat arrays.

    ``items[first[w]:first[w + 1]]`` and ``starts`` likewise are where window ``w`` stands.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        number = self.vocabulary.setdefault
        texts = [np.array([number(w, len(self.vocabulary) + 1) for w in words_of(t)], np.int32) for _, t in items]
        self.names = [None if i is None else int(i) for i, _ in items]
        size = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(window, np.int32)])
        count = np.where(size > 0, np.maximum(size - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        bits = max(1, len(self.vocabulary).bit_length())
        self.bits, self.per_key = bits, 62 // bits
        self.n_keys = -(-window // self.per_key)
        length = np.minimum(size[item], window)
        at = (np.cumsum(size) - size)[item] + start
        keys = self._packed(flat, at, length, 0)
        order = np.lexsort([length, *keys[::-1]])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in [*keys, length]], axis=0)
        self.first = np.append(np.flatnonzero(new), len(order))
        self.items, self.starts = item[order], start[order]
        chosen = order[self.first[:-1]]
        self.size = length[chosen]
        self.low = [k[chosen] for k in keys]
        self.high = self._packed(flat, at[chosen], self.size, (1 << bits) - 1)
        self.shortest = int(self.size.min(initial=window))

    def _packed(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray, beyond: int) -> list[np.ndarray]:
        """Windows packed into as few whole numbers as they need; ``beyond`` stands after a shorter item's end."""
        out = []
        for k in range(self.n_keys):
            key = np.zeros(len(at), np.int64)
            for column in range(k * self.per_key, (k + 1) * self.per_key):
                key <<= self.bits
                if column < self.window:
                    key |= np.where(column < length, flat[np.minimum(at + column, len(flat) - 1)], beyond)
            out.append(key)
        return out


def suffix_array(numbers: np.ndarray, tests: TestSet) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the suffixes that can begin a match, sorted by their first words, and their keys."""
    padded = np.concatenate([numbers, np.zeros(tests.n_keys * tests.per_key, dtype=numbers.dtype)])
    ok = numbers > 0
    for k in range(1, tests.shortest):
        ok &= padded[k:len(numbers) + k] > 0
    starts = np.nonzero(ok)[0]
    keys = []
    for k in range(tests.n_keys):
        key = np.zeros(len(starts), dtype=np.int64)
        for column in range(k * tests.per_key, (k + 1) * tests.per_key):
            key = (key << tests.bits) | (padded[starts + column] if column < tests.window else 0)
        keys.append(key)
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(starts))
    return starts[order], [k[order] for k in keys]


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For each wanted key the first place in the sorted keys that is not before (``right``: after) it."""
    low = np.zeros(len(wanted[0]), dtype=np.int64)
    high = np.full(len(wanted[0]), len(keys[0]), dtype=np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, len(keys[0]) - 1)
        before, equal = np.zeros(len(low), dtype=bool), np.ones(len(low), dtype=bool)
        for key, want in zip(keys, wanted):
            found = key[middle]
            before |= equal & (found < want)
            equal &= found == want
        go = open_ & (before | (equal & right))
        high = np.where(open_ & ~go, middle, high)
        low = np.where(go, middle + 1, low)
    return low


def search(numbers: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """All verbatim places: (window, place in the shard) pairs, by binary search of every test suffix."""
    none = np.zeros(0, dtype=np.int64)
    if not len(tests.size) or not len(numbers):
        return none, none
    places, keys = suffix_array(numbers, tests)
    if not len(places):
        return none, none
    first, last = _bound(keys, tests.low, False), _bound(keys, tests.high, True)
    n = np.maximum(last - first, 0)
    window = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    return window, places[np.repeat(first, n) + within]


def _matches(window, place, owner, tests: TestSet) -> np.ndarray:
    """Longest verbatim matches: rows (document, item, start in the shard, start in the item, words)."""
    if not len(window):
        return np.zeros((0, 5), dtype=np.int64)
    counts = np.diff(tests.first)[window]
    at = np.repeat(place, counts)
    within = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.repeat(tests.first[window], counts) + within
    where = np.column_stack([tests.items[held], tests.starts[held]])
    length = np.repeat(tests.size[window], counts)
    order = np.lexsort((at, at - where[:, 1], where[:, 0]))
    at, where, length = at[order], where[order], length[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = ((where[1:, 0] != where[:-1, 0]) | (at[1:] - where[1:, 1] != at[:-1] - where[:-1, 1])
               | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
    head = np.nonzero(new)[0]
    tail = np.append(head[1:], len(at)) - 1
    return np.column_stack([owner[at[head]], where[head, 0], at[head], where[head, 1],
                            at[tail] + length[tail] - at[head]])


class Shard:
    """A batch of documents as numbers of a block's vocabulary, each followed by 0."""

    def __init__(self, texts: pd.Series, tests: TestSet):
        known = tests.vocabulary.get
        numbers = [np.array([known(w, 0) for w in words_of(t)] + [0], np.int64) for t in texts]
        size = np.array([len(n) for n in numbers], np.int64)
        self.n_words, self.begin = size - 1, np.cumsum(size) - size
        self.numbers = np.concatenate(numbers)
        self.owner = np.repeat(np.arange(len(size)), size)


def _longest(frames: Iterator[pd.DataFrame], tests: TestSet) -> Iterator[pd.DataFrame]:
    """Adds a block's matches to the rows' matches so far."""
    for frame in slices(frames, size=SHARD):
        shard = Shard(frame["text"], tests)
        window, place = search(shard.numbers, tests)
        found = _matches(window, place, shard.owner, tests)
        by_row: list[list[dict]] = [list(x) for x in frame["matches"]]
        for row, item, start, item_start, n in found.tolist():
            by_row[row].append({"item_id": tests.names[item], "item": item, "start": start - int(shard.begin[row]),
                                "item_start": item_start, "n_words": n})
        out = frame.copy()
        out["n_words"], out["matches"] = shard.n_words, by_row
        yield out


def _hits(frames: Iterator[pd.DataFrame], tests: TestSet, last: bool) -> Iterator[pd.DataFrame]:
    """Adds a block's hits: a document's hit words as stretches, its items as a set.

    A passage of many items costs a document its words once and its items once, never each word with each
    item; documents that hold the same windows share one list of items.
    """
    sets: dict[bytes, tuple[list[int], int]] = {}

    def items_of(windows: np.ndarray) -> tuple[list[int], int]:
        key = windows.tobytes()
        if key not in sets:
            if len(sets) >= SETS:
                sets.clear()
            items = np.unique(np.concatenate([tests.items[tests.first[w]:tests.first[w + 1]] for w in windows]))
            names = [tests.names[i] for i in items]
            sets[key] = sorted({n for n in names if n is not None}), names.count(None)
        return sets[key]

    for frame in slices(frames, size=SHARD):
        shard = Shard(frame["text"], tests)
        window, place = search(shard.numbers, tests)
        marks = np.zeros(len(shard.numbers) + 1, np.int64)
        np.add.at(marks, place, 1)
        np.add.at(marks, place + tests.size[window], -1)
        for row, held in enumerate(frame["hits"]):
            for stretch in held:
                marks[shard.begin[row] + stretch["start"]] += 1
                marks[shard.begin[row] + stretch["stop"]] -= 1
        edges = np.diff((np.cumsum(marks) > 0).astype(np.int8), prepend=0)
        start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        hits: list[list[dict]] = [[] for _ in range(len(frame))]
        for row, a, b in zip(shard.owner[start].tolist(), (start - shard.begin[shard.owner[start]]).tolist(),
                             (stop - shard.begin[shard.owner[start]]).tolist()):
            hits[row].append({"start": a, "stop": b})
        pairs = np.unique(shard.owner[place] * len(tests.size) + window)
        rows, windows = pairs // max(len(tests.size), 1), pairs % max(len(tests.size), 1)
        ids, unnamed = [list(x) for x in frame["ids"]], frame["unnamed"].to_numpy().copy()
        cut = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)]):
            named, without = items_of(windows[a:b])
            ids[rows[a]] = sorted({*ids[rows[a]], *named}) if ids[rows[a]] else named
            unnamed[rows[a]] += without
        out = pd.DataFrame({"id": frame["id"], "tag": frame["tag"], "n_words": shard.n_words, "hits": hits, "ids": ids, "unnamed": unnamed})
        if not last:
            out["text"] = frame["text"]
        yield out


#: Lists of items that a task keeps for documents with the same windows.
SETS = 10_000
HITS = "id string, tag long, n_words long, hits array<struct<start: long, stop: long>>, ids array<long>, unnamed long"
MATCHES = "array<struct<item_id: long, item: int, start: long, item_start: long, n_words: long>>"


def _number_of_blocks(benchmark: DataFrame, size: int | None = None) -> int:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // (size or BLOCK)))


def blocks(benchmark: DataFrame, window: int, size: int | None = None) -> Iterator[TestSet]:
    """The items, a bounded number of bytes at a time; at least one block, maybe empty."""
    rows = benchmark.select("item_id", "text")
    number = _number_of_blocks(rows, size)
    for k in range(number):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        items = sorted(map(tuple, mine.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        yield TestSet(items, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, tag, text, n_words, matches`` of every row: its longest verbatim matches and where.

    A list of all places in all items, for the documents one looks into; judging takes ``judged``.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), whole().alias("text"),
                       F.lit(0).cast("long").alias("n_words"), F.array().cast(MATCHES).alias("matches"))
    before = None
    for k, tests in enumerate(blocks(benchmark, window)):
        if k:  # a plan holds one block only: the matches so far are stored
            rows = stored(rows)
            if before is not None:
                discard(before)
            before = rows
        rows = rows.mapInPandas(partial(_longest, tests=tests),
                                f"doc_id long, tag long, text string, n_words long, matches {MATCHES}")
    return rows


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, tag, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("tag"), whole().alias("text"),
        F.array().cast("array<struct<start: long, stop: long>>").alias("hits"), F.array().cast("array<long>").alias("ids"),
        F.lit(0).cast("long").alias("unnamed"))
    number, before = _number_of_blocks(benchmark), None
    for k, tests in enumerate(blocks(benchmark, window)):
        if k:  # a plan holds one block only: what was hit so far is stored
            rows = stored(rows)
            if before is not None:
                discard(before)
            before = rows
        last = k == number - 1
        rows = rows.mapInPandas(partial(_hits, tests=tests, last=last), HITS if last else f"{HITS}, text string")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["stop"] - h["start"])
    names = F.array_join(F.sort_array(F.transform("ids", lambda i: i.cast("string"))), ",")
    return rows.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "tag", "n_words", n_hit.alias("n_hit"),
        (F.size("ids") + F.col("unnamed")).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match, all their columns."""
    dirty = judged(docs, benchmark, window).where("contaminated").select(
        F.col("doc_id").alias("__tablegate_id"), F.col("tag").alias("__tablegate_of")).distinct()
    tagged = docs.withColumn(TAG, F.xxhash64("text"))
    return tagged.join(dirty, tagged["doc_id"].eqNullSafe(dirty["__tablegate_id"])
                       & (tagged[TAG] == dirty["__tablegate_of"]), "left_anti").drop(TAG)
