"""Ranked lexical search over bit-sliced Bloom signatures, with exact rescoring.

1. Index.  Every document's terms, and again each term that occurs 2, 3, 4, 6, 8, 12... times (a
   level each), set ``HASHES`` bits of the document's signature.  Documents of like signature width lie
   together in blocks, bit-sliced: a row for each bit, a column for each document.  The same pass
   counts the documents of every term.  The index knows no queries and can be kept.
2. Bounds.  The bit rows of a query term and-ed together are a bitmap of the documents that may hold it
   that often; none is missed, some are added.  A document's score is at most the sum over the levels'
   bitmaps of the weight's growth up to the next level, as its length is known exactly.
3. Threshold.  The documents with the highest bounds are scored exactly; the last of an item's best ``k``
   is a score that a result has to reach, and at equal score also an id it has to come before.
4. Rescoring.  Every document whose bound is not below is scored exactly from its text, however many
   these are; the others provably are no result.  So the result is exact and the bitmaps only save work.

Items are a query set held against all documents in blocks of ``ENTRIES`` terms; a block is all that a
plan carries.  Candidates travel as keys; texts are read where they lie, unless there are
too many keys for Spark to broadcast them.

Defined cases: a null text has no terms, a document without any is in no count and no result;
repeated rows are documents of their own, each counted and ranked; equal scores are ranked by
``doc_id``, a null one first; items of equal ``item_id`` are each answered; an item without terms, or
whose terms no document holds, has no result; empty tables give an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegate.llm.common import discard, shared_folder, slices, stored, whole

TOP = 10
#: Bits that a term sets in a signature, and least signature bits for each term in it (at most twice as many).
HASHES, BITS = 4, 8
#: A block's documents and bytes at most (one document's signature may be larger).
BLOCK_DOCUMENTS, BLOCK_BYTES = 512, 1 << 20
#: Query terms that one plan carries (an item is never cut).
ENTRIES = 20_000
#: Term counts held before they are written.
COUNTS = 300_000
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

# Fixed values of the score.
SCALE, SPREAD, LENGTH, WEIGHT = 1_000_000_000, 8, 75, 1000

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
NOT_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "ids array<string>, tags array<long>, sizes array<long>, most array<long>, width int, slices binary, term binary, documents long"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93][:HASHES], np.uint64)


@contextmanager
def _small_batches(spark: SparkSession, size: str = "33554432") -> Iterator[None]:
    """Inside, a Python worker is handed batches of bounded bytes."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, size)
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def levels(most: int) -> np.ndarray:
    """Counts that have a level: 1, 2, 3, 4, 6, 8, 12, 16... up to ``most``."""
    steps = sorted({1, 2, 3} | {c << k for c in (2, 3) for k in range(int(most).bit_length())})
    return np.array([x for x in steps if x <= most], np.int64)


def _keys(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Hashes of (term, level)."""
    mixed = hashes + level.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB)


def _bits(keys: np.ndarray, width: int) -> np.ndarray:
    """The places of a key's bits in a signature of this width (a power of two)."""
    return ((keys[:, None] * MULTIPLIERS) >> np.uint64(65 - width.bit_length())).astype(np.int64)


class Document(NamedTuple):
    id: str | None
    tag: int
    size: int
    most: int
    keys: np.ndarray


def _block(documents: list[Document], width: int) -> dict:
    matrix = np.zeros((width, len(documents)), bool)
    for k, document in enumerate(documents):
        matrix[_bits(document.keys, width).ravel(), k] = True
    return {"ids": [d.id for d in documents], "tags": [d.tag for d in documents], "sizes": [d.size for d in documents],
            "most": [d.most for d in documents], "width": width, "slices": np.packbits(matrix, axis=1).tobytes(),
            "term": None, "documents": None}


def _documents(frame: pd.DataFrame) -> tuple[list[Document], list[bytes], np.ndarray]:
    """A batch's documents with terms, its different terms, and how many documents hold each."""
    texts = [terms_of(t) for t in frame["text"]]
    size = np.array([len(t) for t in texts], np.int64)
    codes, names = pd.factorize(np.array([t for text in texts for t in text] or [b""], object))
    codes = codes[:int(size.sum())]
    pairs, count = np.unique(np.repeat(np.arange(len(texts)), size) * len(names) + codes, return_counts=True)
    owner, term = pairs // len(names), pairs % len(names)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in names], np.uint64)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    steps = levels(int(count.max(initial=1)))
    out = []
    for k, (id_, tag) in enumerate(zip(frame["id"], frame["tag"])):
        if not size[k]:
            continue
        n, h = count[ends[k]:ends[k + 1]], hashes[term[ends[k]:ends[k + 1]]]
        keys = np.concatenate([_keys(h[n >= x], np.full(int((n >= x).sum()), j)) for j, x in enumerate(steps[steps <= n.max()])])
        out.append(Document(id_, int(tag), int(size[k]), int(n.max()), keys))
    return out, list(names), np.bincount(term, minlength=len(names))


def _indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list[Document]] = {}
    counts: Counter[bytes] = Counter()

    def counted() -> pd.DataFrame:
        none = [None] * len(counts)
        rows = dict.fromkeys(("ids", "tags", "sizes", "most", "width", "slices"), none)
        out = pd.DataFrame(rows | {"term": list(counts), "documents": list(counts.values())}, dtype=object)
        counts.clear()
        return out

    for frame in slices(frames, size=2 << 20):
        documents, names, found = _documents(frame)
        for name, n in zip(names, found.tolist()):
            if n:
                counts[name] += n
        for document in documents:
            width = max(256, 1 << (BITS * len(document.keys) - 1).bit_length())
            block = held.setdefault(width, [])
            block.append(document)
            if len(block) >= BLOCK_DOCUMENTS or width * (len(block) + 1) > 8 * BLOCK_BYTES:
                yield pd.DataFrame([_block(held.pop(width), width)])
        if len(counts) > COUNTS:
            yield counted()
    for width in sorted(held):
        yield pd.DataFrame([_block(held[width], width)])
    if counts:
        yield counted()


def index(docs: DataFrame) -> DataFrame:
    """The signature blocks and, as rows of their own, the terms with their counts of documents; stored."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64(whole()).alias("tag"), whole().alias("text"))
    with _small_batches(docs.sparkSession):
        return stored(rows.mapInPandas(_indexed, INDEX))


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def weighted(items: DataFrame, found: DataFrame, n_documents: int) -> DataFrame:
    """``item, item_id, terms``: each item's terms that documents hold, with weight and count; stored."""
    split = F.regexp_extract_all(_lower(whole()), F.lit(NOT_TERM), F.lit(0))
    # Stored first: the number of an item is the same for all who read it.
    given = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", split.alias("words")))
    asked = given.select("item", F.explode("words").alias("word")).groupBy("item", "word").agg(F.count("*").alias("times"))
    held = (found.where("term IS NOT NULL").select(F.col("term").cast("string").alias("word"), "documents")
            .join(asked.select("word").distinct(), "word", "left_semi")
            .groupBy("word").agg(F.sum("documents").alias("documents")))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log(F.lit(2.0 * n_documents + 2) / (2 * F.col("documents") + 1)))
    lists = (asked.join(held, "word").select("item", F.struct(
        F.col("word"), weight.cast("long").alias("weight"), F.col("times")).alias("t"))
             .groupBy("item").agg(F.collect_list("t").alias("terms")))
    out = stored(given.select("item", "item_id").join(lists, "item"))
    discard(given)
    return out


class Queries:
    """A block of items: their terms once each, the entries (item, term, weight) by item."""

    def __init__(self, items: list, n_documents: int, n_terms: int):
        self.items = [r["item"] for r in items]
        place: dict[bytes, int] = {}
        item, term, gain = [], [], []
        for k, row in enumerate(items):
            for t in row["terms"]:
                item.append(k)
                term.append(place.setdefault(t["word"].encode(), len(place)))
                gain.append(t["weight"] * t["times"])
        self.names = list(place)
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.names], np.uint64)
        self.item, self.term, self.gain = (np.array(x, np.int64) for x in (item, term, gain))
        self.heads = np.flatnonzero(np.diff(self.item, prepend=-1))
        self.n_documents, self.n_terms = n_documents, n_terms

    def factors(self, times: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a term that occurs so often adds to the score of a document of this size, for weight 1."""
        m = 100 - LENGTH + LENGTH * size * self.n_documents // self.n_terms
        return SCALE * times // (1000 * times + SPREAD * m)

    def bounds(self, block) -> np.ndarray:
        """An upper bound of each item's score in each document of a block."""
        size, most = np.asarray(block.sizes, np.int64), np.asarray(block.most, np.int64)
        rows = np.frombuffer(block.slices, np.uint8).reshape(block.width, -1)
        steps = levels(int(most.max()))
        nexts = np.append(steps[1:] - 1, most.max())
        best = np.zeros((len(self.names), len(size)), np.int64)
        seen, before = np.arange(len(self.names)), np.zeros(len(size), np.int64)
        for j in range(len(steps)):
            places = _bits(_keys(self.hashes[seen], np.full(len(seen), j)), block.width)
            maps = np.bitwise_and.reduce(rows[places], axis=1)
            some = maps.any(axis=1)
            seen, maps = seen[some], maps[some]
            factor = self.factors(np.minimum(nexts[j], most), size)
            grown = np.where(steps[j] <= most, factor - before, 0)
            best[seen] += np.unpackbits(maps, axis=1, count=len(size)) * grown
            before = before + grown
        out = np.zeros((len(self.items), len(size)), np.int64)
        few = max(1, (1 << 22) // len(size))
        for head in range(0, len(self.heads), few // 64 + 1):  # a few items at a time
            own = self.heads[head:head + few // 64 + 1]
            a, b = own[0], self.heads[head + len(own)] if head + len(own) < len(self.heads) else len(self.item)
            out[self.item[own]] = np.add.reduceat(best[self.term[a:b]] * self.gain[a:b, None], own - a, axis=0)
        return out

    def scores(self, text: str, wanted: list[int]) -> list[int]:
        """The exact scores of a text."""
        found = terms_of(text)
        count = Counter(found)
        times = np.array([count[t] for t in self.names], np.int64)
        gains = self.factors(times, np.int64(len(found)))
        ends = np.append(self.heads, len(self.item))
        return [int((gains[self.term[ends[k]:ends[k + 1]]] * self.gain[ends[k]:ends[k + 1]]).sum()) for k in wanted]


BOUNDS = "place int, id string, tag long, bound long"


def _highest(frames: Iterator[pd.DataFrame], queries: Queries, k: int) -> Iterator[pd.DataFrame]:
    """The documents of highest bound for each item, a few of each block."""
    for frame in frames:
        for block in frame.itertuples():
            bounds = queries.bounds(block)
            few = min(k, bounds.shape[1])
            column = np.argpartition(-bounds, few - 1, axis=1)[:, :few].ravel()
            place = np.repeat(np.arange(len(bounds)), few)
            some = bounds[place, column] > 0
            place, column = place[some], column[some]
            if len(place):
                yield _candidates(block, bounds, place, column)


def _candidates(block, bounds: np.ndarray, place: np.ndarray, column: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"place": place, "id": np.array(block.ids, object)[column],
                         "tag": np.asarray(block.tags)[column], "bound": bounds[place, column]})


def _reaching(frames: Iterator[pd.DataFrame], queries: Queries, least: np.ndarray) -> Iterator[pd.DataFrame]:
    """Every document whose bound is not below an item's threshold."""
    for frame in frames:
        for block in frame.itertuples():
            bounds = queries.bounds(block)
            place, column = np.nonzero(bounds >= least[:, None])
            if len(place):
                yield _candidates(block, bounds, place, column)


def _scored(frames: Iterator[pd.DataFrame], queries: Queries) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        rows = [(place, row.id, score) for row in frame.itertuples()
                for place, score in zip(row.places, queries.scores(row.text, list(row.places))) if score > 0]
        yield pd.DataFrame(rows, columns=["place", "id", "score"])


def _exact(docs: DataFrame, candidates: DataFrame, queries: Queries) -> DataFrame:
    """``place, doc_id, score`` of the candidates, one row for each row of the documents; stored."""
    wanted = candidates.groupBy("id", "tag").agg(F.collect_set("place").alias("places"))
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64(whole()).alias("tag"), whole().alias("text"))
    met = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["tag"] == wanted["tag"])).select(
        texts["id"], "text", "places")
    kind = docs.schema["doc_id"].dataType
    return stored(met.mapInPandas(partial(_scored, queries=queries), "place int, id string, score long")
                  .select("place", F.col("id").cast(kind).alias("doc_id"), "score"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answer(docs: DataFrame, blocks: DataFrame, queries: Queries, k: int, rescore: bool = True) -> DataFrame:
    """``place, doc_id, score, rank`` of a block of items."""
    first = Window.partitionBy("place").orderBy(F.desc("bound"), "id", "tag")
    seeds = stored(blocks.mapInPandas(partial(_highest, queries=queries, k=k), BOUNDS)
                   .withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n"))
    exact = _exact(docs, seeds, queries)
    last = stored(_ranked(exact, k).where(F.col("rank") == k).select(
        "place", F.col("score").alias("least"), F.col("doc_id").alias("last")))
    least = np.ones(len(queries.items), np.int64)  # a result's score is above 0
    for row in last.select("place", "least").collect():  # a number for each item of the block
        least[row["place"]] = row["least"]
    reaching = blocks.mapInPandas(partial(_reaching, queries=queries, least=least), BOUNDS)
    late = (F.col("bound") == F.col("least")) & (F.col("id").cast(docs.schema["doc_id"].dataType) > F.col("last"))
    candidates = stored(reaching.join(last, "place", "left").where(~F.coalesce(late, F.lit(False))).select("place", "id", "tag"))
    found = _exact(docs, candidates, queries)
    discard(seeds, exact, last, candidates)
    return found


def _batches(items: DataFrame, entries: int) -> Iterator[list]:
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append(row)
        size += len(row["terms"])
        if size >= entries:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, signatures: DataFrame | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, fewer if fewer hold its terms.

    ``signatures`` is the stored ``index`` of the same documents, made here if not given.
    """
    spark = docs.sparkSession
    made = index(docs) if signatures is None else signatures
    blocks = made.where("term IS NULL").select("ids", "tags", "sizes", "most", "width", "slices")
    totals = blocks.select(F.size("sizes").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")
                           ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    asked = weighted(items, made, totals["n"])
    folder = f"{shared_folder(spark)}/tablegate/ranked-{uuid.uuid4().hex}"
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    with _small_batches(spark):
        for held in _batches(asked, ENTRIES):
            queries = Queries(held, totals["n"], totals["l"])
            names = spark.createDataFrame([(p, i) for p, i in enumerate(queries.items)], "place int, item long")
            found = _answer(docs, blocks, queries, k)
            (_ranked(found, k).join(names, "place").join(asked.select("item", "item_id"), "item")
             .select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(folder))
            discard(found)
    discard(asked)
    if signatures is None:
        discard(made)
    return spark.read.schema(schema).parquet(folder)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
s AS MATERIALIZED (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY row),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM s),
q AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM (
  SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item, term),
f AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM f, t GROUP BY term, docs),
r AS (SELECT item, any_value(item_id) AS item_id, row, any_value(s.doc_id) AS doc_id, CAST(sum(times * weight *
        ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN s USING (row), t GROUP BY item, row),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank
      FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
