"""SimHash near-duplicates: tiled exact comparison of the fingerprints.

1. Each whole text gets a 64-bit fingerprint of its word shingles.  Equal fingerprints are
   one (partial aggregation first), so a group of copies, however large, is one row.
2. Fingerprints are tiled by the population counts of their four 16-bit words.  Two that
   differ in at most r bits differ in these counts by at most r in sum; tile pairs beyond that
   are skipped, all others are compared in full by exclusive-or and bit counts in numpy.  Tiles
   and their visitors are split by hash so that no group grows with the data.
3. A group returns a spanning forest of its links, not all pairs; components come from star
   contractions in Spark, with stored rounds.

Defined cases: a null text is empty; a text without words has fingerprint 0 and is linked
like any other; fewer words than a shingle are one shingle; repeated rows give repeated
results; null ids count in no minimum (a component of null ids alone has a null id); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import TAG, slices, stored, whole
from tablegate.llm.graph import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
WORDS, BITS = 4, 16
#: Rows of a tile, and of the visitors compared with it at once.
TILE, VISITORS = 1 << 13, 1 << 17


def fingerprint(text: str, shingle: int) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hash64 = xxhash.xxh64_intdigest
    hashes = np.array([hash64(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # very long texts in parts
        part = hashes[at:at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(frames: Iterator[pd.DataFrame], shingle: int) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        yield pd.DataFrame({
            "doc_id": frame["doc_id"].astype("Int64"),
            "fp": np.array([fingerprint(t, shingle) for t in frame["text"]], dtype=np.int64)})


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return docs.select("doc_id", whole().alias("text")).mapInPandas(
        partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def _steps(distance: int) -> np.ndarray:
    """Differences of the word counts, of at most ``distance`` in sum: none, and those upwards of zero."""
    found = [d for d in product(range(-distance, distance + 1), repeat=WORDS) if sum(map(abs, d)) <= distance]
    return np.array([d for d in found if d >= (0,) * WORDS])


def _neighbours(frames: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """The tiles not below its own that a tile's rows have to visit, its own among them."""
    scale = (BITS + 1) ** np.arange(WORDS)[::-1]
    for frame in frames:
        tile = frame["tile"].to_numpy(np.int64)
        near = (tile[:, None] // scale % (BITS + 1))[:, None, :] + _steps(distance)[None, :, :]
        row, step = np.nonzero(((near >= 0) & (near <= BITS)).all(axis=2))
        yield pd.DataFrame({"of": tile[row], "n": frame["n"].to_numpy()[row], "tile": near[row, step] @ scale})


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        up = parent[root]
        if (up == root).all():
            return root
        root = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _find(parent, a), _find(parent, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def forest(home: np.ndarray, visitors: np.ndarray, distance: int, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: home rows with each other (``inner``) and with the visitors."""
    rows = np.concatenate([home, visitors]).view(np.uint64)
    other = rows if inner else rows[len(home):]
    shift = 0 if inner else len(home)
    parent, height = np.arange(len(rows)), max(1, (1 << 20) // max(1, len(other)))
    for at in range(0, len(home), height):
        i, j = np.nonzero(np.bitwise_count(rows[at:min(at + height, len(home)), None] ^ other[None, :]) <= distance)
        i, j = i + at, j + shift
        keep = i < j
        if keep.any():
            _unite(parent, i[keep], j[keep])
    root = _find(parent, np.arange(len(rows)))
    member = np.nonzero(root != np.arange(len(rows)))[0]
    return rows[member].view(np.int64), rows[root[member]].view(np.int64)


def _compare(frames: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Groups of rows sorted by (tile, part, room): the links of each, one group in memory."""
    rest = None
    key = ["tile", "part", "room"]

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[key].to_numpy()
        cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        at_home, fps, a, b = rows["home"].to_numpy(), rows["fp"].to_numpy(np.int64), [], []
        for low, high in zip(np.append(0, cuts), np.append(cuts, len(rows))):
            home, group = at_home[low:high], fps[low:high]
            inner = bool(keys[low, 2] == 0)
            if home.any() and (inner or not home.all()):
                found = forest(group[home], group[~home], distance, inner)
                a.append(found[0])
                b.append(found[1])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(rest):
            continue
        whole_to = len(rest) - int((rest[key] == rest[key].iloc[-1]).all(axis=1).sum())
        if whole_to:
            yield compared(rest.iloc[:whole_to])
            rest = rest.iloc[whole_to:]
    if rest is not None and len(rest):
        yield compared(rest)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that connect all within ``distance``."""
    tile = F.lit(0).cast("long")
    for i in range(WORDS):
        word = F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit(2 ** BITS - 1).cast("long"))
        tile = tile * (BITS + 1) + F.bit_count(word)
    fps = stored(distinct.select("fp", tile.alias("tile")))
    # At most 17**4 tiles, whatever the data, and 65 neighbours of each.
    sizes = stored(fps.groupBy("tile").agg(F.count("*").alias("n")))
    near = stored(sizes.mapInPandas(partial(_neighbours, distance=distance), "of long, n long, tile long")
                  .join(sizes.select("tile"), "tile", "left_semi"))
    tiles = stored(sizes.join(near.groupBy("tile").agg(F.sum("n").alias("visits")), "tile").select(
        "tile", F.ceil(F.col("n") / TILE).cast("int").alias("parts"),
        F.ceil(F.col("visits") / VISITORS).cast("int").alias("rooms")))
    part, room = (F.pmod(F.xxhash64("fp", F.lit(k)), F.col(c)).cast("int") for k, c in ((1, "parts"), (2, "rooms")))
    home = (fps.join(F.broadcast(tiles), "tile")  # a tile is compared with one room of visitors at a time
            .select("fp", "tile", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"),
                    F.lit(True).alias("home")))
    visits = (fps.select("fp", F.col("tile").alias("of")).join(near.join(tiles, "tile").drop("n"), "of")
              .select("fp", "of", "tile", part.alias("own"), room.alias("room"),
                      F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
              .where("of <> tile OR part > own")
              .select("fp", "tile", "part", "room", F.lit(False).alias("home")))
    return (home.unionByName(visits).repartition("tile", "part", "room").sortWithinPartitions("tile", "part", "room")
            .mapInPandas(partial(_compare, distance=distance), "a long, b long"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the component's smallest id."""
    rows = stored(fingerprints(docs, shingle))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), distance))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(placed.join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents of which none with a smaller id is in the same component, all their columns.

    Rows of null id are kept where their component has no other id; of repeated rows all stay.
    """
    groups = simhash_groups(docs, shingle, distance)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias(TAG)).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep[TAG]), "left_semi")
