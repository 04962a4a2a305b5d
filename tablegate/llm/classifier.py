"""Quality classifier: histogram gradient-boosted trees over document statistics.

1. Statistics of whole texts (lengths, character classes, word and line repetition, word shapes)
   are computed in the tasks.  Labels, ids, language and source are no inputs.
2. The trees are fitted on at most ``max_rows`` labelled rows (a documented bound: the
   labelled rows of smallest id hash); rows held out by ``crc32(doc_id) % 5 = 0`` are never
   used.  Statistics are cut into at most ``BINS`` bins by quantiles, and each level's splits
   come from histograms of gradients.
3. Trees are complete and flattened into arrays (statistic, threshold, value), so a batch of
   rows walks a tree level by level in numpy.

Defined cases: a null or empty text has all statistics 0 and gets a score as well; rows whose
label or text is null do not teach (null text counts as empty for scoring); ids labelled twice
take the larger label; without both labels among the taught rows the score is the (smoothed)
share of label 1; an empty table gives an empty result; repeated rows get equal scores; a null
id counts as the empty text; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.llm.common import TAG, slices, whole

#: Bound on the rows that teach; bins of a statistic; shape of the ensemble.
MAX_ROWS, BINS, TREES, DEPTH, RATE, LAMBDA = 20_000, 64, 60, 4, 0.2, 1.0
THRESHOLD = 0.3
FOLDS = 5

STATISTICS = (
    "bytes", "words", "lines", "word_length", "longest_word", "distinct_words", "distinct_pairs", "top_word",
    "distinct_lines", "line_words", "short_lines", "closed_lines", "upper", "lower", "digits", "non_ascii",
    "symbols", "marks", "bars", "stops", "entropy", "upper_words", "marked_words", "repeated_neighbours")

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "non_ascii": range(128, 256),
    "symbols": b"#*$%&<>@^~_+=\\", "marks": b"!?", "bars": b"|", "stops": b".,;:"}
_MASKS = np.array([[c in set(chosen) for c in range(256)] for chosen in _CLASSES.values()], dtype=np.float64)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n, share = len(words), bytes_ / len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ends = bytes_[[*b"!?#*$%&"]].sum()
    filled = share[share > 0]
    return [
        np.log1p(len(data)), np.log1p(n), np.log1p(len(lines)), sum(map(len, words)) / n, max(map(len, words)),
        len(counts) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), max(counts.values()) / n,
        len(set(lines)) / len(lines), n / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        sum(x.rstrip()[-1:] in b".!?:;" for x in lines) / len(lines),
        *(_MASKS @ share), float(-(filled * np.log2(filled)).sum()),
        sum(map(bytes.isupper, words)) / n, ends / n, sum(map(bytes.__eq__, words, words[1:])) / n]


def _described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        out = pd.DataFrame({c: frame[c] for c in frame if c != "text"})
        out["x"] = [statistics(t) for t in frame["text"]]
        yield out


class Model(NamedTuple):
    """Trees as arrays: node k has the children 2k+1 and 2k+2; the leaves are the last level."""

    base: float
    statistic: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray      # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for statistic, threshold, value in zip(self.statistic, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < len(statistic):  # all rows are on the same level
                node = 2 * node + 1 + (x[rows, statistic[node]] > threshold[node])
            total += value[node - len(statistic)]
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Model:
    """Boosted trees on the logistic loss; splits from histograms of gradients, level by level."""
    ones = float(y.sum()) if len(y) else 0.0
    base = np.log((ones + 1) / (len(y) - ones + 1))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not 0 < ones < len(y):
        return Model(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([e.searchsorted(x[:, f], "left") for f, e in enumerate(edges)])
    splits = np.zeros((x.shape[1], BINS), dtype=bool)
    cuts = np.full((x.shape[1], BINS), np.inf)
    for f, e in enumerate(edges):
        splits[f, :len(e)], cuts[f, :len(e)] = True, e
    total = np.full(len(y), base)
    statistic, threshold, value = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        chosen, limits = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2 ** level - 1, 2 ** level
            best = np.full(n, 1e-6)
            for f in range(x.shape[1]):
                at = (node - first) * BINS + binned[:, f]
                g = np.bincount(at, grad, n * BINS).reshape(n, BINS).cumsum(axis=1)
                h = np.bincount(at, hess, n * BINS).reshape(n, BINS).cumsum(axis=1)
                ga, ha = g[:, -1:], h[:, -1:]
                gain = (g * g / (h + LAMBDA) + (ga - g) ** 2 / (ha - h + LAMBDA) - ga * ga / (ha + LAMBDA))
                gain[:, ~splits[f]] = 0
                cut = gain.argmax(axis=1)
                better = gain[np.arange(n), cut] > best
                best[better] = gain[np.arange(n), cut][better]
                chosen[first:first + n][better] = f
                limits[first:first + n][better] = cuts[f, cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), chosen[node]] > limits[node])
        leaf = node - inner
        values = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + LAMBDA)
        total += values[leaf]
        statistic.append(chosen)
        threshold.append(limits)
        value.append(values)
    return Model(base, np.array(statistic), np.array(threshold), np.array(value))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled documents outside the held-out fold, ``max_rows`` at most."""
    taught = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
              .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # At most max_rows pairs of numbers: the documents' texts stay where they are.
    rows = (docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(taught), "doc_id")
            .mapInPandas(_described, "doc_id long, quality int, x array<double>")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).collect())
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["quality"] == 1 for r in rows], dtype=np.float64))


def _scores(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for frame in _described(frames):
        x = np.array(frame["x"].tolist(), dtype=np.float64).reshape(len(frame), len(STATISTICS))
        frame = frame.drop(columns="x")
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        frame["score"] = model.score(x)
        yield frame


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, tag, held_out, score, predicted`` of every row."""
    return (docs.select("doc_id", F.xxhash64("text").alias("tag"), whole().alias("text"))
            .mapInPandas(partial(_scores, model=model), "doc_id long, tag long, score double")
            .select("doc_id", "tag", held_out().alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all their columns."""
    bad = scored(docs, train(docs, labels), threshold).where("predicted = 0").select(
        F.col("doc_id").alias("__tablegate_id"), F.col("tag").alias("__tablegate_of")).distinct()
    tagged = docs.withColumn(TAG, F.xxhash64("text"))
    return tagged.join(bad, tagged["doc_id"].eqNullSafe(bad["__tablegate_id"])
                       & (tagged[TAG] == bad["__tablegate_of"]), "left_anti").drop(TAG)
