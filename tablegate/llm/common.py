"""What the operators share: row keys, written intermediate tables, let-bindings.

Rows and keys.  An operator reads ``doc_id`` and ``text`` only; other columns, whatever
their names, pass by untouched.  A document is a row; rows of equal ``doc_id`` and ``text``
are one document that is reported once per row, and rows of equal ``doc_id`` and different
texts are told apart by the text's hash.  A null ``doc_id`` is an id of its own, smaller
than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegate.sources.store import discard, shared_folder, shuffles_removed, stored  # noqa: F401

#: ASCII white space, the separators of words.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
TAG = "__tablegate_tag"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once, also where lambdas use it per element."""
    return F.transform(F.array(value), body)[0]


def whole(text: str = "text") -> Column:
    """A text, null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, tag (hash of the text) and text (never null)."""
    return docs.select("doc_id", F.xxhash64(whole()).alias("tag"), whole().alias("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tag"] == right["tag"])


def slices(frames: Iterator[pd.DataFrame], column: str = "text", size: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """The batches cut so that each holds about ``size`` characters, or one row."""
    for frame in frames:
        if not len(frame):
            continue
        ends = frame[column].str.len().cumsum().to_numpy()
        start, base = 0, 0
        while start < len(frame):
            stop = max(int(ends.searchsorted(base + size, "right")), start + 1)
            yield frame.iloc[start:stop]
            start, base = stop, int(ends[stop - 1])
        pa.default_memory_pool().release_unused()  # workers live on, and what they hold adds up
