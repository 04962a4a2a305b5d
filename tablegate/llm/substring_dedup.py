"""Substring dedup by seed and extend, on words.

1. Winnowed anchors: of every ``size`` consecutive words the ``gram`` with the smallest hash.
   Every window of the threshold length holds exactly one, so no repeat is missed.
2. Documents meet on anchors that occur twice or more (a join, never pairs within a group).
   A seed is extended both ways over the words that share its anchor: where the whole
   extension occurs earlier it is covered at once.
3. Seeds with different extensions: for each way to extend (o words to the left, size-gram-o
   to the right) equal extensions meet by hash and the earliest stays.  Adjacent matched
   extensions put together are the maximal repeats of ``size`` words or more; words inside go.

Words are compared by 64-bit hashes of runs within equal 64-bit anchors.

Defined cases: null and empty texts have no words; repeated rows (equal id and text) are one
document, reported for each row; rows of equal id and other text are ordered by the text's
hash; a null id is smaller than any other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

from tablegate.llm import repeats
from tablegate.llm.common import discard, keyed, slices

SIZE, GRAM = 20, 6
SCHEMA = ("doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, clean_text string")


def _cleaned(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in slices(frames):
        rows = []
        for doc, text, spans in zip(frame["doc_id"], frame["text"], frame["spans"]):
            words = repeats.word_list(text)
            hit = repeats.mask(spans, len(words), size)
            start, end = repeats.merged(hit)
            kept = [w for w, h in zip(words, hit.tolist()) if not h] if len(start) else words
            rows.append((doc, len(words), int(hit.sum()),
                         [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())],
                         b" ".join(kept).decode("utf-8", "surrogatepass")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "clean_text"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def substring_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, spans`` (word places) and ``clean_text``: the words kept."""
    kind = repeats.Kind(words=True, size=size, gram=gram)
    docs = keyed(docs)
    rows = repeats.repeated_runs(docs, kind)
    firsts = repeats.first_places(rows)
    whole = repeats.covered(rows, firsts)
    discard(rows)
    later = repeats.later_windows(docs, repeats.variants(firsts), kind)
    lists = repeats.lists_of(whole.unionByName(later))
    discard(whole, firsts, later)
    return repeats.with_spans(docs, lists).mapInPandas(partial(_cleaned, size=size), SCHEMA)
