"""Licence scan by conditional compression.

1. Candidate blocks of a whole text are its paragraphs (runs of lines without an empty one
   between) that hold a licence cue, with all their lines; a cue may go over a line's end.
2. Every block is compressed in overlapping pieces of about the templates' size, alone and with
   each template as a raw zstandard dictionary.  The most that a dictionary saves of a piece
   (the share of its own size) ranks the templates; it rules none out.
3. Every template whose telling words (names, version numbers: what tells it from its relatives)
   stand in the block is looked for by exact wording: a match is a shortest run of words that
   holds the template's words in order, with at most ``MAX_DIFFERENCE`` of them missing, and all
   its telling words.  Words between are counted (``extra``), not bounded.
4. A block has a row per match, in the order of fewest differing words, then of the longer
   template, the rank and the name.  A match gives way to an earlier one with whose telling
   words it shares a place, if it lies inside that one, misses a word, or has the same telling
   words; and to an earlier one of its own template that it overlaps.

Every document is scanned where it lies; nothing is shuffled.

Defined cases: a null or empty text has no blocks; repeated rows are scanned each; a block
longer than ``BLOCK`` characters is cut there into overlapping pieces that are all scanned (and
the matches of two pieces chosen from alike); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from tablegate.llm.common import slices, whole

# Wordings of licence notices, and the words that must be there exactly.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "apache 2.0"),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0", "apache 2.0"),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met", "redistribution binary"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "cc by 4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "cc by-nc 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "cc by-sa 4.0"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "cc0 1.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "gnu general 2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "gnu general 3"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", "gnu lesser 3"),
    "MIT": ("Released under the MIT License", "mit"),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "permission granted"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2.0"),
}
CUE = re.compile(
    r"licen[cs]e|copyright|public\W+domain|spdx|permission\W+is\W+hereby|redistribution\W+and\W+use|creative\W+commons",
    re.I)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
MAX_DIFFERENCE, BLOCK, OVERLAP = 0.2, 20_000, 2_000
#: Characters of a compressed piece; every second one starts in the middle of another, so that a notice of
#: half the size lies whole in one.
PIECE = 512
SCHEMA = ("doc_id long, block int, start long, end long, license string, saved double, "
          "missing int, extra int")


class Match(NamedTuple):
    """In the order of choice; ``told`` has the places of the telling words, all places are of the text."""
    differing: int
    shorter: int
    rank: int
    start: int
    end: int
    license: str
    block: int
    saved: float
    missing: int
    extra: int
    told: frozenset[int]
    key: frozenset[str]

    def yields(self, other: Match) -> bool:
        """Whether this is no notice of its own beside one that was chosen earlier."""
        if self.license == other.license:
            return self.start < other.end and other.start < self.end
        inside = other.start <= self.start and self.end <= other.end
        return bool(self.told & other.told) and (self.missing > 0 or inside or self.key == other.key)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def shortest(block: list[str], wanted: list[str]) -> Iterator[tuple[int, int, int]]:
    """Shortest runs of words with the wanted ones in order: first and last place, words missing.

    ``latest[i][m]`` is the latest start of a run with the first ``i`` words, ``m`` of them missing;
    a run that starts no later than an earlier one with as many missing holds that one.
    """
    n, most = len(wanted), int(MAX_DIFFERENCE * len(wanted))
    places: dict[str, list[int]] = {}
    for i in reversed(range(n)):
        places.setdefault(wanted[i], []).append(i)
    latest = [[-1] * (most + 1) for _ in range(n + 1)]
    for at, word in enumerate(block):
        for i in places.get(word, ()):
            for m in range(most + 1):
                start = at if m == i else latest[i][m]
                for skipped in range(min(most - m, n - i - 1) + 1) if start >= 0 else ():
                    row, k = latest[i + 1 + skipped], m + skipped
                    if start > row[k]:
                        row[k] = start
                        if i + 1 + skipped == n:
                            yield start, at, k


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, str]] = TEMPLATES):
        self.alone = zstandard.ZstdCompressor(level=9)
        self.given = {
            name: (zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(
                text.encode() + b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)), words_of(text), frozenset(key.split()))
            for name, (text, key) in templates.items()}

    def savings(self, block: str) -> dict[str, list[float]]:
        """Share of each piece's compressed size that each template saves."""
        saved: dict[str, list[float]] = {name: [] for name in self.given}
        for at in range(0, max(len(block) - PIECE // 2, 1), PIECE // 2):
            data = block[at:at + PIECE].encode("utf-8", "surrogatepass")
            size = len(self.alone.compress(data))
            for name, (compressor, _, _) in self.given.items():
                saved[name].append(1 - len(compressor.compress(data)) / size)
        return saved

    def runs(self, block: list[str], name: str) -> Iterator[tuple[int, int, int, int, frozenset[int]]]:
        """Matches of a template: first and last word, words missing and between, places of telling words."""
        _, wanted, key = self.given[name]
        told = {w: [i for i, x in enumerate(block) if x == w] for w in key}
        if not all(told.values()):
            return
        for first, last, missing in shortest(block, wanted):
            for places in told.values():  # one out of order is taken from nearby
                k = bisect_left(places, first)
                if k == len(places) or places[k] > last:
                    near = min(places[max(k - 1, 0):k + 1], key=lambda i: max(first - i, i - last))
                    first, last = min(first, near), max(last, near)
            inside = frozenset(i for places in told.values()
                               for i in places[bisect_left(places, first):bisect_right(places, last)])
            yield first, last, missing, last - first + 1 - (len(wanted) - missing), inside

    def matches(self, text: str, low: int, high: int, block: int) -> Iterator[Match]:
        """All matches of all templates in a block."""
        found, saved = list(WORD.finditer(text, low, high)), self.savings(text[low:high])
        if found and found[0].start() == low > 0 and WORD.match(text[low - 1]):
            del found[0]  # the rest of a word
        if found and found[-1].end() == high and WORD.match(text[high:high + 1]):
            del found[-1]
        words = [w[0].lower() for w in found]
        ranked = sorted((-max(shares), name) for name, shares in saved.items())
        for rank, (_, name) in enumerate(ranked):
            _, wanted, key = self.given[name]
            for first, last, missing, extra, told in self.runs(words, name):
                start, end = found[first].start(), found[last].end()
                step = PIECE // 2
                shares = saved[name][max((start - low) // step - 1, 0):(end - 1 - low) // step + 1]
                yield Match(missing + extra, -len(wanted), rank, start, end, name, block, max(shares), missing, extra,
                            frozenset(found[i].start() for i in told), key)

    def notices(self, text: str) -> Iterator[tuple]:
        """Rows of a text without its key: block, start, end, license, saved, missing, extra."""
        held: list[Match] = []  # chosen, and not yet given out
        for block, (low, high) in enumerate(blocks(text)):
            yield from (m[6:7] + m[3:6] + m[7:10] for m in held if m.end <= low)
            kept: list[Match] = []
            for new in sorted([*(m for m in held if m.end > low), *self.matches(text, low, high, block)]):
                if not any(new.yields(m) for m in kept):
                    kept.append(new)
            held = sorted(kept, key=lambda m: m.start)
            if not held:
                yield block, low, high, None, 0.0, 0, 0
        yield from (m[6:7] + m[3:6] + m[7:10] for m in held)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Places of candidate blocks: whole paragraphs with a cue, the long ones in pieces."""
    at, begin, end = 0, None, 0
    for line in [*text.split("\n"), ""]:
        if line.strip():
            begin, end = (at if begin is None else begin), at + len(line)
        elif begin is not None:
            if CUE.search(text, begin, end):
                for low in range(begin, max(end - OVERLAP, begin + 1), BLOCK - OVERLAP):
                    yield low, min(low + BLOCK, end)
            begin = None
        at += len(line) + 1


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scanner = Scanner()
    for frame in slices(frames):
        rows = []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            found = list(scanner.notices(text)) if CUE.search(text) else []
            rows += [(doc, *row) for row in found or [(None,) * 7]]
        out = pd.DataFrame(rows, columns=["doc_id", "block", "start", "end", "license", "saved", "missing", "extra"])
        whole_numbers = ["doc_id", "block", "start", "end", "missing", "extra"]
        yield out.astype(dict.fromkeys(whole_numbers, "Int64") | {"saved": "Float64", "license": object})


def license_scan(docs: DataFrame) -> DataFrame:
    """A row per notice with its own place (in characters); one with the block's place and null
    ``license`` per candidate block in which no template is confirmed; and one with null ``block``
    for a document without any."""
    return docs.select("doc_id", whole().alias("text")).mapInPandas(_scan, SCHEMA)
