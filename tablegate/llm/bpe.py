"""Ids of whole texts by a tokenizer file, each distinct unit encoded once per worker.

No token of these vocabularies reaches from a character into the ASCII white space after it,
so a text's ids are those of its units, put together.  A unit is

* ``joined=True`` (byte-level tokenizers): white space and the characters up to the next one;
* ``joined=False`` (tokenizers that drop white space): the characters between white space.

Texts for which cutting could matter (special strings, other white space next to ASCII white
space) are encoded whole by the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablegate.llm.common import SPACES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A worker keeps two generations of units, each of this size at most: when the young one is
#: full it becomes the old one, and units met again move back.  Longer units are not kept.
UNITS_KEPT, UNIT_LENGTH = 250_000, 48
#: Closing marks after a Latin letter or digit, in a unit that is not over long.
STEM = r"(?s)^(?P<stem>.{0,47}[0-9A-Za-z\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])" \
    r"(?P<marks>[.,;:!?#$%&*]+)$"
#: Other ASCII white space: such texts are cut by the pattern, others at their spaces and line ends.
RARE = "\t\x0b\x0c\r"
#: Before a kept unit that has no space in front.
MARK = "\r"
#: Units put together at once.
GATHERED = 1 << 18
SPACE = "\u0120"  # as byte-level vocabularies spell it
PORTION = 4096
JOINED = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
APART = re.compile(r"[^ \t-\r]+")
#: White space (and the like) outside ASCII: texts that hold any are not cut.
ODD = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029,
       0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]

_open: dict = {}


class Encoder:
    def __init__(self, path: str, joined: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pattern = JOINED if joined else APART
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Texts that hold any of these are not cut.
        self.apart = specials + (list(map(chr, ODD)) if joined else [])
        self.opens = None
        if joined:  # ids of the tokens that begin with a space
            vocabulary = self.library.get_vocab()
            self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library_ids(self, texts: list[str]) -> list[bytes]:
        # In portions: the library's results are far larger than the ids taken from them.
        return [np.asarray(e.ids, dtype="<u4").tobytes() for low in range(0, len(texts), PORTION)
                for e in self.library.encode_batch_fast(texts[low:low + PORTION], add_special_tokens=False)]

    def unit_ids(self, units: list[str]) -> list[bytes]:
        """Ids of each unit.  Those of a space and a word are encoded end to end: their only space
        stands first, so the ids of one reach from a token that begins with a space to the next."""
        if self.opens is None:
            return self.library_ids(units)
        out: dict[str, bytes] = {}
        spaced = [u for u in units if u[0] == " " and u[1:2] not in SPACES]
        for low in range(0, len(spaced), PORTION):
            part = spaced[low:low + PORTION]
            ids = self.library_ids(["".join(part)])[0]
            starts = np.nonzero(self.opens[np.frombuffer(ids, dtype="<u4")])[0] * 4
            if len(starts) == len(part):
                ends = [*starts[1:].tolist(), len(ids)]
                out.update(zip(part, [ids[a:b] for a, b in zip(starts.tolist(), ends)]))
        rest = [u for u in units if u not in out]
        out.update(zip(rest, self.library_ids(rest)))
        return [out[u] for u in units]

    def _spaced(self, text: str) -> bool:
        """Whether every unit is one space or line end and the characters after it (the first may be without)."""
        return not (any(p in text for p in RARE) or "  " in text or " \n" in text or "\n\n" in text or "\n " in text
                    or text[-1:] in (" ", "\n"))

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The units of all texts, as they are kept, and how many each text has.

        A unit is kept without the space before a word; one that has none there, and does not begin with a
        line end, is kept with a mark in front.
        """
        if self.opens is None:
            lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
            units, size = lists.flatten(), pc.list_value_length(lists).to_numpy()
            some = pc.not_equal(units, "")  # before the first word and after the last
            owner = np.repeat(np.arange(len(texts)), size)[some.to_numpy(zero_copy_only=False)]
            return units.filter(some), np.bincount(owner, minlength=len(texts))
        plain = np.array([self._spaced(t) for t in texts], bool)
        size = np.zeros(len(texts), np.int64)
        spaced = [t.replace("\n", " \n") for t, p in zip(texts, plain) if p]
        lists = pc.split_pattern(pa.array([t[1:] if t[:1] == " " else MARK + t for t in spaced], pa.large_string()), " ")
        size[plain] = [n if t else 0 for n, t in zip(pc.list_value_length(lists).to_pylist(), spaced)]
        some = np.array([bool(t) for t in spaced], bool)
        units = (lists if some.all() else lists.filter(pa.array(some))).flatten()
        if plain.all():
            return units, size
        others: list[str] = []
        for k in np.flatnonzero(~plain).tolist():
            found = [u[1:] if u[0] == " " and u[1:2] not in SPACES else u if u[0] == "\n" else MARK + u
                     for u in self.pattern.findall(texts[k])]
            size[k] = len(found)
            others += found
        # Back into the order of the texts.
        both = pa.concat_arrays([units, pa.array(others, pa.large_string())])
        rank = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        return both.take(pa.array(np.argsort(np.repeat(rank, size[rank]), kind="stable"))), size

    def _found(self, names: list[str]) -> list[bytes]:
        """The ids of different units, from the units known or by the library."""
        if len(self.known) > UNITS_KEPT:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        out = list(map(known.get, names))
        new = []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            unit = names[k]
            if (ids := old.get(unit)) is None:
                new.append(k)
            else:
                out[k] = known[unit] = ids
        units = [names[k] for k in new]
        spelt = units if self.opens is None else [u[1:] if u[0] == MARK else u if u[0] == "\n" else " " + u for u in units]
        for k, unit, ids in zip(new, units, self.unit_ids(spelt)):
            out[k] = ids
            if len(unit) <= UNIT_LENGTH:
                known[unit] = ids
        return out

    def _tables(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different units, end to end, and how many each has.

        A closing mark after a Latin letter or digit begins a token of its own: stems and marks are looked up apart,
        so that a word before a comma and before a full stop is one.
        """
        parts = pc.extract_regex(names, STEM)
        stems, marks = pc.struct_field(parts, "stem"), pc.struct_field(parts, "marks")
        cut = pc.is_valid(marks).to_numpy(zero_copy_only=False)
        if self.opens is not None:
            marks = pc.binary_join_element_wise(pa.scalar(MARK, marks.type), marks, pa.scalar("", marks.type))
        both = pa.concat_arrays([pc.coalesce(stems, names), marks.drop_null()]).dictionary_encode()
        found = self._found(both.dictionary.to_pylist())
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, ids = np.cumsum(length) - length, np.frombuffer(b"".join(found), "<u4")
        place = both.indices.to_numpy()
        # Each unit's stem, then its marks: their places in turn.
        turn = np.cumsum(cut) - cut
        order = np.empty(len(place), np.int64)
        order[np.arange(len(names)) + turn] = place[:len(names)]
        order[(np.arange(len(names)) + turn + 1)[cut]] = place[len(names):]
        of = length[place[:len(names)]].copy()
        of[cut] += length[place[len(names):]]
        return _gathered(ids, first[order], length[order]), of

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Units are cut and told apart by Arrow; only different ones are looked up, and their ids are put
        in the places of all by numpy.
        """
        whole = [any(p in t for p in self.apart) for t in texts]
        units, size = self._cut([t for t, w in zip(texts, whole) if not w])
        coded = units.dictionary_encode()
        ids, length = self._tables(coded.dictionary)
        first, place = np.cumsum(length) - length, coded.indices.to_numpy()
        ends = np.cumsum(size)
        row = 0
        parts: list[list[bytes]] = [[] for _ in size]
        for low in range(0, len(place), GATHERED):  # a long text is put together piece by piece
            mine = place[low:low + GATHERED]
            n = length[mine]
            upto = np.cumsum(n)
            held = _gathered(ids, first[mine], n)
            begin = 0
            while begin < len(mine):
                while ends[row] <= low + begin:
                    row += 1
                stop = min(int(ends[row]) - low, len(mine))
                parts[row].append(held[upto[begin - 1] if begin else 0:upto[stop - 1]].tobytes())
                begin = stop
        cut = iter(parts)
        return [self.library_ids([text])[0] if w else b"".join(next(cut)) for text, w in zip(texts, whole)]


def _gathered(ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of ids end to end."""
    upto = np.cumsum(length)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    return ids[np.repeat((first - upto + length).astype(kind), length) + np.arange(total, dtype=kind)]


def encoder(path: str, joined: bool) -> Encoder:
    """The worker's encoder of this file."""
    if (path, joined) not in _open:
        _open[path, joined] = Encoder(path, joined)
    return _open[path, joined]
