"""Plain versions of the operators for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import Row
from tokenizers import Tokenizer

SPACED = re.compile("[^\x20\x09-\x0D]+")
LETTERS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def repeats(units, key, size):
    """Per document (sorted by key): which units lie in a window that also starts earlier."""
    seen, out = set(), []
    for k in sorted(range(len(units)), key=lambda i: key[i]):
        u, hit = units[k], np.zeros(len(units[k]), bool)
        for i in range(len(u) - size + 1):
            w = u[i:i + size] if isinstance(u, bytes) else tuple(u[i:i + size])
            if w in seen:
                hit[i:i + size] = True
            seen.add(w)
        out.append((k, hit))
    return [hit for _, hit in sorted(out, key=lambda x: x[0])]


def runs(hit):
    return int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())


def op1(rows):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, hit in zip(rows, texts, repeats(texts, [r[0] for r in rows], 100)):
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out.append((i, len(b), int(hit.sum()), runs(hit), sha(kept)))
    return sorted(out)


def op2(paragraph, templates):
    """Templates whose telling words are in the paragraph and four fifths of whose words are, in order."""
    word = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
    have, out = word.findall(paragraph.lower()), set()
    for name, (text, key) in templates.items():
        want = word.findall(text.lower())
        best = [0] * (len(want) + 1)  # longest common subsequence
        for x in have:
            old = best[:]
            for k, w in enumerate(want):
                best[k + 1] = old[k] + 1 if w == x else max(old[k + 1], best[k])
        if set(key.split()) <= set(have) and best[-1] >= 0.8 * len(want) - 1e-9:
            out.add(name)
    return out


def op3(rows, least):
    """Cleaned texts, where rows of one text count with the smallest of their sites."""
    smallest, sites = {}, defaultdict(set)
    for r in rows:
        if r.text is not None and r.source is not None:
            smallest[r.text] = min(r.source, smallest.get(r.text, r.source))
    for text, site in smallest.items():
        for line in text.split("\n"):
            sites[line.strip(" \t\n\x0b\x0c\r")].add(site)
    gone = {line for line, found in sites.items() if line and len(found) >= least}
    return [Row(doc_id=r.doc_id, text=None if r.text is None else "\n".join(
        x for x in r.text.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in gone)) for r in rows]


def op9(rows):
    texts = [SPACED.findall(t or "") for _, t in rows]
    out = []
    for (i, _), w, hit in zip(rows, texts, repeats(texts, [r[0] for r in rows], 20)):
        out.append((i, len(w), int(hit.sum()), sha(" ".join(x for x, h in zip(w, hit) if not h).encode())))
    return sorted(out)


def fingerprint(text):
    words = SPACED.findall(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op4(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return sorted((rows[i][0], f"{fps[i]:016x}", min(least[find(i)])) for i in range(len(rows)))


def op5(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = LETTERS.findall(lower(text))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i:i + 10])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        words, hit, found = LETTERS.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                w = tuple(words[i:i + n])
                if w in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), sha(names.encode()), bool(hit)))
    return sorted(out)


def op7(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)
    return sorted((i, len((x or "").encode()), len(e.ids), len(e.ids) > 2048) for (i, x), e in zip(rows, found))


def op8_ids(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = t.encode_batch([x or "" for _, x in rows], add_special_tokens=False)
    return {i: np.array(e.ids + [2], dtype="<u4") for (i, _), e in zip(rows, found)}


def check_packing(rows, packed):
    """The pieces make up the documents, the sequences are gapless and at most 1,024 long."""
    ids = op8_ids(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for k, r in enumerate(pieces):
            assert r["start"] == at and 0 < r["length"] <= 1024 and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(ids[doc][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[doc]) and (at > 1024 or len(pieces) == 1)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence), sorted(r["length"] for r in packed)


def best_fit_decreasing(lengths, capacity=1024):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)
