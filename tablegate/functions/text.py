"""Text similarity and name tokens, JVM-side."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_BITS = 62


def tokens(name: Column) -> Column:
    return F.split(name, "_")


def squash(name: Column) -> Column:
    """Lower-cased name without underscores."""
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def chars(text: Column) -> Column:
    return F.split(text, "")


def word_masks(word: str) -> dict[str, int]:
    """Bit positions of every character of a word, as used by ``lcs_by_masks``; none for
    a word of more characters than a mask holds, which is compared by rows."""
    masks: dict[str, int] = {}
    if len(word) > MASK_BITS:
        return masks
    for position, char in enumerate(word):
        masks[char] = masks.get(char, 0) | (1 << position)
    return masks


def literal_rows(rows: list, ddl: str) -> Column:
    """Constant rows as one foldable expression: the optimizer turns the parsed JSON
    into a single literal, whatever the number of rules."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), ddl)


def mask_column(word: Column) -> Column:
    """The same masks for a word held in a column (at most 62 characters)."""
    bit = lambda position: F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), position - 1)

    def mask(char):
        return F.aggregate(
            F.sequence(F.lit(1), F.length(word)),
            F.lit(0).cast("bigint"),
            lambda bits, i: bits.bitwiseOR(
                F.when(F.substring(word, i, F.lit(1)) == char, bit(i))
                .otherwise(F.lit(0).cast("bigint"))))

    return F.map_from_entries(
        F.transform(F.array_distinct(chars(word)), lambda c: F.struct(c, mask(c))))


def lcs_by_masks(text: Column, masks: Column, size: Column) -> Column:
    """Longest common subsequence of ``text`` and a word given by its masks.

    Bit-parallel: the state holds one bit per character of the word, so every
    character of the text costs a handful of integer operations.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), size) - F.lit(1).cast("bigint")

    def step(bits, char):
        hit = bits.bitwiseAND(F.coalesce(masks[char], F.lit(0).cast("bigint")))
        return (bits + hit).bitwiseOR(bits - hit).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(chars(text), full, step)).cast("int")


def lcs_by_rows(a: Column, b: Column) -> Column:
    """The same length by rows of the edit table, for words beyond 62 characters."""
    other = chars(b)

    def next_row(row, char):
        # Walk the other word once, carrying (row built so far, its last value).
        def cell(acc, j):
            value = F.when(F.element_at(other, j) == char, F.element_at(row, j) + 1).otherwise(
                F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.length(b) + 1)
    return F.element_at(F.aggregate(chars(a), start, next_row), -1)


def similarity(common: Column, total: Column) -> Column:
    """Integer percentage from a common-subsequence length and both lengths' sum."""
    distance = total - common * 2
    return F.when(total == 0, F.lit(100)).otherwise(
        F.bround((F.lit(1.0) - distance / F.nullif(total, F.lit(0))) * 100, 0).cast("int"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to an array-valued ``body``.

    An expression used inside a lambda is evaluated anew for every element; a lambda
    variable is not.
    """
    return F.flatten(F.transform(F.array(value), body))


def in_pieces(text: Column) -> Column:
    """The same text.  A projection that holds a lambda is compiled in small methods; many expressions side by side are
    else one method, too long for the JVM to compile.  The lambda is never evaluated, as no text is shorter than none."""
    return F.when(F.length(text) < 0, F.get(F.transform(F.array(text), lambda held: held), F.lit(0))).otherwise(text)


def char_bits(word: str) -> int:
    """One bit per distinct character (modulo 62), as ``char_set`` computes it."""
    bits = 0
    for char in word:
        bits |= 1 << (ord(char) % MASK_BITS)
    return bits


def rule_word(word: str) -> dict:
    """A rule word with what comparing it needs, as a row of ``RULE_WORD_TYPE``."""
    bits = char_bits(word)
    return {"word": word, "size": len(word), "bits": bits, "spare": len(word) - bits.bit_count(),
            "masks": word_masks(word)}


RULE_WORD_TYPE = "word:string,size:int,bits:bigint,spare:int,masks:map<string,bigint>"


def measured(text: Column) -> Column:
    """``struct<text, size, bits>`` of a text, computed once per text."""
    bit = lambda c: F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % MASK_BITS)
    bits = F.aggregate(chars(text), F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseOR(
        F.when(c == "", F.lit(0).cast("bigint")).otherwise(bit(c))))
    return F.struct(text.alias("text"), F.length(text).alias("size"), bits.alias("bits"))


def may_share(text: Column, rule: Column, above: int) -> Column:
    """Necessary condition for a similarity above a percentage, from lengths and
    character sets: the common subsequence holds no more characters than the text
    has, nor more than the rule's characters that occur in the text at all."""
    total = text["size"] + rule["size"]
    shared = F.bit_count(text["bits"].bitwiseAND(rule["bits"])).cast("int") + rule["spare"]
    return (text["size"] * 200 >= total * above) & (shared * 200 >= total * above)


def near(text: Column, word: Column, size: Column, above: int) -> Column:
    """Necessary condition for a similarity above a percentage.

    The similarity counts insertions and deletions; the plain edit distance can
    only be smaller, so bounding it (banded, in native code) loses no match.
    """
    bound = ((text["size"] + size) * F.lit((100 - above) / 100)).cast("int")
    return F.call_function("levenshtein", text["text"], word, bound) >= 0


def ratio_to_word(text: Column, rule: Column, word: str = "word", masks: str = "masks") -> Column:
    """Similarity in percent of a measured text and a rule's word."""
    size = F.length(rule[word])
    common = F.when(size <= MASK_BITS, lcs_by_masks(text["text"], rule[masks], size)).otherwise(
        lcs_by_rows(text["text"], rule[word]))
    return similarity(common, text["size"] + rule["size"])


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Similarity of two text columns: 100 * 2 * LCS / (len(a) + len(b)), rounded
    half to even; two empty texts are equal."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    # Both texts and the masks are bound, so that they are worked out once and not for every character.
    by_masks = F.get(let(F.struct(shorter.alias("s"), longer.alias("l")), lambda p: let(
        F.struct(p["l"].alias("l"), F.length(p["s"]).alias("size"), mask_column(p["s"]).alias("masks")),
        lambda q: F.array(lcs_by_masks(q["l"], q["masks"], q["size"])))), F.lit(0))
    common = (
        F.when(F.length(shorter) == 0, F.lit(0))
        .when(F.length(shorter) <= MASK_BITS, by_masks)
        .otherwise(lcs_by_rows(longer, shorter))
    )
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100)).otherwise(similarity(common, total))
