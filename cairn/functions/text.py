"""Text expressions. All are JVM-side columns; none needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, and what a pre-token is: one punctuation or symbol character, or a run of anything else.
WS = r"[\t-\r \x{85}\p{Z}]"
PRE = r"[\p{P}\p{S}]|[^\t-\r \x{85}\p{Z}\p{P}\p{S}]+"
SENTENCE_EDGE = rf"(?<=[.!?])(?={WS}|\p{{Lu}})|(?<=\n)(?=\n)"
OUTER_WS = rf"\A{WS}+|{WS}+\z"
LETTERS = r"[\p{L}\p{Nd}]+"


def lower_runes(c: Column) -> Column:
    """Lower case character by character: no final-sigma rule, and dotted capital I becomes a plain i."""
    return F.lower(F.translate(c, "Σİ", "σi"))


def pre_tokens(text: Column) -> Column:
    """Array of pre-tokens: symbols as they are, words in lower case. A null text gives null."""
    # circled capitals are the only symbols with a lower case; texts without them are lowered as a whole
    found = F.regexp_extract_all(text, F.lit(PRE), F.lit(0))
    each = F.transform(found, lambda t: F.when(t.rlike(r"^[\p{P}\p{S}]"), t).otherwise(lower_runes(t)))
    return F.when(text.rlike("[Ⓐ-Ⓩ]"), each).otherwise(F.regexp_extract_all(lower_runes(text), F.lit(PRE), F.lit(0)))


def symbols(word: Column) -> Column:
    """The characters of a word."""
    return F.filter(F.split(word, ""), lambda c: c != "")


def strip(c: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(c, OUTER_WS, "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"[^\t-\r \x{85}\p{Z}]")


def sentences(text: Column, min_bytes: int = 15) -> Column:
    """Array of sentences of more than ``min_bytes`` bytes: cut after . ! ? before white space or a capital, and between
    two line ends."""
    parts = F.transform(F.split(text, SENTENCE_EDGE), strip)
    return F.filter(parts, lambda s: F.octet_length(s) > min_bytes)


def bag_words(sentence: Column, min_bytes: int = 2) -> Column:
    """Words of a sentence for its bag of words: letter and digit runs of more than ``min_bytes`` bytes, lower case."""
    return F.filter(F.regexp_extract_all(lower_runes(sentence), F.lit(LETTERS), F.lit(0)), lambda w: F.octet_length(w) > min_bytes)


def shorten(text: Column, chars: int = 500) -> Column:
    """The first ``chars`` characters and an ellipsis; never cuts a character."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)


def word_wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` bytes, filled greedily with whole words; a longer word has its own line."""
    words = F.filter(F.split(text, rf"{WS}+"), lambda w: w != "")

    def add(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.octet_length(last) + 1 + F.octet_length(w) <= width
        longer = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", last, w)))
        return F.when(F.size(lines) == 0, F.array(w)).when(F.coalesce(fits, F.lit(False)), longer).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), add)


def title_of(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    """Last extension with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
