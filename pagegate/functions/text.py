"""Column functions over plain text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a JavaScript `\s` matches, as one character class.
WS = "[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NON_WS = "[^" + WS[1:]
# The same characters for Java's patterns: Latin letters are told apart by one table, not by every range in turn.
SPACE = "[\t\n\x0b\x0c\r \u00a0[[\u1680-\u3000\ufeff]&&" + WS + "]]"


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_ws(c: Column) -> Column:
    """Whitespace runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, which is what title and description limits count."""
    return (F.length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def word_list(c: Column) -> Column:
    """Words of an already collapsed text; empty text gives an empty array."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def holds_any(lower: Column, signs) -> Column:
    """Whether a text in lower case holds any of the signs: bytes are compared, so it costs far less than a pattern."""
    out = F.lit(False)
    for s in signs:
        out = out | lower.contains(s)
    return out


def word_count(c: Column) -> Column:
    """Latin word count with inner apostrophes and hyphens."""
    return F.regexp_count(c, F.lit("[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*"))


def syllables(prose: Column) -> Column:
    """Syllable estimate of collapsed prose, counted over the whole text at once.

    A word of one to three letters counts one. A longer word loses a silent ending and a leading y,
    then counts its vowel groups of at most two letters, and at least one. Summed over a text that is
    its words, plus all vowel groups of longer words, less the longer words that have any.
    """
    letters = F.regexp_replace(F.lower(prose), "[^a-z ]", "")

    def count(text: Column) -> Column:
        words = F.regexp_count(text, F.lit("[a-z]+"))
        body = F.regexp_replace(text, r"\b[a-z]{1,3}\b", "")
        body = F.regexp_replace(body, r"(?:[^laeiouy ]es|ed|[^laeiouy ]e)\b", "")
        body = F.regexp_replace(body, r"\by", "")
        voiced = lambda b: F.regexp_count(b, F.lit("[aeiouy]{1,2}")) - F.regexp_count(b, F.lit("[a-z]*[aeiouy][a-z]*"))
        return words + let(body, voiced)

    return let(letters, count)


def flesch_reading_ease(prose: Column) -> Column:
    """Flesch reading ease of collapsed prose; null below 30 words."""
    return let(F.size(word_list(prose)), lambda n: ease_of(prose, n.cast("double")))


def ease_of(prose: Column, n: Column) -> Column:
    """Flesch reading ease of collapsed prose whose words are counted already."""
    sentences = F.greatest(F.regexp_count(prose, F.lit("[.!?]+")), F.lit(1)).cast("double")
    score = F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (syllables(prose) / n)
    return F.when(n >= 30, score)


def reading(prose: Column) -> Column:
    """Struct of the words of collapsed prose, counted by the spaces between them, and its reading ease."""
    spaces = F.length(prose) - F.length(F.replace(prose, F.lit(" "), F.lit("")))
    return let(
        F.when(prose == "", 0).otherwise(spaces + 1),
        lambda n: F.struct(n.alias("words"), ease_of(prose, n.cast("double")).alias("ease")),
    )


def round_half_up(c: Column) -> Column:
    """`Math.round`: halves go toward positive infinity."""
    return F.floor(c + F.lit(0.5))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 50)


def norm_check_name(c: Column) -> Column:
    """Check names compare with digits folded, so counts in a name do not split it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "#"), f"{WS}+", " "))
