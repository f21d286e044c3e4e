"""Functions over word arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.text import ALL_PUNCTUATION, SPACE

FIRST_CODE = 0x10000  # word codes live above the basic plane: a million fit


def words(text: Column) -> Column:
    """Words of text whose only white space is single spaces; no words in empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ", -1))


def tokens(text: Column) -> Column:
    """Words of arbitrary text, split on any white space."""
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Word count of single-spaced text without building the array."""
    gaps = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(gaps + 1).cast("bigint")


def join_words(ws: Column) -> Column:
    return F.array_join(ws, " ")


def punct_labels(text: Column) -> Column:
    """Tokens as (word, label): bare word and 1 for a final `.`, 2 for a final `,`, else 0."""
    labelled = F.transform(
        tokens(text),
        lambda t: F.struct(
            F.translate(t, ALL_PUNCTUATION, "").alias("word"),
            F.when(F.endswith(t, F.lit(".")), 1).when(F.endswith(t, F.lit(",")), 2).otherwise(0).alias("label"),
        ),
    )
    return F.filter(labelled, lambda s: s["word"] != "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, also where the body is a lambda over elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(ws: Column, n: int, sentinels: bool = True) -> Column:
    """All n-word windows, each joined by spaces, of `<s>` + words + `</s>`."""
    padded = F.concat(F.array(F.lit("<s>")), ws, F.array(F.lit("</s>"))) if sentinels else ws
    if n == 1:
        return padded
    return let(
        padded,
        lambda p: F.when(
            F.size(p) >= n,
            F.transform(F.sequence(F.lit(1), F.size(p) - (n - 1)), lambda i: F.array_join(F.slice(p, i, n), " ")),
        ).otherwise(F.array().cast("array<string>")),
    )


def word_codes(ws: Column, dictionary: Column) -> Column:
    """Spell a word array as a string with one code point per word of `dictionary`."""
    code = F.transform(
        ws, lambda w: F.lpad(F.hex(F.array_position(dictionary, w) + F.lit(FIRST_CODE)), 8, "0")
    )
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")


def word_code_pair(ref: Column, hyp: Column) -> Column:
    """Two word arrays as a struct `(r, h)` of strings with one code point per word.

    The character distance of the two strings is the word distance of the arrays.
    """
    return let(
        F.array_distinct(F.concat(ref, hyp)),
        lambda d: F.struct(word_codes(ref, d).alias("r"), word_codes(hyp, d).alias("h")),
    )
