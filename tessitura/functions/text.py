"""Scalar text functions.

Patterns stay within what Java regular expressions and RE2 read alike. The one
step without a Spark built-in, Unicode composition, is an Arrow UDF that is
handed NULL for every text that cannot change under it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Fixed values.
APOSTROPHES = "’ʼ‘´`"
KEPT_PUNCTUATION = ".,'’;:!?-"
ALL_PUNCTUATION = "!\"&'(),-./:;?«»“”"
BLANK_FILL = "a"
# Unicode white space as Python's str.isspace sees it.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Holds before what may be white space; most characters of a text fail it by one comparison.
BLANK_NEXT = "(?=[^!-~])"
# Runs to be replaced by one space. A lone plain space already is one and is left
# alone: text is mostly single-spaced, and every match costs. `a-z` only shortens the
# common test.
NOT_KEPT = r"[^a-z\p{L}" + KEPT_PUNCTUATION + r"]{2,}|[^a-z\p{L} " + KEPT_PUNCTUATION + "]"
WIDE = BLANK_NEXT + "(?:" + SPACE + "{2,}|(?! )" + SPACE + ")"
SENTENCE_BREAK = r"(?<=[.!?])" + SPACE + r"+|\n"


def _singletons() -> str:
    """Ranges of characters, marks aside, that composition replaces wherever they stand."""
    ranges: list[list[int]] = []
    for code in range(0x340, 0x30000):
        char = chr(code)
        if unicodedata.decomposition(char) and unicodedata.normalize("NFC", char) != char:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges)


# What composition may change: marks, the vowels and finals of conjoining jamo, and the singletons. None lies below
# U+0300, and saying so first settles most characters by one comparison.
MAY_COMPOSE = r"[\x{300}-\x{10FFFF}&&[\p{M}\x{1161}-\x{1175}\x{11A8}-\x{11C2}" + _singletons() + "]]"


@arrow_udf(StringType())
def _compose(texts: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves NFC decomposed in the installed release.
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def compose(text: Column) -> Column:
    """Unicode NFC; the text itself reaches Python only where it may change."""
    return F.coalesce(_compose(F.when(text.rlike(MAY_COMPOSE), text)), text)


def squeeze(text: Column) -> Column:
    """Collapse every run of white space to one space and trim."""
    return F.trim(F.regexp_replace(text, WIDE, " "))


def _keep_letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, NOT_KEPT, " "))


def normalise_composed(text: Column) -> Column:
    """`normalise` for text that is already NFC: no Python in the plan."""
    folded = F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))
    return _keep_letters(F.lower(folded))


def normalise(text: Column) -> Column:
    """The corpus form: composed, apostrophes folded, lower case, letters and `.,'’;:!?-` only."""
    return normalise_composed(compose(text))


def normalise_cased(text: Column, lowercase: bool = True) -> Column:
    """The training form: no apostrophe fold, case kept on request."""
    composed = compose(text)
    return _keep_letters(F.lower(composed) if lowercase else composed)


def scorer_normalise(text: Column, case_sensitive: bool = False) -> Column:
    """What the metric does to both sides: lower case and nothing else."""
    return text if case_sensitive else F.lower(text)


def fold_rare(text: Column, allowed: Iterable[str]) -> Column:
    """Replace each character outside `allowed` by its unaccented base, else by a space.

    The replacement table follows from the Unicode decompositions whose base is
    allowed, so it depends on `allowed` alone and never on the data's size.
    """
    keep = {c for c in allowed if not c.isspace()}
    single, several = {}, {}
    for code in range(0xA0, 0x110000):
        char = chr(code)
        if char in keep or not unicodedata.decomposition(char):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if base and base != char and all(c in keep for c in base):
            (single if len(base) == 1 else several)[char] = base
    folded = F.translate(text, "".join(single), "".join(single.values()))
    for char, base in several.items():
        folded = F.replace(folded, F.lit(char), F.lit(base))
    known = "".join(sorted(rf"\x{{{ord(c):x}}}" for c in keep))
    return F.trim(F.regexp_replace(folded, f"[^{known}]+" if known else ".+", " "))


def charset_ratio(line: Column, allowed: Column) -> Column:
    """Share of code points outside `allowed` (a string column of the permitted characters)."""
    return F.when(F.length(line) == 0, F.lit(0.0)).otherwise(
        F.length(F.call_function("translate", line, allowed, F.lit(""))) / F.length(line)
    )


def acceptable(line: Column, allowed: Column, max_bad: float = 0.02, min_length: int = 8) -> Column:
    """Long enough, more than one word, and hardly any character outside the charset."""
    return (
        (F.length(line) >= min_length)
        & F.contains(line, F.lit(" "))
        & (charset_ratio(line, allowed) <= F.lit(max_bad))
    )


def lang_from_id(utt_id: Column, langs: Iterable[str]) -> Column:
    """Language prefix of an id such as `fr_96114_3`; NULL outside the permitted set."""
    prefix = F.lower(F.trim(F.substring_index(utt_id, "_", 1)))
    return F.when(prefix.isin(*langs), prefix)


def lang3(lang: Column) -> Column:
    """First three letters of a language column, lower case."""
    return F.substring(F.lower(F.trim(lang)), 1, 3)


def strip_punct(text: Column) -> Column:
    """Drop every listed punctuation mark and collapse white space."""
    return squeeze(F.translate(text, ALL_PUNCTUATION, ""))


def strip_marks(text: Column) -> Column:
    """Drop only the two restorable marks, so apostrophes inside words survive."""
    return squeeze(F.translate(text, ".,", ""))


def append_period(text: Column, rule: str = "guarded") -> Column:
    """Three distinct rules: `always`, `nonblank`, and `guarded` (skips text already closed)."""
    if rule == "always":
        wanted = F.lit(True)
    elif rule == "nonblank":
        wanted = F.trim(text) != ""
    elif rule == "guarded":
        wanted = (text != "") & ~text.rlike(r"[.?!]$")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.when(wanted, F.concat(text, F.lit("."))).otherwise(text)


def finish(text: Column, lang: Column, plus_period: Iterable[str]) -> Column:
    """The last step before a hypothesis is written: normalise, then close where the language asks."""
    clean = normalise(text)
    return F.when(lang.isin(*plus_period), append_period(clean, "guarded")).otherwise(clean)


def capfirst(text: Column) -> Column:
    """Upper-case an a-z letter that opens the text or follows `.?!` and white space."""
    cut = "\ufdd0"  # a noncharacter: never part of interchanged text
    pieces = F.split(F.regexp_replace(text, r"(^\s*|[.?!]\s+)(?=[a-z])", "$1" + cut), cut, -1)
    return F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))
            ),
        ),
        "",
    )


def is_blank(text: Column) -> Column:
    return text.isNull() | (squeeze(text) == "")


def fill_blank(text: Column, fill: str = BLANK_FILL) -> Column:
    """Replace NULL or blank text, which a CSV reader would take for missing."""
    return F.when(is_blank(text), F.lit(fill)).otherwise(text)
