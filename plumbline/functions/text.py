"""String predicates (as SQL, for use in measures) and keys, written with built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.columns import string

# The accepted formats, by the name fragment of the columns they apply to.
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?\d{9,15}$",
    "zip": r"^\d{5}(-\d{4})?$",
}
# Sound-alike spellings, applied in this order.
SOUND_ALIKES = (("PH", "F"), ("GH", "F"), ("CK", "K"), ("C", "K"), ("Z", "S"))
PHONETIC_LENGTH = 6
BLOCK_PREFIX = 3

_BLANK = r"(?U)^\s*$"
_NOT_TITLE = (
    r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}"
    r"|[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]"
)


def is_blank(value: str) -> str:
    """Empty or white space only, in the Unicode sense; null stays null."""
    return f"{value} RLIKE {string(_BLANK)}"


def breaks_format(value: str, kind: str) -> str:
    return f"NOT {value} RLIKE {string(FORMATS[kind])}"


def is_mixed_case(value: str) -> str:
    """Neither all lower, nor all upper, nor title case."""
    return f"({value} <> lower({value}) AND {value} <> upper({value}) AND {value} RLIKE {string(_NOT_TITLE)})"


def text_of(value: Column) -> Column:
    """The text a value is matched by; missing values read as empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def block_key(values: list[Column]) -> Column:
    """Lower-cased leading characters of the non-empty values, joined with ``_``."""
    return F.concat_ws(
        "_", *[F.nullif(F.substring(F.lower(text_of(v)), 1, BLOCK_PREFIX), F.lit("")) for v in values]
    )


def phonetic_code(value: Column) -> Column:
    """Consonant skeleton of a text: vowels after the first letter dropped, sound-alike spellings
    unified, runs collapsed, cut to a fixed length."""
    upper = F.upper(value)
    tail = F.substring(upper, F.lit(2), F.length(upper))
    skeleton = F.concat(F.substring(upper, 1, 1), F.regexp_replace(tail, "[AEIOU]", ""))
    unified = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), SOUND_ALIKES, skeleton)
    return F.substring(F.regexp_replace(unified, r"(?s)(.)\1+", "$1"), 1, PHONETIC_LENGTH)


def phonetic_key(values: list[Column]) -> Column:
    """Codes of the non-empty values joined with ``_``; null when every value is empty."""
    texts = [F.nullif(text_of(v), F.lit("")) for v in values]
    joined = F.concat_ws("_", *[phonetic_code(t) for t in texts])
    return F.when(F.coalesce(*texts).isNotNull(), joined)


def sorted_tokens(value: Column) -> Column:
    """Lower-cased words in code point order; Latin-1 letters beyond ASCII are dropped first."""
    ascii_only = F.regexp_replace(value, "[\u0080-ÿ]", "")
    words = F.split(F.trim(F.lower(F.regexp_replace(ascii_only, r"[^\p{L}\p{N}_]", " "))), " +")
    return F.array_join(F.array_sort(words), " ")
