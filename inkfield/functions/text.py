"""Text functions: folding, cleaning, distances, masking."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfield.catalogue import FOLDED

DASHES = ":\\-.,;=–"


def fold_letter(letter: str) -> str:
    """A letter without accent in upper case; what is no letter stays."""
    if letter in FOLDED:
        return FOLDED[letter]
    if not unicodedata.category(letter).startswith("L"):
        return letter
    base = next((c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c)), letter)
    upper = FOLDED.get(base) or base.upper()
    return upper if len(upper) == 1 else base


@cache
def fold_table() -> tuple[str, str]:
    """All letters of the basic plane that folding changes, and what they become."""
    changed = [(c, fold_letter(c)) for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Ll", "Lu", "Lt") and fold_letter(c) != c]
    return "".join(c for c, _ in changed), "".join(f for _, f in changed)


def fold(text: Column) -> Column:
    return F.translate(text, *fold_table())


def normalize(text: Column) -> Column:
    """Folded words with single spaces; null and blank give the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{Nd}]+", " ")), F.lit(""))


def compact(text: Column) -> Column:
    return F.replace(normalize(text), F.lit(" "), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_value(text: Column) -> Column:
    """One run of separators goes at each end; a period at the end belongs to the value. Null gives the empty string."""
    left = F.regexp_replace(one_spaced(text), f"^[{DASHES}]+", "")
    return F.coalesce(F.trim(F.regexp_replace(left, f"[{DASHES.replace('.', '')}]+$", "")), F.lit(""))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def is_usable(text: Column) -> Column:
    """At least two characters between white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) >= 2, F.lit(False))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance; over `most` it is most + 1, but an empty string gives the other's length."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    if most is None:
        return F.levenshtein(a, b)
    bounded = F.levenshtein(a, b, most)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.length(a) + F.length(b)).otherwise(F.when(bounded < 0, most + 1).otherwise(bounded))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def mask_number(text: Column) -> Column:
    """All but the last four characters become stars."""
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(4))))


def redact(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("<empty>")).otherwise(F.concat(F.lit("<"), F.length(text).cast("string"), F.lit(" chars>")))


def safe_name(name: Column) -> Column:
    """upload with the name's extension, if that is one to four letters or digits."""
    ending = F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(\.[A-Za-z0-9]{1,4})$", 1))
    return F.concat(F.lit("upload"), F.coalesce(ending, F.lit("")))
