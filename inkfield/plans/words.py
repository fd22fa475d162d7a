"""The scalar functions once more for one Python string: what a document's sequential steps call."""

from __future__ import annotations

import datetime as dt
from functools import cache, lru_cache
from typing import NamedTuple

import regex

from inkfield.catalogue import LOOKALIKES, SEPARATORS
from inkfield.functions.text import fold_table
from inkfield.operators.labels import catalogue

OTHER = regex.compile(r"[^\p{L}\p{Nd}]+")
LETTER = regex.compile(r"[\p{L}\p{Nd}]")
LONG = regex.compile(r"([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4})")
SHORT = regex.compile(r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{2})")
FRONT, BACK = ":-.,;=–", ":,;-=–"
NO_SEPARATORS = str.maketrans("", "", SEPARATORS)
READ_AS = {ord(c): d for d, letters in LOOKALIKES.items() for c in letters}


@cache
def folding() -> dict:
    return str.maketrans(*fold_table())


def normalize(text: str) -> str:
    return OTHER.sub(" ", text.translate(folding())).strip()


def compact(text: str) -> str:
    return normalize(text).replace(" ", "")


def clean(text: str) -> str:
    return " ".join(text.split()).lstrip(FRONT).rstrip(BACK).strip()


def usable(text: str) -> bool:
    return len(text.strip()) >= 2


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def all_digits(text: str) -> bool:
    found = digits(text)
    return bool(found) and len(found) == len(compact(text))


def run_of(text: str, length: int, substitute: bool = False) -> tuple[str, bool] | None:
    """The only digit run of a length, and whether letters had to be read as digits."""
    bare = text.translate(NO_SEPARATORS)
    for changed in (False, True)[: 1 + substitute]:
        runs = [r for r in regex.findall("[0-9]+", bare.translate(READ_AS) if changed else bare) if len(r) == length]
        if len(runs) == 1:
            return runs[0], changed
    return None


def date_of(text: str, today: dt.date, two_digit_year_max: int) -> str | None:
    bare, tried = text.strip(), []
    if m := LONG.fullmatch(bare):
        tried.append((m[4], m[3], m[1]))
    elif m := SHORT.fullmatch(bare):
        century, last = divmod(two_digit_year_max, 100)
        tried.append((100 * (century if int(m[3]) <= last else century - 1) + int(m[3]), m[2], m[1]))
    if len(d := digits(bare)) == 8:
        tried.append((d[4:], d[2:4], d[:2]))
    for parts in tried:
        try:
            date = dt.date(*map(int, parts))
        except ValueError:
            continue
        if date.year >= 1900 and date <= year_after(today):
            return date.isoformat()
    return None


def year_after(day: dt.date) -> dt.date:
    try:
        return day.replace(year=day.year + 1)
    except ValueError:
        return day.replace(year=day.year + 1, day=28)


def code_of(text: str) -> tuple[str, str | None] | None:
    """Code and description of a cell; or the four to six digits of it."""
    at = next((i for i, c in enumerate(text) if c in "-–—"), 0)
    head, tail = text[:at].strip(), text[at + 1 :].strip()
    if 0 < at < len(text) - 1 and regex.fullmatch("[0-9 ]+", head) and 4 <= len(digits(head)) <= 6:
        return digits(head), tail if len(tail) >= 3 else None
    return (digits(text), None) if 4 <= len(digits(text)) <= 6 else None


def tax_number_valid(text: str) -> bool:
    total = 0
    for place, c in enumerate(text[:9], 1):
        shifted = (int(c) + 10 - place) % 10
        total += (shifted * 2 ** (10 - place) % 9 or 9) if shifted else 0
    return len(text) == 10 and text != "0" * 10 and (10 - total % 10) % 10 == int(text[9])


def person_number_valid(text: str) -> bool:
    if len(text) != 11 or text[0] == "0":
        return False
    d = [int(c) for c in text]
    tenth = (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10
    return (d[9], d[10]) == (tenth, (sum(d[:9]) + tenth) % 10)


class Label(NamedTuple):
    field: str
    alias: str
    similarity: float
    inline: str | None


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is more; only the cells near the diagonal are filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        below: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most) + 1
            if j:
                best = min(best, below.get(j - 1, most) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
            below[j] = best
        row = below
    return min(row.get(len(b), most + 1), most + 1)


def letters_of(words: str) -> int:
    """A bit for each different character, characters shared out over 64 bits."""
    found = 0
    for c in set(words):
        found |= 1 << (ord(c) & 63)
    return found


class Alias(NamedTuple):
    field: str
    words: str
    start: str
    compact: str
    size: int
    least: float
    edits: int
    shortest: float
    longest: float
    letters: int


@cache
def aliases() -> tuple[list[Alias], dict[str, list[Alias]], list[Alias]]:
    """All aliases, longest first; those by the first letters of their compact form; those that edits are allowed in."""
    every = [Alias(a["field"], a["alias"], a["alias"] + " ", a["compact"], a["size"], a["least"], a["edits"], a["size"] - a["slack"], a["size"] + a["slack"], letters_of(a["alias"])) for a in catalogue()]
    heads: dict[str, list[Alias]] = {}
    for a in every:
        heads.setdefault(a.compact[:2], []).append(a)
    return every, heads, [a for a in every if a.least < 1]


@lru_cache(maxsize=20_000)
def label_of(text: str) -> Label | None:
    """The best alias of the catalogue for a text: the most alike, of equally alike ones the longest."""
    words = normalize(text)
    if not words:
        return None
    joined = words.replace(" ", "")
    _, heads, loose = aliases()
    alike, best = 0.0, None
    for a in heads.get(joined[:2], ()):
        if joined.startswith(a.compact):
            how = 1.0 if words == a.words or words.startswith(a.start) else 0.99 if joined == a.compact else 0.98
            if how > alike + 1e-9:
                alike, best = how, a
    if alike < 0.98 - 1e-9:  # edits never bring so much again
        size, letters = len(words), letters_of(words)
        for a in loose:
            if a.shortest <= size <= a.longest and (a.letters & ~letters).bit_count() <= a.edits >= (letters & ~a.letters).bit_count() and (d := distance(words, a.words, a.edits)) <= a.edits:
                how = 1.0 - d / max(size, a.size)
                if how >= a.least and how > alike + 1e-9:
                    alike, best = how, a
    if best is None:
        return None
    starts = joined != best.compact and alike >= 0.98 and joined.startswith(best.compact)
    return Label(best.field, best.words, alike, after_letters(text, len(best.compact)) or None if starts else None)


def after_letters(text: str, count: int) -> str:
    """What follows so many letters and digits, cleaned."""
    return clean(text[ends[count - 1] :]) if len(ends := letter_ends(text)) >= count else ""


def letter_ends(text: str) -> list[int]:
    return [m.end() for m in LETTER.finditer(text)]


def without_ending(text: str, endings: tuple[str, ...]) -> str:
    """A name without the first of the endings that it has."""
    words = normalize(text)
    for ending in endings:
        if words.endswith(" " + ending):
            keep = len(words[: -len(ending)].replace(" ", ""))
            return clean(text[: letter_ends(text)[keep - 1]]) if keep else ""
    return clean(text)
