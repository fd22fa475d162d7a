"""Digits, dates, codes and check digits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfield.catalogue import LOOKALIKES, SEPARATORS
from inkfield.functions.text import compact


def digits_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def all_digits(text: Column) -> Column:
    """Whether what remains of the text after folding is digits, at least one."""
    digits = digits_only(text)
    return (F.length(digits) > 0) & (F.length(digits) == F.length(compact(text)))


def substitute(text: Column) -> Column:
    """Letters that are read in place of digits become these digits."""
    return F.translate(text, "".join(LOOKALIKES.values()), "".join(d * len(s) for d, s in LOOKALIKES.items()))


def single_run(text: Column, length: int) -> Column:
    """The only run of exactly so many digits, separators left out; null if there is none or several."""
    runs = F.regexp_extract_all(F.translate(text, SEPARATORS, ""), F.lit(f"(?<![0-9])([0-9]{{{length}}})(?![0-9])"), F.lit(1))
    return F.when(F.size(runs) == 1, F.get(runs, F.lit(0)))


def fixed_length(text: Column, length: int, allow_substitution: bool = False) -> Column:
    """struct<digits, substituted>: the run, and whether letters had to be read as digits."""
    plain = single_run(text, length)
    if not allow_substitution:
        return F.struct(plain.alias("digits"), F.lit(False).alias("substituted"))
    second = single_run(substitute(text), length)
    return F.struct(F.coalesce(plain, second).alias("digits"), (plain.isNull() & second.isNotNull()).alias("substituted"))


def iso_date(text: Column, today: dt.date, two_digit_year_max: int = 2049) -> Column:
    """Day-month-year in the known spellings, or exactly eight digits anywhere, as yyyy-MM-dd.

    Years from 1900 to a year after today. Two-digit years, with dots only, lie in the hundred years up to two_digit_year_max.
    """
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    long = r"^([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4})$"
    short = r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{2})$"
    two = F.try_to_number(F.regexp_extract(trimmed, short, 3), F.lit("99")).cast("int")
    century = two_digit_year_max // 100 * 100
    year = F.when(two <= two_digit_year_max % 100, century + two).otherwise(century - 100 + two)
    eight = digits_only(trimmed)
    first = F.when(trimmed.rlike(long), assembled(F.regexp_extract(trimmed, long, 4), F.regexp_extract(trimmed, long, 3), F.regexp_extract(trimmed, long, 1)))
    first = F.coalesce(first, F.when(trimmed.rlike(short), assembled(year.cast("string"), F.regexp_extract(trimmed, short, 2), F.regexp_extract(trimmed, short, 1))))
    second = F.when(F.length(eight) == 8, assembled(F.substring(eight, 5, 4), F.substring(eight, 3, 2), F.substring(eight, 1, 2)))
    return F.coalesce(plausible(first, today), plausible(second, today))


def assembled(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def plausible(date: Column, today: dt.date) -> Column:
    latest = F.add_months(F.lit(today), 12)
    return F.when((date >= F.lit(dt.date(1900, 1, 1))) & (date <= latest), F.date_format(date, "yyyy-MM-dd"))


def activity_code(text: Column) -> Column:
    """The digits of the text if there are four to six."""
    digits = digits_only(text)
    return F.when(F.length(digits).between(4, 6), digits)


CELL = r"(?s)^([^-–—]+)[-–—](.+)$"


def split_activity(text: Column) -> Column:
    """struct<code, description> of a cell that holds both, parted by the first dash; nulls if it does not.

    Before the dash stand only digits and spaces; a description of under three characters is null.
    """
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    head, tail = F.regexp_extract(trimmed, CELL, 1), F.regexp_extract(trimmed, CELL, 2)
    code = F.when(head.rlike("^[0-9 ]+$"), activity_code(head))
    said = F.regexp_replace(tail, r"(?U)^\s+|\s+$", "")
    return F.struct(code.alias("code"), F.when(code.isNotNull() & (F.length(said) >= 3), said).alias("description"))


def digit(text: Column, place: int) -> Column:
    return F.substring(text, place, 1).cast("int")


def tax_check_digit(body: Column) -> Column:
    """Tenth digit of a tax number, from its first nine."""
    total = None
    for place in range(1, 10):
        shifted = F.pmod(digit(body, place) + (10 - place), F.lit(10))
        weighed = F.pmod(shifted * (1 << (10 - place)), F.lit(9))
        term = F.when(shifted == 0, 0).otherwise(F.when(weighed == 0, 9).otherwise(weighed))
        total = term if total is None else total + term
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def tax_number_valid(text: Column) -> Column:
    shaped = text.rlike("^[0-9]{10}$") & (text != "0" * 10)
    return F.coalesce(F.when(shaped, tax_check_digit(text) == digit(text, 10)), F.lit(False))


def person_check_digits(body: Column) -> Column:
    """struct<tenth, eleventh> of a personal number, from its first nine digits."""
    odd = sum((digit(body, p) for p in range(3, 10, 2)), digit(body, 1))
    even = sum((digit(body, p) for p in range(4, 9, 2)), digit(body, 2))
    tenth = F.pmod(7 * odd - even, F.lit(10))
    return F.struct(tenth.alias("tenth"), F.pmod(odd + even + tenth, F.lit(10)).alias("eleventh"))


def person_number_valid(text: Column) -> Column:
    check = person_check_digits(text)
    good = (check["tenth"] == digit(text, 10)) & (check["eleventh"] == digit(text, 11))
    return F.coalesce(F.when(text.rlike("^[1-9][0-9]{10}$"), good), F.lit(False))
