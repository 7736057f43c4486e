"""Check digits of numbers, as native Column conditions on their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(d, i) * w
    return total


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", digits(value))


def letter_of(table: str, i: Column) -> Column:
    return F.substring(F.lit(table), (i + 1).cast("int"), F.lit(1))


def bsn(value: Column) -> Column:
    """Netherlands: eleven-test over nine digits."""
    return weighted(digits(value), [9, 8, 7, 6, 5, 4, 3, 2, -1]) % 11 == 0


def dni(value: Column) -> Column:
    """Spain: DNI and NIE, a letter by the number modulo 23."""
    v = F.upper(F.regexp_replace(value, "-", ""))
    number = F.concat(F.translate(F.regexp_extract(v, "^([XYZ]?)", 1), "XYZ", "012"), digits(v))
    return (F.length(number) == 8) & (letter_of("TRWAGMYFPDXBNJZSQVHLCKE", number.cast("int") % 23) == F.substring(v, -1, 1))


def nir(value: Column) -> Column:
    """France: 97 minus the number modulo 97; 2A and 2B count as 19 and 18."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(value), " ", ""), "2A", "19"), "2B", "18")
    return F.lit(97) - F.substring(v, 1, 13).cast("bigint") % 97 == F.substring(v, 14, 2).cast("int")


def resident(value: Column) -> Column:
    """China: weights modulo 11."""
    v = F.upper(value)
    return letter_of("10X98765432", weighted(v, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11) == F.substring(v, 18, 1)


def my_number(value: Column) -> Column:
    """Japan: weights modulo 11; remainders 0 and 1 give 0."""
    d = digits(value)
    r = weighted(d, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return F.when(r <= 1, 0).otherwise(11 - r) == digit(d, 11)


def thai(value: Column) -> Column:
    """Thailand: weights 13 to 2 modulo 11."""
    d = digits(value)
    return (11 - weighted(d, list(range(13, 1, -1))) % 11) % 10 == digit(d, 12)
