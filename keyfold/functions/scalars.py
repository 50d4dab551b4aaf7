"""Scalar expressions that jobs share; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words between Unicode white space, without empty ones."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def composite_key(*parts: Column | str) -> Column:
    """Key parts joined by '-', as in A-F-count."""
    return F.concat_ws("-", *parts)


def partition_id(key: Column, n: int) -> Column:
    """Low 64 bits of md5(key), unsigned, modulo n."""
    low = F.conv(F.substring(F.md5(key.cast("binary")), 17, 16), 16, 10).cast("decimal(20,0)")
    return (low % F.lit(n).cast("decimal(20,0)")).cast("int")


def salt(n: int, *columns: Column | str) -> Column:
    """A repeatable spread over n values: unlike rand(), a retried task deals alike."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def lenient_int(text: Column) -> Column:
    """An integer; 0 where the text is none."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def normalised_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may overflow: month 0 is December before, day 0 the last of it."""
    start = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, month - 1), day - 1)


def quirk_date(text: Column) -> Column:
    """The date that one-digit month and day parsing gives; for comparisons with old results only."""
    return normalised_date(lenient_int(F.substring(text, 1, 4)), lenient_int(F.substring(text, 7, 1)), lenient_int(F.substring(text, 10, 1)))


def round_half_away(x: Column, places: int = 2) -> Column:
    return F.round(x, places)


def json_number(x: Column) -> Column:
    """A double as plain digits, without exponents or trailing zeros."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain == "-0", "0").otherwise(plain)
