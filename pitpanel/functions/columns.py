"""Column expressions for cleaning text and arithmetic over nullable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING = ("", "-", "--", "NA", "N/A", "nan", "None")


def clean_number(col: Column) -> Column:
    """Text like '1,234.5', '12 %' or '₹ 7' as a number; missing marks and bad text give null."""
    bare = F.trim(F.regexp_replace(F.trim(col), "[,%₹]", ""))
    return F.when(~bare.isin(*MISSING), bare.try_cast("double"))


def clean_date(col: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy", "dd MMM yyyy")) -> Column:
    """The first format that reads the text; anything else gives null."""
    return F.coalesce(*[F.try_to_date(F.trim(col), f) for f in formats])


def period_end(col: Column) -> Column:
    """'Mar 2024' or 'Dec-2023' as the last day of the month; other labels such as 'TTM' give null."""
    return F.last_day(F.try_to_date(F.regexp_replace(F.trim(col), r"[\s-]+", " "), "MMM yyyy"))


def canon_symbol(col: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(col), r"(?i)\.NS$", ""))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign."""
    return F.try_mod(F.try_mod(a, b) + b, b)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def finite(col: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~(F.isnan(col) | (F.abs(col) == float("inf"))), col)


def positive(col: Column) -> Column:
    return F.when(col > 0, col)
