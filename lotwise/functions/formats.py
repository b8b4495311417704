"""Display texts of amounts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lotwise.functions.text import col

DASH = "—"


def _fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.round(c, places))


def indian_digits(c: Column) -> Column:
    """Digits of a whole number in groups of three, then two: 12,34,567."""
    s = F.regexp_replace(c.cast("decimal(38,0)").cast("string"), "^-", "")
    head, tail = F.substr(s, F.lit(1), F.greatest(F.length(s) - 3, F.lit(0))), F.when(F.length(s) > 3, F.right(s, F.lit(3))).otherwise(s)
    pairs = F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", "$1,"))
    return F.concat(F.when(c < 0, "-").otherwise(""), F.when(F.length(s) > 3, F.concat(pairs, F.lit(","), tail)).otherwise(tail))


def currency(c: Column | str) -> Column:
    """Rupees in crores, lakhs or thousands; below, whole or with two decimals."""
    c = col(c).cast("double")
    a, sign = F.abs(c), F.when(c < 0, "-").otherwise("")
    short = lambda unit, places, end: F.concat(sign, F.lit("₹"), _fixed(a / unit, places), F.lit(end))
    return F.when(c.isNull() | F.isnan(c), DASH).when(a >= 1e7, short(1e7, 2, " Cr")).when(a >= 1e5, short(1e5, 2, " L")).when(a >= 1e3, short(1e3, 1, "K")).when(a % 1 != 0, F.concat(sign, F.lit("₹"), _fixed(a, 2))).otherwise(F.concat(sign, F.lit("₹"), a.cast("long").cast("string")))


def _whole_or(c: Column, places: int) -> Column:
    return F.when(c % 1 == 0, c.cast("long").cast("string")).otherwise(_fixed(c, places))


def mass(c: Column | str) -> Column:
    """Kilograms as tonnes, kilograms or grams."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c == 0), DASH).when(c >= 1000, F.concat(_whole_or(c / 1000, 2), F.lit(" T"))).when(c >= 1, F.concat(_whole_or(c, 2), F.lit(" KG"))).otherwise(F.concat(_whole_or(c * 1000, 0), F.lit(" g")))


def volume(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c == 0), DASH).when(c >= 1000, F.concat(_fixed(c / 1000, 2), F.lit(" kL"))).otherwise(F.concat(_fixed(c, 2), F.lit(" L")))


def percent(part: Column | str, whole: Column | str) -> Column:
    part, whole = col(part), col(whole)
    return F.when(whole.isNull() | (whole == 0), "0%").otherwise(F.concat(_fixed(100 * part / whole, 1), F.lit("%")))


def number(c: Column | str) -> Column:
    """A number with Indian grouping and up to three decimals."""
    c = col(c).cast("double")
    a = F.round(F.abs(c), 3)
    decimals = F.regexp_replace(F.substring(_fixed(a - F.floor(a), 3), 2, 4), r"\.?0+$", "")
    return F.when(c.isNull() | F.isnan(c), DASH).otherwise(F.concat(F.when(c < 0, "-").otherwise(""), indian_digits(F.floor(a)), decimals))


def short_date(c: Column | str) -> Column:
    """01 Jan 2024."""
    return F.coalesce(F.date_format(col(c), "dd MMM yyyy"), F.lit(DASH))


def date(c: Column | str) -> Column:
    """01 Jan 2024, 05:30 pm."""
    c = col(c)
    return F.coalesce(F.concat(F.date_format(c, "dd MMM yyyy, "), F.lower(F.date_format(c, "hh:mm a"))), F.lit(DASH))
