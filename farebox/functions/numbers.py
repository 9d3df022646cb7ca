"""Shares and changes, and the text a number is shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"


def finite(value: Column) -> Column:
    """NaN and infinities are no data."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(finite(part), finite(whole))


def change(current: Column, previous: Column) -> Column:
    """Relative change; nothing when a side is missing or the base is 0."""
    return F.try_divide(finite(current) - finite(previous), finite(previous))


def change_on_size(current: Column, previous: Column) -> Column:
    """Relative to the size of the base: the sign follows the direction even from a negative base."""
    return F.try_divide(finite(current) - finite(previous), F.abs(finite(previous)))


def trimmed(text: Column) -> Column:
    """Without trailing zeros after the point."""
    return F.regexp_replace(text, r"\.?0+$", "")


def plain(value: Column, digits: int) -> Column:
    """Fixed digits, no thousands separators; ties of the exact value go to the even digit."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def percent(ratio: Column) -> Column:
    """Never 0% for a share above nothing, never 100% for a share below the whole."""
    ratio = finite(ratio)
    nines = F.ceil(-F.log10(1 - ratio)).cast("int") - 2  # how many digits keep it below 100
    near = F.coalesce(F.least(F.lit(6), F.greatest(F.lit(2), nines)), F.lit(2))
    floored = F.floor(ratio * F.pow(F.lit(10.0), near + 2.0)) / F.pow(F.lit(10.0), near.cast("double"))
    almost = F.lit(None).cast("string")
    for digits in range(6, 1, -1):
        almost = F.when(near == digits, plain(floored, digits)).otherwise(almost)
    text = F.when(ratio < 0.01, plain(ratio * 100, 3)).otherwise(plain(ratio * 100, 2))
    return (
        F.when(ratio.isNull(), MISSING)
        .when((ratio > 0) & (ratio < 0.0001), "<0.01%")
        .when((ratio >= 0.9999) & (ratio < 1), F.concat(almost, F.lit("%")))
        .otherwise(F.concat(trimmed(text), F.lit("%")))
    )


def signed_change(ratio: Column) -> Column:
    size = F.abs(ratio * 100)
    text = F.concat(F.when(size < 10, plain(size, 1)).otherwise(plain(size, 0)), F.lit("%"))
    return (
        F.when(ratio.isNull(), MISSING)
        .when(ratio > 0, F.concat(F.lit("+"), text))
        .when(ratio < 0, F.concat(F.lit("−"), text))
        .otherwise(text)
    )


def grouped(value: Column, digits: int) -> Column:
    return F.format_number(value, digits)


def bytes_text(value: Column) -> Column:
    """Decimal units up to GB; whole bytes, one digit above."""
    result = F.concat(plain(value / 1e9, 1), F.lit(" GB"))
    for limit, scale, unit in ((1e9, 1e6, "MB"), (1e6, 1e3, "KB")):
        result = F.when(value < limit, F.concat(plain(value / scale, 1), F.lit(f" {unit}"))).otherwise(result)
    return F.when(value < 1000, F.concat(plain(value, 0), F.lit(" B"))).otherwise(result)


def display(value: Column, unit: str) -> Column:
    """Exact text of a number in its unit."""
    number = finite(value)
    if unit in ("trips", "rows", "count"):
        text = grouped(F.bround(number, 0) + 0.0, 0)
    elif unit == "usd":
        size = F.concat(F.lit("$"), grouped(F.abs(number), 2))
        text = F.when(number < 0, F.concat(F.lit("-"), size)).otherwise(size)
    elif unit in ("miles", "minutes", "seconds"):
        digits, suffix = {"miles": (2, " mi"), "minutes": (1, " min"), "seconds": (1, " s")}[unit]
        text = F.concat(grouped(number, digits), F.lit(suffix))
    elif unit == "share":
        text = percent(number)
    elif unit == "bytes":
        text = bytes_text(number)
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return F.when(number.isNull(), MISSING).otherwise(text)


def integer(value: Column) -> Column:
    return display(value, "count")


def short_number(value: Column) -> Column:
    """A histogram bound without a needless decimal part."""
    return trimmed(plain(value, 1))
