"""Feature and scoring expressions. All are built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column | str) -> Column:
    """Rows where a condition, or the named boolean column, holds."""
    return F.sum(flag(F.col(condition) if isinstance(condition, str) else condition))


def sum_where(condition: Column | str, value: str) -> Column:
    condition = F.col(condition) if isinstance(condition, str) else condition
    return F.sum(F.when(condition, F.col(value)).otherwise(0.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL instead of an error on zero."""
    return F.try_divide(top, bottom)


def rounded(value: Column, digits: int) -> Column:
    """Halves up. Eight decimals come first, so that the order of a sum has no say."""
    return F.round(value.cast("decimal(30,8)"), digits).cast("double")


def cents(value: Column) -> Column:
    return rounded(value, 2)


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def percent(value: Column) -> Column:
    """One decimal of the exact binary value, halves to even. ``format_string`` rounds the shortest text of a double
    half up instead: 99.25 would be 99.3."""
    return F.concat(F.call_function("format_number", value * 100, F.lit("0.0")), F.lit("%"))


def preview(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def record_hash(columns: list[str]) -> Column:
    """md5 over the exact texts of columns. Each text goes behind its length, so that no value can
    look like the border between two; NULL is a minus sign, which no length is."""

    def text(name: str) -> Column:
        value = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.md5(F.concat_ws("|", *[text(n) for n in columns]))


def md5_mod_1000(text: Column) -> Column:
    """The 128-bit md5 number modulo 1000. 616 is 2**64 modulo 1000."""
    digest = F.md5(text)

    def half(start: int) -> Column:
        return F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % 1000

    return ((half(1) * 616 + half(17)) % 1000).cast("int")


def weather_summary(precipitation: Column, wind: Column) -> Column:
    """SLV-11: words for rain (inches) and wind (mph)."""
    return (
        F.when(precipitation > 1.0, "Heavy Rain")
        .when(precipitation > 0.5, "Rain")
        .when(wind > 25, "High Wind")
        .when(wind > 15, "Windy")
        .otherwise("Clear")
    )
