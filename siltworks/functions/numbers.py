"""Number expressions: null handling, clamps and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "-"


def known(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(F.isnan(x), None).otherwise(x)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fixed(number: Column, decimals: int, minus: str = MINUS) -> Column:
    """Fixed-point text with thousands commas; the sign of the rounded number before it."""
    rounded = F.bround(number.cast("double"), decimals)
    if minus == MINUS:
        return F.format_number(rounded + F.lit(0.0), decimals)  # no negative zero; rounded once a row
    text = F.format_number(F.abs(rounded), decimals)
    return F.when(rounded < 0, F.concat(F.lit(minus), text)).otherwise(text)


def integer_text(number: Column, minus: str = MINUS) -> Column:
    whole = number.cast("long")
    text = F.format_number(F.abs(whole), 0)
    return F.when(whole < 0, F.concat(F.lit(minus), text)).otherwise(text)


def significant_decimals(number: Column) -> Column:
    """Decimal places that show four significant figures."""
    power = F.floor(F.log10(F.abs(number)))
    return F.when(number == 0, 0).otherwise(F.greatest(F.lit(0), 3 - power)).cast("int")


def significant(number: Column, minus: str = MINUS) -> Column:
    """Four significant figures, trailing zeros dropped, thousands commas."""
    places = significant_decimals(number)
    text = F.when(F.lit(False), "")
    for d in range(0, 16):
        text = text.when(places == d, fixed(number, d, minus))
    trimmed = F.regexp_replace(text, "\\.?0+$", "")
    return F.when(number == 0, "0").when(text.contains("."), trimmed).otherwise(text)


#: Words of a column name that ask for three decimals.
THREE_DECIMALS = "lpips flip rate share recall precision fraction prob".split()


def _by_metric(column: Column, value: Column, show) -> Column:
    """``show`` of the decimal places that the words of a column's name ask for; null where they ask for none."""
    name = F.lower(column)
    has_word = lambda words: name.rlike(f"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)")
    return (
        F.when(name.contains("gmac") | has_word(["ms"]), show(1))
        .when(name.contains("psnr"), show(2))
        .when(name.contains("ssim"), F.when(value >= 0.99, show(4)).otherwise(show(3)))
        .when(has_word(THREE_DECIMALS), show(3))
        .when(name.contains("temporal") | name.contains("tce") | name.contains("warp"), show(4))
    )


def decimals_of(column: Column, value: Column) -> Column:
    """Decimal places of a metric by the words of its column's name; null asks for significant figures."""
    return _by_metric(column, value, F.lit)


def format_metric(column: Column, value: Column, minus: str = MINUS) -> Column:
    """The value with the places of ``decimals_of``. The many cases of significant figures stay out of the code of the others' rows."""
    figures = F.element_at(F.transform(F.array(value), lambda v: significant(v, minus)), 1)
    return _by_metric(column, value, lambda places: fixed(value, places, minus)).otherwise(figures)


def count_text(number: Column, minus: str = MINUS) -> Column:
    """138K, 1.41M or the plain number."""
    size = F.abs(number)
    return (
        F.when(size >= 1e6, F.concat(fixed(number / 1e6, 2, minus), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed(F.bround(number / 1e3), 0, minus), F.lit("K")))
        .otherwise(integer_text(number, minus))
    )


def estimate_ms(gmac: Column, tflops: Column) -> Column:
    """Milliseconds for two operations a multiply-add; infinite without throughput."""
    return F.when(tflops > 0, F.lit(2.0) * gmac / tflops).otherwise(F.lit(float("inf")))
