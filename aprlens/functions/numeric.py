"""Number parsing and NULL-safe statistics.

Missing is always NULL. NaN and infinities may travel through raw columns but never enter a statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# What is accepted as a number, and the characters a cast would not take although a number may have them.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER_TEXT = (
    rf"(?i)^\s*(?:[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|[+-]?(?:nan|inf|infinity))\s*$"
)
EXTRA_CHARACTERS = "_+"

_INFINITY = float("inf")


def permissive_double(text: Column) -> Column:
    """Text to double: blank or unparsable gives NULL, ``nan``/``inf`` words parse, ``_`` may group digits.

    The pattern keeps out what the JVM parser would take on top (``1.5d``, hexadecimal floats).
    """
    return F.when(text.rlike(NUMBER_TEXT), F.translate(text, EXTRA_CHARACTERS, "").try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double: typed tables are cast, text tables are parsed."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return permissive_double(F.col(name))
    return F.col(name).cast("double")


def finite(value: Column) -> Column:
    """NaN and infinities to NULL (Spark orders NaN above every number)."""
    return F.when(F.abs(value) < F.lit(_INFINITY), value)


def finite_double(text: Column) -> Column:
    return finite(permissive_double(text))


def rounded_text(name: str, digits: int = 6) -> str:
    """``round(name, digits)`` of a double as SQL text: the same number, but for the sign of a zero.

    ``round`` writes every number as decimal text. Scaled numbers below 10^12 lie within 0.001 of what that text says, so
    away from a tie the nearest whole number is the same one, and dividing it by a power of ten rounds as reading does.
    """
    scaled = f"({name} * 1e{digits}D)"
    plain = f"abs({scaled}) < 1e12D AND abs({scaled} - floor({scaled}) - 0.5D) > 0.001D"
    return f"IF({plain}, rint({scaled}) / 1e{digits}D, round({name}, {digits}))"


def finite_mean(value: Column) -> Column:
    return F.avg(finite(value))


def spread(value: Column) -> Column:
    """Population standard deviation, NULL below two values."""
    value = finite(value)
    return F.when(F.count(value) > 1, F.stddev_pop(value))


def quantiles(value: Column, points: list[float]) -> Column:
    """Exact interpolated percentiles as an array."""
    return F.percentile(finite(value), F.array(*[F.lit(p) for p in points]))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both sides are finite; NULL below two pairs or without variance."""
    both = finite(x).isNotNull() & finite(y).isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(F.count(x) >= 2, F.covar_pop(x, y) / scale)


def positive_share(value: Column) -> Column:
    """Share of present values above zero."""
    return F.avg(F.when(value > 0, 1.0).when(value.isNotNull(), 0.0))


def smallest_mode(value: Column) -> Column:
    """Most frequent present value, the smallest on ties."""
    return F.mode(value, True)
