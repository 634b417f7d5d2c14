"""Column helpers for numbers: clipping, rounding, shares and keyed draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_double(col: Column | str) -> Column:
    """Cast to double; text that is not a number and NaN become null."""
    col = F.col(col) if isinstance(col, str) else col
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def clip(col: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; null stays null although least/greatest skip nulls."""
    return F.when(col.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, rounded half to even."""
    return F.bround(share(part, whole) * 100, digits)


def share_text(part: Column, whole: Column) -> Column:
    """`n/total (p%)` with one decimal; rounded first because the JVM formatter rounds halves up."""
    return F.format_string("%d/%d (%.1f%%)", part, whole, percent(part, whole, 1))


def keyed_draw(seed: int, purpose: str, *ids: Column | str) -> Column:
    """A 32-bit draw that depends only on (seed, purpose, ids).

    `rand(seed)` depends on the partitioning; a draw from the key gives the same value on any cluster and when
    a lost task runs again.
    """
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[F.col(c) if isinstance(c, str) else c for c in ids])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def bucketed(col: Column, width: int) -> Column:
    """Nearest multiple of `width`, halves to even."""
    return (F.bround(col / width, 0) * width).cast("bigint")
