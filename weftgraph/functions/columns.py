"""Column expressions of the graph operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def is_inter(cu: Column, cv: Column) -> Column:
    """Two sets of communities that are both non-empty and share none; null sets are empty."""
    return F.coalesce((F.size(cu) > 0) & (F.size(cv) > 0) & ~F.arrays_overlap(cu, cv), F.lit(False))


def draw_key(*parts: Column | str | int) -> Column:
    """A counter-based random key: the same in every engine, whatever the order of rows."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def draw_index(below: Column, *parts: Column | str | int) -> Column:
    """A counter-based random number from 0 to ``below`` - 1."""
    return F.pmod(F.conv(F.substring(draw_key(*parts), 1, 12), 16, 10).cast("long"), below)


def half_even(x: float) -> int:
    """Rounded to the even neighbour, for sizes that are fixed on the driver."""
    return int(round(x))


def sign_class(h: Column, eps: float = 1e-3) -> Column:
    """positive, negative or neutral, with a dead zone about zero."""
    return F.when(F.abs(h) <= eps, "neutral").when(h > 0, "positive").otherwise("negative")


def plain_name(x: Column) -> Column:
    """A strategy's name in lower case, without outer blanks."""
    return F.lower(F.trim(x))
