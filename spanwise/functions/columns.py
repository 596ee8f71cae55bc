"""Column expressions over half-open integer intervals ``[start, end)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlaps_expr(s: Column | str, e: Column | str, s2: Column | str, e2: Column | str, slack: int = 0) -> Column:
    """Whether two intervals share a position, or lie less than ``slack`` apart."""
    return (col(s) < col(e2) + slack) & (col(s2) < col(e) + slack)


def contains_expr(s: Column | str, e: Column | str, s2: Column | str, e2: Column | str, slack: int = 0) -> Column:
    """Whether the first interval, widened by ``slack``, lies inside the second."""
    return (col(s) - slack >= col(s2)) & (col(e) + slack <= col(e2))


def distance_expr(s: Column | str, e: Column | str, s2: Column | str, e2: Column | str) -> Column:
    """0 for overlapping intervals, else the gap between them plus 1."""
    gap = F.greatest(col(s2) - col(e), col(s) - col(e2)) + 1
    return F.when(overlaps_expr(s, e, s2, e2), F.lit(0)).otherwise(gap).cast("long")


def floor_div(x: Column | str, w: Column | int) -> Column:
    """``floor(x / w)`` in whole numbers, for negative ``x`` too."""
    w = w if isinstance(w, Column) else F.lit(w)
    return F.call_function("div", col(x) - F.pmod(col(x), w), w)


def tile_start_expr(x: Column | str, width: int) -> Column:
    """Start of the tile of the absolute grid that holds position ``x``."""
    return col(x) - F.pmod(col(x), F.lit(width))
