"""Bounds, extension and orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.running import Edges, running, segment_width


def outside_bounds(df: DataFrame, clip: bool = False, only_right: bool = False, length: Column | str = "length") -> DataFrame:
    """Drop, or ``clip``, rows outside ``[0, length)``: ``idx, start, end``. ``only_right`` leaves the left end alone.

    A row without a length fails at execution.
    """
    size = F.col(length) if isinstance(length, str) else length
    size = F.when(size.isNull(), F.raise_error(F.lit("a row has no length")).cast("long")).otherwise(size)
    rows = df.select("idx", "start", "end", size.alias("__length"))
    s, e, n = F.col("start"), F.col("end"), F.col("__length")
    if not clip:
        return rows.filter(e <= n if only_right else (e <= n) & (s >= 0)).select("idx", "start", "end")
    kept = rows.filter(s < n if only_right else (s < n) & (e > 0))
    left = s if only_right else F.greatest(s, F.lit(0))
    return kept.select("idx", left.alias("start"), F.least(e, n).alias("end"))


def check_extension(ext: int | None = None, ext_3: int | None = None, ext_5: int | None = None) -> tuple[int, int]:
    """(ext_3, ext_5): either ``ext`` for both ends, or one or both of the others."""
    if (ext is None) == (ext_3 is None and ext_5 is None):
        raise ValueError("give either ext or ext_3 and ext_5")
    return (ext, ext) if ext is not None else (ext_3 or 0, ext_5 or 0)


def extend_grp(df: DataFrame, ext_3: int = 0, ext_5: int = 0, by: Sequence[str] = ("grp",)) -> DataFrame:
    """Move each group's outer ends: ``idx, start, end`` of all rows.

    Only the first row with the least start and the first with the greatest end change; the strand is that of the
    former. With ``by=["idx"]`` every row is extended.
    """
    by = list(by)
    fwd = F.col("fwd") if "fwd" in df.columns else F.lit(True)
    rows = df.select(*[c for c in by if c != "idx"], "idx", "start", "end", fwd.alias("fwd"))
    ends = rows.groupBy(*by).agg(
        F.min(F.struct("start", "idx", "fwd")).alias("__low"), F.min(F.struct((-F.col("end")).alias("e"), "idx")).alias("__high")
    )
    joined = rows.join(ends.select(*by, F.col("__low.idx").alias("__first"), F.col("__low.fwd").alias("__fwd"), F.col("__high.idx").alias("__last")), by)
    left, right = F.when(F.col("__fwd"), ext_5).otherwise(ext_3), F.when(F.col("__fwd"), ext_3).otherwise(ext_5)
    return joined.select(
        "idx",
        F.when(F.col("idx") == F.col("__first"), F.col("start") - left).otherwise(F.col("start")).alias("start"),
        F.when(F.col("idx") == F.col("__last"), F.col("end") + right).otherwise(F.col("end")).alias("end"),
    )


def sort_keys(df: DataFrame, reverse: Column | str | None = None, with_ends: bool = True) -> list[Column]:
    """Sort keys (start, end, idx); rows for which ``reverse`` holds run from right to left."""
    flag = F.lit(False) if reverse is None else F.col(reverse) if isinstance(reverse, str) else reverse
    sign = F.when(flag, F.lit(-1)).otherwise(F.lit(1))
    return [sign * F.col("start"), *([sign * F.col("end")] if with_ends else []), F.col("idx")]


def sort_order(df: DataFrame, by: Sequence[str] = ("grp",), reverse: Column | str | None = None) -> DataFrame:
    """Rows in order of group, start, end and idx."""
    return df.orderBy(*by, *sort_keys(df, reverse))


def sort_groups(df: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """Rows in order of group and idx."""
    return df.orderBy(*by, "idx")


def rank_in_group(df: DataFrame, keys: Sequence[Column], by: Sequence[str] = ("grp",), width: int | Edges | None = 0) -> DataFrame:
    """``idx`` and its ``rank`` from 0 in its group. ``width`` as in ``running``; 0 finds out whether it is needed."""
    order = [f"__k{k}" for k in range(len(keys))]
    rows = df.select(*by, "idx", *[x.alias(c) for x, c in zip(keys, order)])
    if width == 0:
        width = segment_width(rows, by, order)
    ran = running(rows, list(by), order, {"rank": ("sum", F.lit(1), True)}, width)
    return ran.select("idx", (F.col("rank") - 1).alias("rank"))


def widened(df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, reverse: Column | str | None = None) -> DataFrame:
    """Rows made longer by ``slack`` on both sides: groups, ``idx, start, end``; both ends negated where ``reverse`` holds."""
    flag = F.lit(False) if reverse is None else F.col(reverse) if isinstance(reverse, str) else reverse
    sign = F.when(flag, F.lit(-1)).otherwise(F.lit(1))
    return df.select(*by, "idx", (sign * (F.col("start") - slack)).alias("start"), (sign * (F.col("end") + slack)).alias("end"))


def widened_ranks(
    df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, reverse: Column | str | None = None, with_ends: bool = True, width: int | Edges | None = 0
) -> DataFrame:
    """``widened`` with the ``rank`` of each row in its group, by start, end if ``with_ends``, and idx."""
    rows = widened(df, by, slack, reverse)
    return rows.join(rank_in_group(rows, sort_keys(rows, None, with_ends), by, width), "idx").select(*by, "idx", "start", "end", "rank")


_MOST = (1 << 63) - 1


def _pair(start: Column, end: Column, *more: Column) -> Column:
    return F.inline(F.array(F.struct(start.alias("pos"), F.lit(True).alias("is_start"), *more), F.struct(end.alias("pos"), F.lit(False).alias("is_start"), *more)))


def events(df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, set_no: int = 1) -> DataFrame:
    """Start and end events: groups, ``pos, is_start, set_no, idx``; ends come first at a position when sorted so."""
    rows = df.select(*by, "idx", _pair(F.col("start"), F.col("end") + slack))
    return rows.select(*by, "pos", "is_start", F.lit(set_no).alias("set_no"), "idx")


def events_of_two(
    a: DataFrame, b: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, clamp: bool = False, spans: bool = False
) -> DataFrame:
    """Events of two sets, the first made longer by ``slack`` on both sides: groups, ``pos, is_start, set_no, idx``.

    ``clamp`` keeps starts from falling under 0 and ends from passing the greatest number; ``spans`` adds the
    (longer) ``start, end`` of each event's row.
    """
    low, high = F.col("start") - slack, F.col("end") + slack
    if clamp:
        low = F.when(F.col("start") > slack, low).otherwise(F.lit(0).cast("long"))
        high = F.coalesce(F.try_add(F.col("end"), F.lit(slack)), F.lit(_MOST))

    def one(df: DataFrame, s: Column, e: Column, set_no: int) -> DataFrame:
        more = [s.alias("start"), e.alias("end")] if spans else []
        rows = df.select(*by, F.col("idx"), _pair(s, e, *more))
        return rows.select(*by, "pos", "is_start", F.lit(set_no).alias("set_no"), "idx", *(["start", "end"] if spans else []))

    return one(a, low, high, 1).unionByName(one(b, F.col("start"), F.col("end"), 2))


def edge_events(df: DataFrame, edge: str, by: Sequence[str] = ("grp",), slack: int = 0, negate: bool = False, set_no: int = 1) -> DataFrame:
    """One edge of each row as events, starts moved left by ``slack`` and ends right: groups, ``pos, is_start, set_no, idx``."""
    pos = F.col(_edge(edge)) + (-slack if edge == "start" else slack)
    return df.select(*by, (-pos if negate else pos).alias("pos"), F.lit(edge == "start").alias("is_start"), F.lit(set_no).alias("set_no"), "idx")


def _edge(edge: str) -> str:
    if edge not in ("start", "end"):
        raise ValueError(f"edge {edge!r}: start or end")
    return edge


def positions(df: DataFrame, edge: str, by: Sequence[str] = ("grp",), slack: int = 0) -> DataFrame:
    """One edge of each row, moved left by ``slack``: groups, ``pos, idx``."""
    return df.select(*by, (F.col(_edge(edge)) - slack).alias("pos"), "idx")
