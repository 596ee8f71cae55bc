"""Tiles, windows along groups, running lengths and spliced slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tile_start_expr
from ..plans.running import Edges, running, segment_width


def _positive(value: int, what: str) -> None:
    if value <= 0:
        raise ValueError(f"{what} must be positive")


def _forward(df: DataFrame) -> Column:
    return F.col("fwd") if "fwd" in df.columns else F.lit(True)


def tile(df: DataFrame, tile_size: int, keep: Sequence[str] = ()) -> DataFrame:
    """Tiles of the absolute grid that each row meets: ``idx, tile_no, start, end, fraction``.

    Tiles are whole; ``fraction`` is the part of the tile that the row covers. Numbers run from the
    left, and from the right for rows that are not ``fwd``. Rows without length have no tiles.
    """
    _positive(tile_size, "tile_size")
    starts = F.sequence(tile_start_expr("start", tile_size), F.col("end") - 1, F.lit(tile_size).cast("long"))
    ordered = F.when(_forward(df), starts).otherwise(F.reverse(starts))
    rows = df.filter("start < end").select("idx", *keep, F.col("start").alias("s"), F.col("end").alias("e"), F.posexplode(ordered).alias("tile_no", "start"))
    part = F.least(F.col("start") + tile_size, F.col("e")) - F.greatest("start", "s")
    return rows.select("idx", *keep, "tile_no", "start", (F.col("start") + tile_size).alias("end"), (part.cast("double") / tile_size).alias("fraction"))


def tile_grouped(df: DataFrame, tile_size: int, by: Sequence[str] = ("grp",)) -> DataFrame:
    """``tile`` with the group columns; groups do not change the tiles."""
    return tile(df, tile_size, list(by))


def window_grouped(df: DataFrame, window_size: int, by: Sequence[str] = ("grp",), order_by: str = "idx", width: int | Edges | None = 0) -> DataFrame:
    """Cut rows every ``window_size`` positions along their group's rows laid end to end: ``idx, piece_no, start, end``.

    Forward rows of a group are measured from their left end in order of ``order_by``, others from their right end.
    """
    _positive(window_size, "window_size")
    by = list(by)
    rows = df.filter("start < end").withColumn("fwd", _forward(df)).withColumn("__len", F.col("end") - F.col("start"))
    keys = [*by, "fwd"]
    if width == 0:
        width = segment_width(rows, keys, [order_by])
    before = running(rows, keys, [order_by], {"__before": ("sum", F.col("__len"), False)}, width)
    before = before.withColumn("__before", F.coalesce("__before", F.lit(0)))
    totals = rows.groupBy(*keys).agg(F.sum("__len").alias("__total"))
    before = before.join(totals, keys)
    w = F.lit(window_size)
    first = F.when(F.col("fwd"), F.pmod(-F.col("__before"), w)).otherwise(F.pmod(F.col("__total") - F.col("__before"), w))
    first = F.when(first == 0, w).otherwise(first)  # a cut at the row's own start is none
    cuts = F.when(first < F.col("__len"), F.sequence(first, F.col("__len") - 1, w.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    edges = F.concat(F.array(F.lit(0).cast("long")), cuts, F.array("__len"))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("__edges") - 1),
        lambda k: F.struct(F.element_at("__edges", k).alias("a"), F.element_at("__edges", k + 1).alias("b")),
    )
    cut = before.withColumn("__edges", edges).withColumn("__pieces", pieces)
    out = cut.select("idx", F.col("start").alias("s"), F.posexplode(F.when(F.col("fwd"), F.col("__pieces")).otherwise(F.reverse("__pieces"))).alias("piece_no", "p"))
    return out.select("idx", "piece_no", (F.col("s") + F.col("p.a")).alias("start"), (F.col("s") + F.col("p.b")).alias("end"))


def _run_lengths(df: DataFrame, by: list[str], width: int | Edges | None, ends: bool) -> tuple[DataFrame, list[str]]:
    """Rows with ``__cs, __ce``, the running length before and after each in order of transcription."""
    sign = F.when(F.col("fwd"), F.lit(1)).otherwise(F.lit(-1))
    rows = df.withColumn("fwd", _forward(df)).withColumn("__pos", sign * F.col("start")).withColumn("__end", sign * F.col("end"))
    rows = rows.withColumn("__len", F.abs(F.col("end") - F.col("start")))
    order = ["__pos", "__end", "idx"] if ends else ["__pos", "idx"]
    if width == 0:
        width = segment_width(rows, by, order)
    ran = running(rows, by, order, {"__ce": ("sum", F.col("__len"), True)}, width)
    return ran.withColumn("__cs", F.col("__ce") - F.col("__len")), order


def group_cumsum(df: DataFrame, by: Sequence[str] = ("grp",), width: int | Edges | None = 0, sort_output: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``idx, start, end``: each row's place along its group laid end to end, from the right for reverse rows; ``keep`` adds columns of ``df``."""
    ran, _ = _run_lengths(df, list(by), width, False)
    out = ran.select("idx", F.col("__cs").alias("start"), F.col("__ce").alias("end"), *keep)
    return out.orderBy("idx") if sort_output else out


def _slice(ran: DataFrame, by: list[str], start: Column, end: Column, force_plus: bool) -> DataFrame:
    totals = ran.groupBy(*by).agg(F.sum("__len").alias("__total"))
    rows = ran.join(totals, by).withColumn("__from", start).withColumn("__to", end)
    total = F.col("__total")
    gs = F.when(F.col("__from") < 0, total + F.col("__from")).otherwise(F.col("__from"))
    ge = F.when(F.col("__to").isNull(), total).when(F.col("__to") < 0, total + F.col("__to")).otherwise(F.col("__to"))
    head, tail = F.greatest(F.lit(0), gs - F.col("__cs")), F.greatest(F.lit(0), F.col("__ce") - ge)
    ahead = F.lit(True) if force_plus else F.col("fwd")
    out = rows.select(
        "idx",
        (F.col("start") + F.when(ahead, head).otherwise(tail)).alias("start"),
        (F.col("end") - F.when(ahead, tail).otherwise(head)).alias("end"),
        (F.col("fwd") == ahead).alias("strand"),
    )
    return out.filter("start < end")


def spliced_subseq(
    df: DataFrame,
    start: int = 0,
    end: int | None = None,
    by: Sequence[str] = ("grp",),
    force_plus_strand: bool = False,
    width: int | Edges | None = 0,
    sort_output: bool = False,
) -> DataFrame:
    """The slice ``[start:end)`` of each group's spliced rows, Python style: ``idx, start, end, strand``."""
    ran, _ = _run_lengths(df, list(by), width, True)
    out = _slice(ran, list(by), F.lit(start).cast("long"), F.lit(end).cast("long"), force_plus_strand)
    return out.orderBy("idx") if sort_output else out


def spliced_subseq_multi(df: DataFrame, by: Sequence[str] = ("grp",), force_plus_strand: bool = False, width: int | Edges | None = 0, sort_output: bool = False) -> DataFrame:
    """As ``spliced_subseq``, with the slice of each group from ``slice_start, slice_end`` of its first row."""
    by = list(by)
    ran, order = _run_lengths(df, by, width, True)
    picked = F.min_by(F.struct("slice_start", "slice_end"), F.struct(*order)).alias("__slice")
    ran = ran.drop("slice_start", "slice_end").join(ran.groupBy(*by).agg(picked), by)
    out = _slice(ran, by, F.col("__slice.slice_start"), F.col("__slice.slice_end"), force_plus_strand)
    return out.orderBy("idx") if sort_output else out
