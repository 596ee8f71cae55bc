"""Interval algebra inside groups: merging, clustering, gaps, splitting, subtraction, disjoint choice.

Rows need ``idx`` (unique), the group columns, ``start`` and ``end`` with
``start < end``. ``width`` cuts very large groups into segments (see
``plans.running``); 0 finds out whether that is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.binning import survey
from ..plans.grouped import task_count
from ..plans.running import Edges, before_groups, following, running, segment_width
from .joins import _counted, _known, _met, _side_by_side, _unknown, overlap_pairs

#: Rows that ``max_disjoint`` gathers before it starts another array.
TAKEN = 256


def _width(df: DataFrame, by: Sequence[str], width: int | Edges | None, order: Sequence[str]) -> int | Edges | None:
    return segment_width(df, by, order) if width == 0 else width


def islands(df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, width: int | Edges | None = 0) -> DataFrame:
    """``df`` with ``island``, numbered from 0 in each group: a row joins if it starts before the reach so far plus ``slack``."""
    by = list(by)
    order = ["start", "idx"]
    width = _width(df, by, width, order)
    reach = running(df, by, order, {"__reach": ("max", F.col("end"), False)}, width)
    opens = F.when(F.col("__reach").isNull(), 0).when(F.col("start") < F.col("__reach") + slack, 0).otherwise(1)
    flagged = reach.withColumn("__opens", opens)
    return running(flagged, by, order, {"island": ("sum", F.col("__opens"), True)}, width).drop("__reach", "__opens")


def _merged(df: DataFrame, by: list[str], slack: int, width: int | Edges | None) -> DataFrame:
    found = islands(df, by, slack, width).groupBy(*by, "island")
    found = found.agg(F.min(F.struct("start", "idx")).alias("first"), F.max("end").alias("end"), F.count("*").alias("count"))
    return found.select(*by, "island", F.col("first.idx").alias("idx"), F.col("first.start").alias("start"), "end", "count")


def merge(df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, width: int | Edges | None = 0) -> DataFrame:
    """One row per island: groups, ``idx`` of its first row, ``start, end, count``."""
    return _merged(df, list(by), slack, width).drop("island")


def cluster(df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, width: int | Edges | None = 0, sort_output: bool = False) -> DataFrame:
    """``idx, cluster_id`` of every row; ids rise over groups in order and skip one at each change of group."""
    by = list(by)
    labelled = islands(df, by, slack, width)
    # One row per group is all that the numbering over groups sees, and it is dealt into ranges of groups.
    groups = labelled.groupBy(*by).agg((F.max("island") + 2).alias("n"))
    out = labelled.join(before_groups(groups, by, F.col("n"), df), by).select("idx", (F.col("before") + F.col("island")).cast("long").alias("cluster_id"))
    return out.orderBy("cluster_id", "idx") if sort_output else out


def boundary(df: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """One row per group: groups, ``idx`` of the row with the greatest end (then idx), ``start, end, count``."""
    found = df.groupBy(*by).agg(F.max(F.struct("end", "idx")).alias("last"), F.min("start").alias("start"), F.count("*").alias("count"))
    return found.select(*by, F.col("last.idx").alias("idx"), "start", F.col("last.end").alias("end"), "count")


def gaps(
    df: DataFrame,
    by: Sequence[str] = ("grp",),
    slack: int = 0,
    lengths: DataFrame | None = None,
    include_first: bool = False,
    width: int | Edges | None = 0,
) -> DataFrame:
    """The holes of each group: groups, ``start, end`` and ``idx`` of the island before (for a leading hole, after).

    A hole runs from an island's end plus ``slack`` to the next start; ``include_first`` adds the one from 0, and
    ``lengths`` (groups, ``length``) the one up to a group's length. Holes without length are left out.
    """
    by = list(by)
    width = _width(df, by, width, ["start", "idx"])
    placed = following(_merged(df, by, slack, width), by, "start", "next", width)
    if lengths is not None:
        placed = placed.join(lengths.select(*by, "length"), by, "left")
        placed = placed.withColumn("next", F.coalesce("next", "length"))
    holes = [F.struct((F.col("end") + slack).alias("start"), F.col("next").alias("end"))]
    if include_first:
        leading = F.when(F.col("island") == 0, F.struct(F.lit(0).cast("long").alias("start"), F.col("start").alias("end")))
        holes.insert(0, leading)
    exploded = placed.select(*by, "idx", F.explode(F.array(*holes)).alias("hole"))
    return exploded.select(*by, F.col("hole.start").alias("start"), F.col("hole.end").alias("end"), "idx").filter("start < end")


def split(df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, between: bool = False, width: int | Edges | None = 0) -> DataFrame:
    """Cut at every start and every end plus ``slack``: groups, ``idx, start, end`` of pieces that rows cover.

    ``idx`` is the row of the first event at the piece's left edge, ends before starts. ``between`` keeps uncovered
    pieces inside the group, too.
    """
    by = list(by)
    event = F.explode(
        F.array(
            F.struct(F.col("start").alias("pos"), F.lit(1).alias("turn"), F.lit(1).alias("delta")),
            F.struct((F.col("end") + slack).alias("pos"), F.lit(0).alias("turn"), F.lit(-1).alias("delta")),
        )
    )
    events = df.select(*by, "idx", event.alias("ev")).select(*by, "idx", "ev.*")
    points = events.groupBy(*by, "pos").agg(F.sum("delta").alias("delta"), F.min(F.struct("turn", "idx")).alias("first"))
    width = _width(points, by, width, ["pos"])
    covered = running(points, by, ["pos"], {"cover": ("sum", F.col("delta"), True)}, width)
    if width is None:  # one ordering does for both
        covered = covered.withColumn("end", F.lead("pos").over(Window.partitionBy(*by).orderBy("pos")))
    else:
        covered = following(covered, by, "pos", "end", width)
    pieces = covered.select(*by, F.col("first.idx").alias("idx"), F.col("pos").alias("start"), "end", "cover").filter("end IS NOT NULL")
    return (pieces if between else pieces.filter("cover > 0")).select(*by, "idx", "start", "end")


def subtract(a: DataFrame, b: DataFrame, by: Sequence[str] = ("grp",), sort_output: bool = False, width: int | Edges | None = 0) -> DataFrame:
    """Each row of ``a`` less the union of ``b``: ``idx, start, end``, none to several pieces per row."""
    by = list(by)
    targets, cuts_type = _known(b, by), "array<struct<start2:bigint,end2:bigint>>"
    tasks = task_count([_known(a, by), targets], by) if width == 0 else None
    if tasks is not None:  # groups fit tasks: pairs are made and gathered where the rows lie
        known, merged = _known(a, by), merge(targets, by, 0, None)
        levels = survey([(x, F.col("start"), F.col("end")) for x in (known, merged)])
        pairs = _met(_counted(_side_by_side(known, merged, by, tasks), by, 0), by, 0, levels, outer=True)
        cut = F.when(F.col("other").isNotNull(), F.struct(F.col("other.start").alias("start2"), F.col("other.end").alias("end2")))
        rows = pairs.groupBy(*by, "idx", "start", "end").agg(F.array_sort(F.collect_list(cut)).cast(cuts_type).alias("cuts")).select("idx", "start", "end", "cuts")
        rows = rows.unionByName(_unknown(a, by).select("idx", "start", "end", F.array().cast(cuts_type).alias("cuts")))
    else:
        merged = merge(targets, by, 0, width).select(*by, "idx", "start", "end")
        hits = overlap_pairs(a, merged, by).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("start2", "end2"))).alias("cuts"))
        rows = a.select("idx", "start", "end").join(hits, "idx", "left")
    cuts = F.coalesce("cuts", F.array().cast(cuts_type))
    starts = F.concat(F.array("start"), F.transform(cuts, lambda c: c["end2"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start2"]), F.array("end"))
    pieces = rows.select("idx", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("p"))
    out = pieces.select("idx", F.col("p.s").alias("start"), F.col("p.e").alias("end")).filter("start < end")
    return out.orderBy("idx", "start") if sort_output else out


def max_disjoint(df: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, width: int | Edges | None = 0, sort_output: bool = False) -> DataFrame:
    """``idx`` of rows chosen greedily by (start, end, idx): a row is taken if it starts after the last end plus 3 ``slack``.

    A row beyond the reach of all rows before it is taken whatever came before, so the choice is made for each
    stretch between such rows by itself.
    """
    by = list(by)
    order = ["start", "end", "idx"]
    width = _width(df, by, width, order)
    gap = 3 * slack
    reach = running(df.select(*by, *order), by, order, {"reach": ("max", F.col("end"), False)}, width)
    fresh = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), 1).otherwise(0)
    parts = running(reach.withColumn("fresh", fresh), by, order, {"part": ("sum", F.col("fresh"), True)}, width)
    rows = parts.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("rows"))
    # What is taken is gathered in two levels: adding to an array copies it, and copies stay short this way.
    no_ids = F.array().cast("array<bigint>")
    begin = F.struct(F.lit(None).cast("long").alias("last"), no_ids.alias("taken"), F.array().cast("array<array<bigint>>").alias("full"))

    def step(state, row):
        takes = state["last"].isNull() | (row["start"] > state["last"] + gap)
        more = F.concat(state["taken"], F.array(row["idx"]))
        room = F.size(state["taken"]) < TAKEN
        taken = F.when(
            room, F.struct(row["end"].alias("last"), more.alias("taken"), state["full"].alias("full"))
        ).otherwise(
            F.struct(row["end"].alias("last"), F.array(row["idx"]).alias("taken"), F.concat(state["full"], F.array(state["taken"])).alias("full"))
        )
        return F.when(takes, taken).otherwise(state)

    all_taken = F.aggregate("rows", begin, step, lambda x: F.concat(F.flatten(x["full"]), x["taken"]))
    chosen = F.when(F.size("rows") == 1, F.array(F.col("rows")[0]["idx"])).otherwise(all_taken)
    out = rows.select(F.explode(chosen).alias("idx"))
    return out.orderBy("idx") if sort_output else out
