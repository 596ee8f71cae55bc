"""Joins of two interval frames on their groups and positions.

``a`` is the query side with ``idx, start, end``, ``b`` the target side with the
same names; results name the target's row ``idx2``. Rows with a null group or
position match nothing. Intervals must have a length (see ``validate_intervals``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_expr, floor_div, overlaps_expr
from ..plans.binning import Survey, binned_pairs, level_of, survey
from ..plans.grouped import deal, task_count
from ..plans.running import Edges, running, segment_width

OVERLAP_TYPES = ("all", "first", "last")
DIRECTIONS = ("any", "forward", "backward")


def _one_of(value: str, allowed: Sequence[str], what: str) -> str:
    if value.lower() not in allowed:
        raise ValueError(f"{what} {value!r}: one of {', '.join(allowed)}")
    return value.lower()


def _known(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[*by, "start", "end"])


def _unknown(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows that ``_known`` leaves out."""
    known = F.lit(True)
    for c in (*by, "start", "end"):
        known = known & F.col(c).isNotNull()
    return df.filter(~known)


def _target(b: DataFrame, by: Sequence[str]) -> DataFrame:
    return b.select(*by, F.col("idx").alias("idx2"), F.col("start").alias("start2"), F.col("end").alias("end2"))


def overlap_pairs(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str] = ("grp",),
    slack: int = 0,
    contained: bool = False,
    binned: bool | None = None,
    levels: Survey | None = None,
) -> DataFrame:
    """All matching pairs: ``idx, idx2, start, end, start2, end2`` and the groups.

    Bins bound what a task joins, whatever the number of groups; ``binned=False`` joins on the groups alone.
    ``levels`` as in ``binned_pairs``.
    """
    by = list(by)
    rule = (contains_expr if contained else overlaps_expr)("start", "end", "start2", "end2", slack)
    left = _known(a, by).select(*by, "idx", "start", "end")
    right = _target(_known(b, by), by)
    keep = [F.col(c) for c in (*by, "idx", "idx2", "start", "end", "start2", "end2")]
    if binned is False:
        return left.join(right, by).filter(rule).select(*keep)
    low, high = F.col("start") - slack, F.col("end") + slack
    if slack < 0 and contained:
        # A query that shrinks past itself turns into [high, low]: targets that begin by its end and end from its start on match.
        turned = low >= high
        low, high = F.when(turned, high - 1).otherwise(low), F.when(turned, low + 1).otherwise(high)
    elif slack < 0:  # who overlaps by so much overlaps
        low, high = F.col("start"), F.col("end")
    return binned_pairs(left, right, by, low, high, rule, keep, levels)


def overlaps(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str] = ("grp",),
    slack: int = 0,
    overlap_type: str = "all",
    contained: bool = False,
    binned: bool | None = None,
    sort_output: bool = False,
) -> DataFrame:
    """``idx, idx2`` of overlapping rows, or of query rows inside a target row.

    ``first`` and ``last`` keep, for each query row, the least or greatest target by (start, end, idx).
    """
    kind = _one_of(overlap_type, OVERLAP_TYPES, "overlap_type")
    pairs = overlap_pairs(a, b, by, slack, contained, binned)
    if kind == "all":
        out = pairs.select("idx", "idx2")
    else:
        pick = F.min if kind == "first" else F.max  # of the order itself, which ends in the row: partial before the shuffle
        best = pairs.groupBy("idx").agg(pick(F.struct("start2", "end2", "idx2")).alias("best"))
        out = best.select("idx", F.col("best.idx2").alias("idx2"))
    return out.orderBy("idx", "idx2") if sort_output else out


def intersect(a: DataFrame, b: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """The common part of each overlapping pair: groups, ``idx, idx2, start, end``."""
    pairs = overlap_pairs(a, b, by)
    return pairs.select(*by, "idx", "idx2", F.greatest("start", "start2").alias("start"), F.least("end", "end2").alias("end"))


def count_overlaps(a: DataFrame, b: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, width: int | Edges | None = 0) -> DataFrame:
    """``idx, n_overlaps`` of every query row, 0 where none; without making pairs if ``slack`` is not negative.

    The matches of a row are the targets that start before its end, less those that end by its start: two running
    counts over one ordering of positions. ``width`` as in ``running``; 0 finds out whether it is needed.
    """
    by = list(by)
    if slack < 0:
        pairs = overlap_pairs(a, b, by, slack).groupBy("idx").agg(F.count("*").alias("n"))
        return a.select("idx").join(pairs, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n_overlaps"))
    known = _known(a, by)
    tasks = task_count([known, b], by) if width == 0 else None
    if tasks is not None:
        counted = _counts_dealt(a, b, by, slack, tasks, ()).select("idx", "n_overlaps")
        return counted.unionByName(_unknown(a, by).select("idx", F.lit(0).cast("long").alias("n_overlaps")))

    def events(df: DataFrame, pos: Column, turn: int, opened: int, closed: int, sign: int) -> DataFrame:
        idx = F.col("idx") if sign else F.lit(None).cast("long")
        return df.select(
            *by, pos.alias("pos"), F.lit(turn).alias("turn"), F.lit(opened).alias("opened"), F.lit(closed).alias("closed"), idx.alias("idx"), F.lit(sign).alias("sign")
        )

    # At one position: ends, then queries, then starts. Targets are summed by position, so that one that very many share is one row.
    targets = _known(b, by)
    sides = events(targets, F.col("end") + slack, 0, 0, 1, 0).unionByName(events(targets, F.col("start"), 2, 1, 0, 0))
    if width == 0:
        width = segment_width(sides.unionByName(events(known, F.col("start"), 1, 0, 0, -1)), by, ["pos", "turn", "idx"])
    if width is not None:
        keys = [*by, "pos", "turn", "idx", "sign"]
        sides = sides.groupBy(*keys).agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    all_events = sides.unionByName(events(known, F.col("start"), 1, 0, 0, -1)).unionByName(events(known, F.col("end") + slack, 1, 0, 0, 1))
    sums = {"n_open": ("sum", F.col("opened"), True), "n_closed": ("sum", F.col("closed"), True)}
    counted = running(all_events, by, ["pos", "turn", "idx"], sums, width)
    value = F.when(F.col("sign") == 1, F.col("n_open")).when(F.col("sign") == -1, -F.col("n_closed"))
    counts = counted.filter("sign <> 0").groupBy("idx").agg(F.sum(value).alias("n"))
    return a.select("idx").join(counts, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).cast("long").alias("n_overlaps"))


def _counts_dealt(a: DataFrame, b: DataFrame, by: list[str], slack: int, tasks: int, payload: Sequence[str]) -> DataFrame:
    """Groups, ``idx, start, end, n_overlaps`` and ``row`` of the known rows of ``a``, by one exchange."""
    return _counted(_side_by_side(_known(a, by), _known(b, by), by, tasks, payload), by, slack).filter("turn = 1")


def non_overlaps(a: DataFrame, b: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, sort_output: bool = False) -> DataFrame:
    """``idx`` of query rows that overlap no target; all of them if there are no targets."""
    out = count_overlaps(a, b, by, slack).filter("n_overlaps = 0").select("idx")
    return out.orderBy("idx") if sort_output else out


def overlap_join(a: DataFrame, b: DataFrame, by: Sequence[str] = ("grp",), slack: int = 0, how: str = "inner", contained: bool = False, suffix: str = "2") -> DataFrame:
    """Whole rows joined by overlap; ``how``: inner, left, left_semi or left_anti. Columns of ``b`` get ``suffix``."""
    how = _one_of(how, ("inner", "left", "left_semi", "left_anti"), "how")
    by = list(by)
    tasks = task_count([_known(a, by), _known(b, by)], by) if slack >= 0 and not contained else None
    if tasks is not None:
        return _joined_dealt(a, b, by, slack, how, suffix, tasks)
    if how in ("left_semi", "left_anti") and not contained:  # counted, so that no pairs are made
        some = count_overlaps(a.select(*by, "idx", "start", "end"), b, by, slack).filter("n_overlaps > 0").select("idx")
        return a.join(some, "idx", how)
    pairs = overlaps(a, b, by, slack, "all", contained)
    if how in ("left_semi", "left_anti"):
        return a.join(pairs.select("idx").distinct(), "idx", how)
    renamed = b.toDF(*[f"{c}{suffix}" for c in b.columns])
    return a.join(pairs, "idx", how).join(renamed, F.col("idx2") == F.col(f"idx{suffix}") if suffix != "2" else "idx2", how)


def _joined_dealt(a: DataFrame, b: DataFrame, by: list[str], slack: int, how: str, suffix: str, tasks: int) -> DataFrame:
    """``overlap_join`` where groups fit tasks: whole rows go through one exchange."""
    keys = [*by, "idx", "start", "end"]
    payload, payload2 = ([c for c in x.columns if c not in keys] for x in (a, b))
    own = ["idx", *(F.col(c) if c in keys else F.col(f"row.`{c}`").alias(c) for c in a.columns if c != "idx")]
    if how in ("left_semi", "left_anti"):
        wanted = F.col("n_overlaps") > 0 if how == "left_semi" else F.col("n_overlaps") == 0
        out = _counts_dealt(a, b, by, slack, tasks, payload).filter(wanted).select(*own)
        return out if how == "left_semi" else out.unionByName(_unknown(a, by))
    known, targets = _known(a, by), _known(b, by)
    levels = survey([(known, F.col("start") - slack, F.col("end") + slack), (targets, F.col("start"), F.col("end"))])
    rows = _counted(_side_by_side(known, targets, by, tasks, payload, payload2), by, slack)
    pairs = _met(rows, by, slack, levels, outer=how == "left")
    there = F.col("other").isNotNull()
    theirs = []
    for c in b.columns:
        held = F.when(there, F.col(c)) if c in by else F.col(f"other.`{c}`") if c in keys else F.col(f"other.row2.`{c}`")
        theirs.append(held.alias(f"{c}{suffix}"))
    # The order of columns that two joins on ids give: the target's id first where both sides call it idx2.
    idx2 = F.col("other.idx").alias("idx2")
    mine = [x for x, c in zip(theirs, b.columns) if c != "idx"] if suffix == "2" else theirs
    found = pairs.select(*([idx2, *own] if suffix == "2" else [*own, idx2]), *mine)
    return found if how == "inner" else found.unionByName(_unknown(a, by), allowMissingColumns=True)


def nearest(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str] = ("grp",),
    slack: int = 0,
    k: int = 1,
    include_overlaps: bool = True,
    direction: str = "any",
    sort_output: bool = False,
    width: int | Edges | None = 0,
) -> DataFrame:
    """``idx, idx2, distance``: targets at the ``k`` least distinct distances of each query row, all ties kept.

    Overlaps (within ``slack``) have distance 0; others the gap plus 1, measured from the query moved left by
    ``slack``. ``forward`` looks right, ``backward`` left, by coordinates alone. ``width`` as in ``running``; 0 finds
    out whether a group is too large for one task, and if none is a large part of the rows deals them once, by groups.
    """
    way = _one_of(direction, DIRECTIONS, "direction")
    by = list(by)
    if k < 0:
        raise ValueError("k must not be negative")
    if k == 0:
        return a.select("idx", F.col("idx").alias("idx2"), F.col("idx").alias("distance")).limit(0)
    queries, targets = _known(a, by), _known(b, by)
    tasks = task_count([queries, targets], by) if width == 0 and slack >= 0 else None
    if tasks is not None:
        out = _nearest_dealt(queries, targets, by, slack, k, include_overlaps, way, tasks)
        return out.orderBy("idx", "distance", "idx2") if sort_output else out
    if width == 0:
        ends = [x.select(*by, F.col("start").alias("p"), F.lit(t).alias("turn"), i.alias("idx")) for x, t, i in ((queries, 1, F.col("idx")), (targets, 0, F.lit(None).cast("long")))]
        width = segment_width(ends[0].unionByName(ends[1]), by, ["p", "turn", "idx"])
    parts = []
    if include_overlaps:
        parts.append(overlaps(a, b, by, slack).select("idx", "idx2", F.lit(0).cast("long").alias("distance")))
    if way in ("any", "backward"):
        parts.append(_to_one_side(queries.select(*by, "idx", (F.col("start") - slack).alias("pos")), targets, by, k, "end", 1, width))
    if way in ("any", "forward"):
        parts.append(_to_one_side(queries.select(*by, "idx", (F.col("end") - slack).alias("pos")), targets, by, k, "start", -1, width))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    ranked = found.withColumn("r", F.dense_rank().over(Window.partitionBy("idx").orderBy("distance")))
    out = ranked.filter(F.col("r") <= k).select("idx", "idx2", "distance")
    return out.orderBy("idx", "distance", "idx2") if sort_output else out


def _passed(df: DataFrame, by: list[str], pos: Column, at: int, count: str | None, distinct: str | None = None) -> DataFrame:
    """Add how many targets (``turn`` 0), or distinct positions of them, a row has reached; ``at`` 1 counts those at its own ``pos``."""
    order = Window.partitionBy(*by).orderBy("__pos", F.col("turn") if at else -F.col("turn"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    target = F.col("turn") == 0
    out = df.withColumn("__pos", pos)
    if count:
        out = out.withColumn(count, F.count(F.when(target, 1)).over(so_far))
    if distinct:
        earlier = F.max(F.when(target, F.col("__pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = target & (F.col("__earlier").isNull() | (F.col("__earlier") < F.col("__pos")))
        out = out.withColumn("__earlier", earlier).withColumn(distinct, F.count(F.when(fresh, 1)).over(so_far)).drop("__earlier")
    return out.drop("__pos")


def _side_by_side(queries: DataFrame, targets: DataFrame, by: list[str], tasks: int, payload: Sequence[str] = (), payload2: Sequence[str] = ()) -> DataFrame:
    """Queries (``turn`` 1) and targets (``turn`` 0) in one frame, dealt by groups; the rest of their columns in ``row`` and ``row2``."""
    left = queries.select(*by, "idx", "start", "end", F.struct(F.lit(1).alias("turn"), *payload).alias("row"), F.lit(1).alias("turn"))
    right = targets.select(*by, "idx", "start", "end", F.struct(F.lit(0).alias("turn"), *payload2).alias("row2"), F.lit(0).alias("turn"))
    if not payload and not payload2:
        left, right = left.drop("row"), right.drop("row2")
    return deal(left.unionByName(right, allowMissingColumns=True), by, tasks)


def _counted(rows: DataFrame, by: list[str], slack: int) -> DataFrame:
    """Add ``n_overlaps`` to the queries of ``_side_by_side``: targets that start before their end, less those that end by their start."""
    target = F.col("turn") == 0
    rows = _passed(rows, by, F.when(target, F.col("end")).otherwise(F.col("start") - slack), 1, "__closed")
    rows = _passed(rows, by, F.when(target, F.col("start")).otherwise(F.col("end") + slack), 0, "__opened")
    return rows.withColumn("n_overlaps", F.col("__opened") - F.col("__closed")).drop("__opened", "__closed")


_BACK, _AHEAD, _ALONE = -1, -2, -3


def _met(rows: DataFrame, by: list[str], slack: int, levels: Survey | None, sides: Sequence[int] = (), outer: bool = False) -> DataFrame:
    """What queries of ``_side_by_side`` look up, in their tasks: a row for each target found, which is ``other``.

    ``n_overlaps`` says whether a query looks for overlaps, by bins as in ``binned_pairs``; ``sides`` adds the ``__k`` positions
    numbered ``__back`` and before, and those after ``__ahead``. ``kind`` is negative for these. ``outer`` keeps queries without overlap.
    """
    target, low, high = F.col("turn") == 0, F.col("start") - slack, F.col("end") + slack
    low, high = F.when(target, F.col("start")).otherwise(low), F.when(target, F.col("end")).otherwise(high)
    kinds, none = [], F.array().cast("array<int>")
    base = levels.base if levels else 0
    if levels:
        both = [F.array(*[F.lit(x) for x in side if x > base]).cast("array<int>") for side in levels.levels]
        above = F.filter(F.when(target, both[0]).otherwise(both[1]), lambda x: x > F.col("__own"))
        kinds.append(F.when(target | (F.col("n_overlaps") > 0), F.concat(F.array("__own"), above)).otherwise(none))
    if sides:
        kinds.append(F.when(target | (F.col("__k") > 0), F.array(*[F.lit(x) for x in sides])).otherwise(none))
    if outer:
        kinds.append(F.when(~target & (F.col("n_overlaps") == 0), F.array(F.lit(_ALONE))).otherwise(none))
    kind, bin_width = F.col("kind"), F.expr("shiftleft(1L, greatest(kind, 0))")
    first, last = floor_div(low, bin_width), floor_div(high - 1, bin_width)
    last = F.greatest(first, last)
    if sides:
        back, ahead = F.col("__back"), F.col("__ahead")
        first = F.when(kind == _BACK, F.when(target, back).otherwise(F.greatest(back - F.col("__k") + 1, F.lit(1)))).when(kind == _AHEAD, F.when(target, ahead).otherwise(ahead + 1)).otherwise(first)
        last = F.when(kind == _BACK, back).when(kind == _AHEAD, F.when(target, ahead).otherwise(ahead + F.col("__k"))).otherwise(last)
    if outer:
        first, last = (F.when(kind == _ALONE, F.lit(0).cast("long")).otherwise(x) for x in (first, last))
    keyed = rows.withColumn("__own", level_of(low, high, base)).withColumn("kind", F.explode(F.concat(*kinds)))
    keyed = keyed.withColumn("__key", F.explode(F.when(first <= last, F.sequence(first, last))))
    keyed = keyed.drop("__back", "__ahead", "__k", "n_overlaps")
    held = [c for c in ("idx", "start", "end", "__own", "row2") if c in keyed.columns]
    others = F.collect_list(F.when(target, F.struct(*held))).over(Window.partitionBy(*by, "kind", "__key"))
    found = keyed.withColumn("__others", others).filter("turn = 1")
    if outer:
        empty = F.array(F.lit(None).cast(found.schema["__others"].dataType.elementType))
        found = found.withColumn("__others", F.when(kind == _ALONE, empty).otherwise(F.col("__others")))
    found = found.withColumn("other", F.explode("__others")).drop("__others")
    start2, end2 = F.col("other.start"), F.col("other.end")
    once = (kind == F.greatest("__own", "other.__own")) & (F.col("__key") == floor_div(F.greatest(low, start2), bin_width))
    return found.filter((kind < 0) | (once & overlaps_expr("start", "end", start2, end2, slack)))


def _nearest_dealt(queries: DataFrame, targets: DataFrame, by: list[str], slack: int, k: int, include: bool, way: str, tasks: int) -> DataFrame:
    """``nearest`` where groups fit tasks, by one exchange: a query looks up its overlaps, if it has any, and numbers of distinct positions beside it."""
    target, low, ahead = F.col("turn") == 0, F.col("start") - slack, F.col("end") - slack
    levels = survey([(queries, low, F.col("end") + slack), (targets, F.col("start"), F.col("end"))]) if include else None
    rows = _side_by_side(queries, targets, by, tasks)
    rows = _passed(rows, by, F.when(target, F.col("end")).otherwise(low), 1, "__closed", "__back")
    rows = _passed(rows, by, F.when(target, F.col("start")).otherwise(ahead), 0, "__opened", "__ahead")
    if include and slack:
        rows = _passed(rows.drop("__opened"), by, F.when(target, F.col("start")).otherwise(F.col("end") + slack), 0, "__opened")
    rows = rows.withColumn("n_overlaps", F.col("__opened") - F.col("__closed") if include else F.lit(0)).drop("__opened", "__closed")
    rows = rows.withColumn("__k", F.lit(k).cast("long") - (F.col("n_overlaps") > 0).cast("long"))  # overlaps are the first distance
    sides = [side for side, used in ((_BACK, way != "forward"), (_AHEAD, way != "backward")) if used]
    found = _met(rows, by, slack, levels, sides)
    kind = F.col("kind")
    distance = F.when(kind == _BACK, low - F.col("other.end") + 1).when(kind == _AHEAD, F.col("other.start") - ahead + 1).otherwise(0).cast("long")
    found = found.select(*by, "idx", F.col("other.idx").alias("idx2"), distance.alias("distance"))
    if way == "any":
        ranked = found.withColumn("r", F.dense_rank().over(Window.partitionBy(*by, "idx").orderBy("distance")))
        found = ranked.filter(F.col("r") <= k)
    return found.select("idx", "idx2", "distance")


def _to_one_side(queries: DataFrame, targets: DataFrame, by: list[str], k: int, edge: str, sign: int, width: int | Edges | None) -> DataFrame:
    """Targets whose ``edge`` is at the ``k`` nearest distinct positions on one side of ``pos``.

    ``sign`` 1 looks back (edges at or before), -1 ahead. Positions are numbered, a running maximum gives each query
    the number of the nearest one, and numbers are joined: no range join.
    """
    edges = targets.select(*by, (sign * F.col(edge)).alias("p")).distinct()
    turned = queries.select(*by, (sign * F.col("pos")).alias("p"), F.lit(None).cast("long").alias("number"), "idx", F.lit(1).alias("turn"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"idx": F.lit(None).cast("long"), "turn": F.lit(0)})

    if isinstance(width, Edges):  # found on starts: find the edges of what is ordered here
        width = segment_width(placed(edges).unionByName(turned.drop("number")), by, ["p", "turn", "idx"])
    numbered = running(placed(edges), by, ["p", "turn", "idx"], {"number": ("sum", F.lit(1).cast("long"), True)}, width)
    both = numbered.unionByName(turned)
    last = running(both, by, ["p", "turn", "idx"], {"last": ("max", F.col("number"), True)}, width)
    last = last.filter("turn = 1 AND last IS NOT NULL")
    steps = F.sequence(F.greatest(F.col("last") - (k - 1), F.lit(1)), F.col("last"))
    wanted = last.select(*by, F.col("idx"), F.col("p").alias("own"), F.explode(steps).alias("number"))
    at = wanted.join(numbered.select(*by, "p", "number"), [*by, "number"])
    rows = targets.select(*by, F.col("idx").alias("idx2"), (sign * F.col(edge)).alias("p"))
    return at.join(rows, [*by, "p"]).select("idx", "idx2", (F.col("own") - F.col("p") + 1).cast("long").alias("distance"))


def map_to_global(exons: DataFrame, queries: DataFrame, sort_output: bool = False, levels: Survey | None = None) -> DataFrame:
    """Project local queries onto the genome: ``idx, chr, start, end, fwd``, one row per exon touched.

    ``exons``: ``tx, local_start, local_end, chr, genome_start, genome_end, fwd``; ``queries``: ``idx, tx, start,
    end, fwd``. Parts outside all exons vanish.
    """
    tasks = task_count([queries, exons], ["tx"])
    if tasks is not None:
        out = _mapped_dealt(exons, queries, levels, tasks)
        return out.orderBy("idx", "start") if sort_output else out
    local = queries.select("tx", "idx", F.col("start").alias("qs"), F.col("end").alias("qe"), F.col("fwd").alias("q_fwd"))
    local = local.dropna(subset=["tx", "qs", "qe"])
    pieces = exons.dropna(subset=["tx", "local_start", "local_end"]).withColumns({"start2": F.col("local_start"), "end2": F.col("local_end")})
    names = ["idx", "qs", "qe", "q_fwd", "local_start", "local_end", "chr", "genome_start", "genome_end", "fwd"]
    # By bins inside the transcript: one with very many exons and queries does not meet itself in full.
    meets = binned_pairs(local, pieces, ["tx"], F.col("qs"), F.col("qe"), F.lit(True), [F.col(c) for c in names], levels)
    out = _on_genome(meets)
    return out.orderBy("idx", "start") if sort_output else out


def _on_genome(meets: DataFrame) -> DataFrame:
    o1 = F.greatest("qs", "local_start") - F.col("local_start")
    o2 = F.least("qe", "local_end") - F.col("local_start")
    return meets.select(
        "idx",
        "chr",
        F.when(F.col("fwd"), F.col("genome_start") + o1).otherwise(F.col("genome_end") - o2).alias("start"),
        F.when(F.col("fwd"), F.col("genome_start") + o2).otherwise(F.col("genome_end") - o1).alias("end"),
        (F.col("q_fwd") == F.col("fwd")).alias("fwd"),
    )


def _mapped_dealt(exons: DataFrame, queries: DataFrame, levels: Survey | None, tasks: int) -> DataFrame:
    """``map_to_global`` where transcripts fit tasks, by one exchange of both sides."""
    local = _known(queries, ["tx"])
    rest = ["chr", "genome_start", "genome_end", "fwd"]
    pieces = exons.select("tx", F.lit(None).cast("long").alias("idx"), F.col("local_start").alias("start"), F.col("local_end").alias("end"), *rest)
    pieces = _known(pieces, ["tx"])
    found = levels or survey([(x, F.col("start"), F.col("end")) for x in (local, pieces)])
    pairs = _met(_counted(_side_by_side(local, pieces, ["tx"], tasks, ["fwd"], rest), ["tx"], 0), ["tx"], 0, found)
    names = {"qs": "start", "qe": "end", "q_fwd": "row.fwd", "local_start": "other.start", "local_end": "other.end"} | {c: f"other.row2.{c}" for c in rest}
    return _on_genome(pairs.select("idx", *(F.col(c).alias(n) for n, c in names.items())))


def keep_first_by_idx(pairs: DataFrame, order: Sequence[str] = ("idx2",)) -> DataFrame:
    """One pair per ``idx``: the first by ``order``."""
    return _keep_one(pairs, order, F.min_by)


def keep_last_by_idx(pairs: DataFrame, order: Sequence[str] = ("idx2",)) -> DataFrame:
    """One pair per ``idx``: the last by ``order``."""
    return _keep_one(pairs, order, F.max_by)


def _keep_one(pairs: DataFrame, order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in pairs.columns if c != "idx"]
    best = pairs.groupBy("idx").agg(pick(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select("idx", "best.*").select(*pairs.columns)
