"""Running aggregates inside groups of any size.

A plain window sorts a whole group in one task. Where a group holds more than
``GROUP_ROWS`` rows, the rows are cut into segments: each segment runs by
itself, what it adds up to is run over the far fewer segments of a group, and
both are put together. Segments are found from a sample of the large groups'
own rows, by the whole ordering and not only by position, so a group that is
crowded into few positions, or into one, is cut like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import floor_div

GROUP_ROWS = 5_000_000
#: Rows of a segment, as an aim, when a group is cut; segments at most; sampled rows for each edge.
SEGMENT_ROWS, MOST_SEGMENTS, SAMPLED = 500_000, 4096, 16


class Edges:
    """Where segments begin, in the ordering of ``order``: an array of structs, in order."""

    def __init__(self, order: Sequence[str], rows: list, kind: str):
        self.order, self.n = list(order), len(rows)
        values = [F.struct(*[F.lit(v).alias(c) for c, v in zip(self.order, r)]) for r in rows]
        self.all = F.array(*values).cast(f"array<{kind}>")
        self.step = max(1, math.isqrt(self.n))
        self.coarse = F.array(*values[:: self.step]).cast(f"array<{kind}>")

    def segment(self) -> Column:
        """How many edges a row has reached: among every few first, then among those between."""
        own = F.struct(*self.order)
        before = (F.size(F.filter(self.coarse, lambda x: x <= own)) - 1) * self.step
        return F.when(before < 0, 0).otherwise(before + F.size(F.filter(F.slice(self.all, before + 1, F.lit(self.step)), lambda x: x <= own)))


def _edges(df: DataFrame, order: Sequence[str], parts: int) -> Edges:
    """The edges of ``parts`` even segments, from rows chosen by their hash: the same ones whenever they are asked for."""
    rows = df.select(*order)
    sample = rows.orderBy(F.xxhash64(*order, F.lit("sample")), *order).limit(SAMPLED * parts).orderBy(*order).collect()  # SAMPLED * MOST_SEGMENTS at most
    picked = [sample[k * len(sample) // parts] for k in range(1, parts)] if sample else []
    distinct = [r for k, r in enumerate(picked) if not k or r != picked[k - 1]]
    return Edges(order, distinct or sample[:1], rows.schema.simpleString())


def segment_width(df: DataFrame, by: Sequence[str], order: Sequence[str] = ("start", "idx"), group_rows: int | None = None) -> Edges | None:
    """Segments of the ordering if some group is too large for one task, else None. Counts rows, a cheap pass."""
    limit = GROUP_ROWS if group_rows is None else group_rows
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit)
    large = sizes.agg(F.sum("__n").alias("n")).first()["n"]
    if not large:
        return None
    parts = min(MOST_SEGMENTS, max(2, -(-large // max(1, min(SEGMENT_ROWS, limit)))))
    return _edges(df.join(sizes, by, "left_semi"), order, parts)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, Column, bool]],
    width: int | Edges | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` inside ``by``.

    ``columns`` maps a name to (``"sum"`` or ``"max"``, expression, whether the row itself
    counts). ``width`` cuts groups into segments: ``Edges``, or so many positions of the first,
    numeric column of ``order``.
    """
    aggregate = {"sum": F.sum, "max": F.max}

    def frame(keys: Sequence[str], inclusive: bool, ordering: Sequence[str]) -> Window:
        return Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    if width is None:
        return df.select("*", *(aggregate[kind](x).over(frame(by, inc, order)).alias(name) for name, (kind, x, inc) in columns.items()))
    cut = df.withColumn("__segment", width.segment() if isinstance(width, Edges) else floor_div(F.col(order[0]), width))
    keys = [*by, "__segment"]
    local = cut.select("*", *(aggregate[kind](x).over(frame(keys, inc, order)).alias(name) for name, (kind, x, inc) in columns.items()))
    totals = cut.groupBy(*keys).agg(*(aggregate[kind](x).alias(f"__all_{name}") for name, (kind, x, _) in columns.items()))
    before = totals.select(
        *keys,
        *(aggregate[kind](F.col(f"__all_{name}")).over(frame(by, False, ["__segment"])).alias(f"__before_{name}") for name, (kind, _, _) in columns.items()),
    )
    joined = local.join(before, keys)

    def both(name: str, kind: str) -> Column:
        here, earlier = F.col(name), F.col(f"__before_{name}")
        if kind == "max":
            return F.greatest(here, earlier)
        return F.when(here.isNull() & earlier.isNull(), None).otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0)))

    return joined.select(*df.columns, *(both(name, kind).alias(name) for name, (kind, _, _) in columns.items()))


def following(df: DataFrame, by: Sequence[str], pos: str, name: str, width: int | Edges | None) -> DataFrame:
    """Add the next greater ``pos`` of the group: a running maximum from the right. ``pos`` must be unique in its group."""
    turned = df.withColumn("__turned", -F.col(pos))
    if isinstance(width, Edges):
        width = segment_width(turned, by, ["__turned"])
    ran = running(turned, by, ["__turned"], {"__next": ("max", F.col("__turned"), False)}, width)
    return ran.select(*df.columns, (-F.col("__next")).alias(name))


def before_groups(groups: DataFrame, by: Sequence[str], value: Column, source: DataFrame, parts: int = 256) -> DataFrame:
    """``by, before`` of one row per group: the sum of ``value`` over all groups that come earlier in order.

    Groups are dealt into ``parts`` ranges at most, found among those of ``source``, a frame with the same groups that
    is cheap to read; only the ranges' totals meet in one place.
    """
    by = list(by)
    rows = groups.select(*by, value.alias("__value")).dropna(subset=by)
    edges = _edges(source.select(*by).dropna().distinct(), by, parts)
    if not edges.n:
        return rows.select(*by, F.col("__value").alias("before"))
    cut = rows.withColumn("__range", edges.segment())
    totals = cut.groupBy("__range").agg(F.sum("__value").alias("__total"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows
    totals = F.broadcast(totals.select("__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__earlier")))  # ``parts`` rows
    local = Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ran = cut.withColumn("__local", F.coalesce(F.sum("__value").over(local), F.lit(0)))
    return ran.join(totals, "__range").select(*by, (F.col("__earlier") + F.col("__local")).alias("before"))
