"""Equi-joins for range conditions: bins whose width follows each interval's length.

An interval of length up to ``2**l`` has level ``l`` and touches at most two
bins of that width. Two intervals meet at the greater of their levels, in the
bin that holds the later start, so every pair is met exactly once, however
long or short the intervals are, and an interval is copied at most twice for
each level that the other side has.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import floor_div

#: Levels below are one: finer bins than this many positions do not pay.
LEAST_LEVEL = 4
#: A side of so few rows, and of a part so small of the other's, may be broadcast if Spark likes; else both are dealt by bins.
SMALL_ROWS, SMALL_PART = 100_000, 0.05


class Survey(NamedTuple):
    """What joining by bins needs to know of both sides."""

    base: int
    levels: list[list[int]]
    rows: list[int]

    def uneven(self) -> bool:
        return min(self.rows) <= min(SMALL_ROWS, SMALL_PART * max(self.rows))


def level_of(start: Column, end: Column, least: int) -> Column:
    # The number of binary digits of length - 1: exact, where a logarithm of a double is not.
    digits = F.length(F.bin(end - start - 1))
    return F.greatest(F.lit(least), F.when(end - start <= 1, F.lit(0)).otherwise(digits)).cast("int")


def survey(sides: Sequence[tuple[DataFrame, Column, Column]]) -> Survey:
    """A base level, near the mean length, each side's levels from there on, and its rows: one job, 64 rows a side at most."""
    parts = [
        df.select(F.lit(k).alias("side"), level_of(s, e, LEAST_LEVEL).alias("level"), (e - s).alias("length"))
        for k, (df, s, e) in enumerate(sides)
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    rows = union.groupBy("side", "level").agg(F.count("*").alias("n"), F.sum(F.col("length").cast("double")).alias("total")).collect()
    base, counts = LEAST_LEVEL, []
    for k in range(len(sides)):
        own = [r for r in rows if r["side"] == k]
        counts.append(sum(r["n"] for r in own))
        base = max(base, int(sum(r["total"] for r in own) / counts[k]).bit_length() if counts[k] else 0)
    if max([r["level"] for r in rows], default=0) == base + 1:
        base += 1  # one level for all: no copies
    return Survey(base, [sorted({max(base, r["level"]) for r in rows if r["side"] == k}) for k in range(len(sides))], counts)


def binned_pairs(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    low: Column,
    high: Column,
    condition: Column,
    keep: Sequence[Column],
    levels: Survey | None = None,
) -> DataFrame:
    """Pairs of equal ``by`` in which ``[low, high)``, columns of ``a``, overlaps ``[start2, end2)`` of ``b``.

    ``condition`` may narrow the pairs further; ``keep`` is what is returned. ``levels`` is what ``survey`` found for
    both sides, or for frames that these are parts of; without it a job looks at their lengths first, which reads no
    other columns of them.
    """
    low2, high2 = F.col("start2"), F.col("end2")
    found = levels or survey([(a, low, high), (b, low2, high2)])
    base, (levels1, levels2) = found.base, found.levels

    def spread(df: DataFrame, s: Column, e: Column, name: str, others: list[int]) -> DataFrame:
        own = level_of(s, e, base)
        above = [x for x in others if x > base]
        met = df.withColumn(name, own)
        if above:
            more = F.filter(F.array(*[F.lit(x) for x in above]).cast("array<int>"), lambda x: x > own)
            met = met.withColumn("__level", F.explode(F.concat(F.array(own), more)))
        else:
            met = met.withColumn("__level", F.col(name))
        width = F.expr("shiftleft(1L, __level)")
        return met.withColumn("__bin", F.explode(F.sequence(floor_div(s, width), floor_div(e - 1, width))))

    left = spread(a, low, high, "__own", levels2)
    right = spread(b, low2, high2, "__own2", levels1)
    width = F.expr("shiftleft(1L, __level)")
    once = (F.col("__level") == F.greatest("__own", "__own2")) & (F.col("__bin") == floor_div(F.greatest(low, low2), width))
    # Estimated sizes say little here, and a broadcast would leave the join to as many tasks as the other side's files have.
    joined = left.join(right if found.uneven() else right.hint("merge"), [*by, "__level", "__bin"])
    return joined.filter(once & (low < high2) & (low2 < high) & condition).select(*keep)
