"""Whole groups dealt to tasks once, for what follows to stay in its task.

Where no group is a large part of the rows, an exchange by groups alone serves
every window and grouping whose keys contain the groups: rows are copied into
bins after it and never travel again. Joins would be dealt anew by all of their
keys, so both sides lie in one frame and meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group of so few rows never counts as large; one of more must be under this part of all rows, and under ``MOST_ROWS``.
FEW_ROWS, LARGE_PART, MOST_ROWS = 20_000, 64, 200_000
#: Rows of a task, as an aim; up to so many tasks, the session's number of partitions and what it makes of them will do.
TASK_ROWS, FEW_TASKS = 200_000, 16


def task_count(sides: Sequence[DataFrame], by: Sequence[str]) -> int | None:
    """Tasks to deal ``sides`` to by groups, or None where groups are too large for that. One job, which reads the groups alone."""
    if any(df.isStreaming for df in sides):
        return None
    rows = sides[0].select(*by)
    for df in sides[1:]:
        rows = rows.unionByName(df.select(*by))
    sizes = rows.dropna().groupBy(*by).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    most, total = found["most"] or 0, found["total"] or 0
    if most > max(FEW_ROWS, min(MOST_ROWS, total // LARGE_PART)):
        return None
    return max(1, -(-total // TASK_ROWS))


def deal(df: DataFrame, by: Sequence[str], tasks: int) -> DataFrame:
    """``df`` by groups. Rows with a null group meet in one task: leave them out before."""
    return df.repartition(tasks, *by) if tasks > FEW_TASKS else df.repartition(*by)
