"""Frames of intervals: columns ``idx``, group columns, ``start``, ``end`` and optionally ``fwd``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The schema of an interval frame with one group column.
SCHEMA = T.StructType(
    [
        T.StructField("idx", T.LongType(), False),
        T.StructField("grp", T.LongType(), False),
        T.StructField("start", T.LongType(), False),
        T.StructField("end", T.LongType(), False),
        T.StructField("fwd", T.BooleanType(), True),
    ]
)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_intervals(
    df: DataFrame,
    idx: Column | str,
    start: Column | str,
    end: Column | str,
    by: dict[str, Column | str] | Column | str | None = None,
    strand: Column | str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Interval frame of any frame. ``idx`` must be a unique row id: ties are settled by it.

    ``by`` gives the group columns (one, named ``grp``, or several by name; none puts all rows
    into one group); ``strand`` is a condition that is true of forward rows.
    """
    groups = by if isinstance(by, dict) else {"grp": by if by is not None else F.lit(0).cast("long")}
    columns = [_column(idx).cast("long").alias("idx"), *(_column(c).alias(n) for n, c in groups.items())]
    columns += [_column(start).cast("long").alias("start"), _column(end).cast("long").alias("end")]
    if strand is not None:
        columns.append(_column(strand).cast("boolean").alias("fwd"))
    return df.select(*columns, *keep)


def validate_intervals(df: DataFrame, mode: str = "raise", by: Sequence[str] = ("grp",), slack: int = 0) -> DataFrame:
    """Reject rows with nulls or without length (with ``slack``, ``end + slack > start`` must hold too).

    ``mode="raise"`` fails when such a row is met, at execution; ``"drop"`` leaves them out.
    """
    if mode not in ("raise", "drop"):
        raise ValueError(f"mode {mode!r}: raise or drop")
    good = (F.col("start") < F.col("end")) & (F.col("end") + slack > F.col("start"))
    for c in ("idx", *by):
        good = good & F.col(c).isNotNull()
    good = F.coalesce(good, F.lit(False))
    if mode == "drop":
        return df.filter(good)
    return df.filter(F.when(good, True).otherwise(F.raise_error(F.lit("interval with a null or without length")).cast("boolean")))


def read_intervals(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """A stored frame in any format that Spark reads; map its columns with ``as_intervals``."""
    reader = spark.read.options(**options)
    return reader.load(path, format=format)


def write_intervals(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    writer = df.write.mode(mode).format(format)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
