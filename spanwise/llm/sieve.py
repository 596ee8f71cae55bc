"""Filters by a bit map of keys, in DataFrame functions: rows that cannot match a key do not move.

The map is built with Spark's own bitmap functions, ``BITS_A_KEY`` bits for each
key, and is broadcast: ``MOST_BITS`` bits, 32 MB, at most. More keys than it is
made for only let more rows pass; what passes is joined exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, MOST_BITS = 32, 1 << 28
#: Bits of a row of the map, as Spark has it.
ROW_BITS = 1 << 15


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sieve")), F.lit(bits).cast("long")) + 1


def marked(df: DataFrame, key: Column, keys: DataFrame, name: str = "__may") -> DataFrame:
    """``df`` with the boolean ``name``, false only where ``key`` is not in column ``key`` of ``keys``, which is read twice. Nulls are keys."""
    bits = max(ROW_BITS, min(MOST_BITS, 1 << max(0, BITS_A_KEY * keys.count() - 1).bit_length()))
    slot = _slot(F.col("key"), bits)
    maps = keys.groupBy(F.bitmap_bucket_number(slot).alias("__sieve")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__map"))
    own = _slot(key, bits)
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col("__sieve"), "left")  # MOST_BITS
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.select(*[df[c] for c in df.columns], hit.alias(name))


def without(df: DataFrame, key: Column, gone: DataFrame, same: Column) -> DataFrame:
    """The rows of ``df`` for which ``same`` holds with no row of ``gone``, a stored frame whose column ``key`` is ``key`` where it does."""
    sieved = marked(df, key, gone)
    rest = sieved.filter("__may").drop("__may").join(gone, same, "left_anti")
    return sieved.filter(~F.col("__may")).drop("__may").unionByName(rest)
