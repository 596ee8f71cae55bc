"""Exact deduplication with a heavy-hitter split.

Main path: DataFrame functions only. A Misra-Gries summary names every digest
that may hold more than ``support`` of all rows; those are counted exactly
("verified"), at most ``1 / support`` winners are broadcast and joined
map-side, and only the other digests are shuffled, so no task receives a group
larger than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sieve import without
from .store import write_table

WHITESPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """``text`` with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of rows with equal normalised text, the smallest id stays. Defined cases:
    a null text equals an empty one; rows repeated with the same id and text
    are the same document: each is returned, each counts in ``group_size`` and
    each carries the same ``kept``; a row with a null id stays only where every
    row of its group has a null id; an empty table gives an empty result; other
    columns of ``docs``, whatever their names, are not read.
    """
    digests = write_table(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")),
        "exact-digests",
    )
    total = digests.count()
    keyed = digests.select(F.hex("digest").alias("key"))
    # Misra-Gries (one counter per 1/support): a superset of the frequent digests, at most 1/support of them.
    frequent = keyed.stat.freqItems(["key"], support).select(F.explode("key_freqItems").alias("key"))
    frequent = frequent.select(F.unhex("key").alias("digest"))
    # Verified: exact size and owner; what falls under the support goes back to the ordinary path.
    heavy = write_table(
        digests.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter(F.col("group_size") > F.lit(support * total)),
        "exact-heavy",
    )
    won = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select(
        "digest", "doc_id", F.min("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size")
    )
    return won.select("digest", "doc_id", "keep_id", "group_size").unionByName(rest).select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of rows repeated with one id and text, one stays.

    Only rows whose ids are among those that go are dealt by key; the texts of the others stay where they are read. Null
    ids and texts, empty tables and other columns as in ``exact_dedup``.
    """
    found = exact_dedup(docs, id_col, text_col)
    key = [F.col(id_col).alias("key"), F.col("text_sha256").alias("__sha")]
    same = F.col(f"{id_col}").eqNullSafe(F.col("__gone")) & (F.sha2(normalised(F.col(text_col)), 256) == F.col("__sha"))

    def named(other: DataFrame) -> DataFrame:
        return other.withColumn("__gone", F.col("key"))

    gone = named(write_table(found.filter(~F.col("kept")).select(*key).distinct(), "exact-gone"))
    stays = without(docs, F.col(id_col), gone, same)
    twice = named(write_table(found.filter("kept").select(*key).groupBy("key", "__sha").count().filter("count > 1"), "exact-repeated"))
    if twice.isEmpty():
        return stays
    once = docs.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])
    return without(stays, F.col(id_col), twice, same).unionByName(once)
