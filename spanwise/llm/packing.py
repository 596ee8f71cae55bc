"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces are dealt evenly over partitions, each of which packs its share by
best-fit decreasing. Bins that are nearly full are done; underfull bins become
the items of the next, narrower round, until one task has seen all that is
left or a round closes no more gaps. A task never holds more than
``items_per_task`` items, so nothing unbounded meets in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import giving_back
from .store import write_table
from .tokenizer import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "item long, size long, bin long, offset long, bin_size long"


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all full but the first, which takes the remainder."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    starts = [0, *range(first, n_tokens, capacity)]
    return list(zip(starts, [first] + [capacity] * (len(starts) - 1)))


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    row = (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    for column, value in zip(out, row):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, and the fill of each bin.

    Open bins are kept by what room they have; a bit for each room that occurs
    finds the tightest one that fits.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b = len(fill)
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        left = capacity - fill[b]
        by_room[left].append(b)
        rooms |= 1 << left
    return bins, offsets, fill


def _pack_round(level: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pydict({"item": [], "size": []})])
        items = np.asarray(table["item"], dtype=np.int64)
        sizes = np.asarray(table["size"], dtype=np.int64)
        order = np.argsort(items, kind="stable")  # the same bins whatever order the rows came in
        items, sizes = items[order], sizes[order]
        bins, offsets, fill = best_fit(sizes, capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        full = np.asarray(fill, dtype=np.int64)
        columns = [items, sizes, bins + base, offsets, full[bins] if len(bins) else bins]
        names = ["item", "size", "bin", "offset", "bin_size"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def pack_items(items: DataFrame, capacity: int, slack: int = 8, items_per_task: int = 16384) -> DataFrame:
    """Pack ``(item, size)`` rows with unique ids into bins: ``item, sequence_id, offset``.

    Bins with at most ``slack`` free places are nearly full and leave at once.
    """
    rounds: list[DataFrame] = []
    count, level = items.count(), 1
    while True:
        tasks = max(1, -(-count // items_per_task))
        # Round robin deals evenly whatever the ids are; Spark sorts before it, so a retried task gets the same rows.
        packed = write_table(items.repartition(tasks).mapInArrow(_pack_round(level, capacity), PACKED), f"pack-{level}")
        rounds.append(packed)
        under = packed.filter(F.col("bin_size") < capacity - slack).groupBy("bin").agg(F.first("bin_size").alias("size"))
        left = under.count()
        # More rounds only while several tasks hold gaps that could meet, and while rounds still close some.
        if tasks == 1 or left <= 1 or (level > 1 and left > 0.98 * count):
            break
        items, count, level = under.select(F.col("bin").alias("item"), "size"), left, level + 1
    result = rounds[0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for packed in rounds[1:]:
        outer = packed.select(F.col("item").alias("sequence_id"), F.col("bin").alias("outer"), F.col("offset").alias("shift"))
        result = result.join(outer, "sequence_id", "left").select(
            "item",
            F.coalesce("outer", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    return result


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and one end id; only longer ones than
    ``capacity`` are cut. Defined cases: a null or empty text is its end id
    alone; repeated rows are packed as often as they occur; an empty table gives
    an empty result; a null id is kept; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = write_table(source.mapInArrow(giving_back(_pieces(tokenizer_path, capacity, end_id)), PIECES), "pack-pieces")
    # The written files fix the rows, so this id is the same each time it is read; it is kept with the piece.
    numbered = write_table(pieces.withColumn("item", F.monotonically_increasing_id()), "pack-numbered")
    packed = pack_items(numbered.select("item", F.col("length").alias("size")), capacity)
    return numbered.join(packed, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
