"""Reference blocks and exact key exchange between them.

Whole-corpus questions of the kind "how often, and where first, does this key
occur?" are asked block by block. A block holds a few megabytes of whole texts
under one id and is written once, bucketed by that id. Each block sends each of
its distinct keys once, packed, to the key's range of hash values; there the
blocks' keys are merged; and one answer per (block, range) goes back, aligned
with what the block sent.

* A key that a third of all rows share is one entry per block, so no range
  grows with a hot key.
* The texts never move: answers are joined to the bucketed table.
* All of it is tables in the shared folder, so lost executors cost a task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import giving_back
from .store import write_bucketed
from .text import Texts

BLOCK_BYTES = 4 << 20
#: Text of a bucket, as an aim: answers of one bucket are held in memory while its blocks pass.
BUCKET_BYTES = 64 << 20
#: Text whose keys meet in one task at most, as an aim for the number of ranges.
RANGE_BYTES = 32 << 20

#: What Spark allows.
MOST_BUCKETS = 100_000

BLOCKS = "block long, n_bytes long, ids array<long>, offsets binary, data binary"
MESSAGE = "block long, range int, keys binary, extra binary"


# Arrays as bytes: byte planes without those that are zero everywhere, which shuffle compression likes.
def pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    used = [k for k in range(8) if planes[k].any()]
    return bytes([sum(1 << k for k in used)]) + b"".join(planes[k].tobytes() for k in used)


def unpack(raw: bytes) -> np.ndarray:
    used = [k for k in range(8) if raw[0] >> k & 1]
    n = (len(raw) - 1) // len(used) if used else 0
    out = np.zeros((n, 8), dtype=np.uint8)
    for j, k in enumerate(used):
        out[:, k] = np.frombuffer(raw, dtype=np.uint8, count=n, offset=1 + j * n)
    return out.reshape(-1).view("<u8")


def pack_n(values: np.ndarray) -> bytes:
    """Like ``pack``, for arrays that may be zero throughout: their length comes first."""
    return len(values).to_bytes(8, "little") + pack(values)


def unpack_n(raw: bytes) -> np.ndarray:
    found = unpack(raw[8:])
    return found if len(found) else np.zeros(int.from_bytes(raw[:8], "little"), dtype=np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_n(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_n(raw), dtype=np.uint64)


@dataclass
class Block:
    """Whole texts with their ids; ``None`` ids stay."""

    block: int
    ids: list
    texts: Texts

    def id_array(self) -> np.ndarray:
        """Ids as numbers; a missing one sorts behind all others."""
        return np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], dtype=np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    count = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), Texts.of(batch.column(1))
        for a, b in texts.parts(BLOCK_BYTES):
            part = texts.part(a, b)
            block = TaskContext.get().partitionId() << 24 | count
            count += 1
            columns = [
                pa.array([block], pa.int64()),
                pa.array([len(part.data)], pa.int64()),
                pa.array([ids[a:b]], pa.list_(pa.int64())),
                pa.array([part.offsets.astype("<i8").tobytes()], pa.binary()),
                pa.array([packer.compress(part.data.tobytes())], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "n_bytes", "ids", "offsets", "data"])


def _buckets(rows: DataFrame) -> int:
    """As many as shuffles have partitions, or more where the files below are larger than so many buckets should be."""
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    n_bytes = sum(n for n in sizes if n < 1 << 60)  # Spark's mark of what it does not know
    return max(at_least, min(-(-n_bytes // BUCKET_BYTES), MOST_BUCKETS))


class BlockTable:
    """The texts of ``docs`` in blocks. Null texts count as empty; each row is in exactly one block."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.buckets = _buckets(rows)
        self.blocks = write_bucketed(rows.mapInArrow(giving_back(_build), BLOCKS), "blocks", self.buckets, "block")
        total = self.blocks.agg(F.sum("n_bytes")).first()[0] or 0
        self.ranges = max(self.buckets, -(-total // RANGE_BYTES))
        self.joined = self.blocks
        self.told: dict[str, DataFrame] = {}

    def map(
        self, run: Callable[[Block, list], Iterator[pa.RecordBatch]], schema: str, answers: tuple[str, ...] = (), of: DataFrame | None = None
    ) -> DataFrame:
        """``run(block, answers)`` on every block, or on those of ``of``; each answer is a list of (range, bytes) in order of ranges."""
        names = ["block", "ids", "offsets", "data", *answers]

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpacker = zstandard.ZstdDecompressor()
            for batch in batches:
                for k in range(batch.num_rows):
                    row = [batch.column(j)[k] for j in range(len(names))]
                    data = np.frombuffer(unpacker.decompress(row[3].as_py()), dtype=np.uint8)
                    texts = Texts(data, np.frombuffer(row[2].as_py(), dtype="<i8"))
                    given = [sorted((x["range"], x["data"]) for x in (r.as_py() or [])) for r in row[4:]]
                    yield from run(Block(row[0].as_py(), row[1].as_py(), texts), given)

        return (self.joined if of is None else of).select(*names).mapInArrow(giving_back(over), schema)

    def ask(
        self,
        name: str,
        request: Callable[[Block, list], tuple[np.ndarray, np.ndarray | None]],
        merge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
        answers: tuple[str, ...] = (),
        key_bits: int = 64,
        planes: int = 1,
    ) -> None:
        """Add the answer column ``name``.

        ``request`` gives a block's distinct keys in order and ``planes`` arrays of values.
        ``merge(group, first, values)`` sees the keys of one range: ``group`` numbers equal keys,
        ``first`` is where each group begins, ``values`` is (planes, n) in order of keys; it returns
        the answer for each entry (planes_out, n). Key, value and answer are exact 64-bit numbers.
        """
        n = self.ranges
        shift = np.uint64(64 - key_bits)

        def send(block: Block, given: list) -> Iterator[pa.RecordBatch]:
            keys, values = request(block, given)
            values = np.asarray(values, dtype=np.uint64).reshape(planes, len(keys))
            edges = range_edges(keys, n)
            rows = np.flatnonzero(edges[:-1] < edges[1:]).tolist()  # a message carries a key at least: no more of them than keys
            columns = [
                pa.array([block.block] * len(rows), pa.int64()),
                pa.array(rows, pa.int32()),
                pa.array([pack_sorted(keys[edges[r] : edges[r + 1]] >> shift) for r in rows], pa.binary()),
                pa.array([pack_n(values[:, edges[r] : edges[r + 1]].reshape(-1)) for r in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "range", "keys", "extra"])

        def gather(table: pa.Table) -> pa.Table:
            blocks = np.asarray(table["block"])
            parts = [unpack_sorted(x.as_py()) for x in table["keys"]]
            sizes = np.array([len(p) for p in parts])
            keys = np.concatenate(parts)
            del parts
            values = np.concatenate([unpack_n(x.as_py()).reshape(planes, m) for x, m in zip(table["extra"], sizes)], axis=1)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.append(True, keys[1:] != keys[:-1])
            del keys  # what is not held while the range is merged leaves room for a larger one
            group, first = np.cumsum(new), np.flatnonzero(new)
            group -= 1
            values = values[:, order]
            found = merge(group, first, values)
            del group, first, values, new
            back = np.empty_like(found)
            back[:, order] = found
            ends = np.cumsum(sizes)
            data = [pack_n(back[:, e - m : e].reshape(-1)) for e, m in zip(ends, sizes)]
            return pa.table({"block": pa.array(blocks, pa.int64()), "range": table["range"], "data": pa.array(data, pa.binary())})

        self._exchange(name, self.map(send, MESSAGE, answers), gather)

    def exchange(self, name: str, send: Callable, gather: Callable[[pa.Table], pa.Table], answers: tuple[str, ...] = ()) -> None:
        """Add the answer column ``name`` by messages ``(block, range, data)`` of a form of its own.

        ``gather`` sees the messages of one range and returns as many answers ``(block, range, data)``.
        """
        self._exchange(name, self.map(send, "block long, range int, data binary", answers), gather)

    def _exchange(self, name: str, sent: DataFrame, gather: Callable[[pa.Table], pa.Table]) -> None:
        self.attach(name, sent.groupBy("range").applyInArrow(giving_back(gather), "block long, range int, data binary"))

    def attach(self, name: str, rows: DataFrame) -> None:
        """Add the answer column ``name`` from rows ``(block, range, data)``, which are no more than a block's own text calls for."""
        told = rows.groupBy("block").agg(F.collect_list(F.struct("range", "data")).alias(name))
        told = write_bucketed(told, "answers", self.buckets, "block")
        self.told[name] = told
        self.joined = self.joined.join(told.hint("shuffle_hash"), "block", "left")

    def any_answer(self, name: str, holds: Callable[[np.ndarray], bool]) -> bool:
        """Whether ``holds`` is true of any answer ``name``; reads no text."""

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = any(holds(unpack_n(x["data"])) for b in batches for row in b.column(0).to_pylist() for x in row)
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.bool_())], names=["found"])

        return bool(self.told[name].select(name).mapInArrow(look, "found boolean").agg(F.max("found")).first()[0])


@functools.lru_cache(maxsize=4)
def _range_starts(n: int) -> np.ndarray:
    return np.array([-(-(r << 64) // n) for r in range(n)], dtype=np.uint64)


def range_edges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of hash values begins in ordered ``keys``."""
    return np.append(np.searchsorted(keys, _range_starts(n)), len(keys))


def answer(given: list, planes: int = 1) -> np.ndarray:
    """A block's answer as (planes, keys) in the order of the keys that it sent."""
    parts = [unpack_n(raw).reshape(planes, -1) for _, raw in given]
    return np.concatenate(parts, axis=1) if parts else np.empty((planes, 0), dtype=np.uint64)


def summed(group: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The total of each key."""
    return np.add.reduceat(values, first, axis=1)[:, group]
