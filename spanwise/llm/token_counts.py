"""Token counts as delta-maintained rollups.

A change row carries a sign: +1 inserts a document's counts, -1 takes them
back, and a revision is one row of each. Every batch is reduced to additive
deltas by (source, lang, tokenizer) before it is written, under its own batch
id; a batch that is committed already is not counted again. Totals are sums
over the committed deltas, so batches can come in any order. ``compact`` adds
up what is committed, so that batches do not pile up as files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import giving_back
from .tokenizer import encoder

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
COUNTED = "source string, lang string, tokenizer string, sign int, n_tokens long, n_bytes long"


def _count(tokenizers: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {name: encoder(path) for name, path in tokenizers.items()}
        for batch in batches:
            source, lang, sign = batch.column(0), batch.column(1), batch.column(2)
            texts = [x.as_py() or "" for x in batch.column(3)]
            n_bytes = pa.array([len(x.encode()) for x in texts], pa.int64())
            for name, encode in encoders.items():
                n_tokens = pa.array([len(encode(x)) for x in texts], pa.int64())
                label = pa.array([name] * len(texts), pa.string())
                columns = [source, lang, label, sign, n_tokens, n_bytes]
                yield pa.RecordBatch.from_arrays(columns, names=["source", "lang", "tokenizer", "sign", "n_tokens", "n_bytes"])

    return run


def deltas(changes: DataFrame, tokenizers: dict[str, str], text_col: str = "text", sign_col: str | None = None) -> DataFrame:
    """Additive deltas of signed change rows ``source, lang, text[, sign]``, one row per key.

    ``tokenizers`` maps a tokenizer version to its vocabulary file. Keys are
    summed map-side first, so a source with a third of all rows is no hot spot.
    Defined cases: a null text counts as a document of no tokens; null sources
    and languages are keys of their own; without ``sign_col`` all rows are
    inserts, and a null sign changes nothing; repeated rows count each time; a
    text of any length is counted whole; an empty table gives no deltas; other
    columns are not read.
    """
    sign = F.lit(1) if sign_col is None else F.coalesce(F.col(sign_col), F.lit(0))
    rows = changes.select("source", "lang", sign.cast("int").alias("sign"), F.col(text_col).alias("text"))
    return (
        rows.mapInArrow(giving_back(_count(tokenizers)), COUNTED)
        .groupBy(*KEYS)
        .agg(
            F.sum(F.col("sign").cast("long")).alias("n_docs"),
            F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"),
            F.sum(F.col("sign") * F.col("n_bytes")).alias("n_bytes"),
        )
    )


class TokenRollup:
    """Totals kept as committed delta files under ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, str]):
        self.spark, self.path, self.tokenizers = spark, path.rstrip("/"), tokenizers

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _exists(self, name: str) -> bool:
        fs, target = self._fs(f"{self.path}/{name}")
        return fs.exists(target)

    def _folders(self, kind: str, mark: str) -> list[str]:
        """What follows ``kind=`` in the names of folders that hold ``mark``."""
        fs, root = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}=")]
        return [n for n in found if self._exists(f"{kind}={n}/{mark}")]

    def _snapshots(self) -> list[int]:
        return sorted(int(n) for n in self._folders("snapshot", "_DONE"))

    def _ids(self) -> DataFrame | None:
        """The batches that the latest snapshot holds."""
        numbers = self._snapshots()
        return self.spark.read.schema("batch string").parquet(f"{self.path}/snapshot={numbers[-1]}/ids") if numbers else None

    def _held(self, names: list[str]) -> set[str]:
        """Those of ``names`` that the latest snapshot holds."""
        ids = self._ids() if names else None
        return {r["batch"] for r in ids.filter(F.col("batch").isin(names)).collect()} if ids is not None else set()

    def _open(self) -> list[str]:
        """Committed batches that the latest snapshot does not hold."""
        names = self._folders("batch", "_SUCCESS")
        return sorted(set(names) - self._held(names))

    def committed(self, batch_id: str) -> bool:
        return self._exists(f"batch={batch_id}/_SUCCESS") or batch_id in self._held([batch_id])

    def commit(self, batch_id: str, changes: DataFrame, text_col: str = "text", sign_col: str | None = None) -> bool:
        """Count a batch once. False if ``batch_id`` was committed before; what a failed try left is overwritten.

        One writer at a time: the mark of a commit is looked for and then set, so two drivers must not share a batch id.
        """
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch_id!r}: letters, digits, - and _ only")
        if self.committed(batch_id):
            return False
        found = deltas(changes, self.tokenizers, text_col, sign_col)
        found.repartition(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")  # one row per key
        return True

    def batches(self) -> list[str]:
        """The ids of all committed batches, compacted ones included."""
        ids = self._ids()
        held = [] if ids is None else [r["batch"] for r in ids.collect()]
        return sorted([*held, *self._open()])

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens, n_bytes``; keys whose documents are all gone are left out."""
        paths = [f"{self.path}/snapshot={n}/totals" for n in self._snapshots()[-1:]] + [f"{self.path}/batch={b}" for b in self._open()]
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        summed = self.spark.read.schema(DELTA).parquet(*paths).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return summed.filter(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> bool:
        """Add up all committed batches in one snapshot, which remembers their ids. False if none came since the last one.

        A snapshot counts once its mark is set, so one that failed changes nothing. What it replaces goes with the next
        compaction, and totals that were planned before stay readable until then. One compaction at a time; commits of
        other batches may go on.
        """
        opened, numbers, ids = self._open(), self._snapshots(), self._ids()
        if not opened:
            return False
        replaced = self._held(self._folders("batch", "_SUCCESS"))
        into = f"{self.path}/snapshot={numbers[-1] + 1 if numbers else 0}"
        self.totals().repartition(1).write.mode("overwrite").parquet(f"{into}/totals")  # one row per key
        new = self.spark.createDataFrame([(b,) for b in opened], "batch string")
        (new if ids is None else ids.unionByName(new)).repartition(1).write.mode("overwrite").parquet(f"{into}/ids")
        fs, mark = self._fs(f"{into}/_DONE")
        fs.create(mark, True).close()
        for old in [*(f"batch={b}" for b in replaced), *(f"snapshot={n}" for n in numbers[:-1])]:
            fs, target = self._fs(f"{self.path}/{old}")
            fs.delete(target, True)
        return True
