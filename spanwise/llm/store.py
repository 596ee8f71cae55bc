"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_named: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where it is unset and all runs in this process, a folder of it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanwise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write_table(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet and return a frame that reads it.

    Unlike an executor-local checkpoint, the files outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, label: str, buckets: int, key: str) -> DataFrame:
    """``df`` written by hash buckets of ``key``: later joins on it need no exchange."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    _named.append((spark, name))
    return spark.table(name)


def mark() -> tuple[int, int]:
    """A point in time, for ``release``."""
    return len(_written), len(_named)


def release(since: tuple[int, int] = (0, 0), keep_last: bool = False) -> None:
    """Delete the tables written by this process after ``since``, but for the last one if it is to stay.

    Call it once results are stored elsewhere, or for a stage whose own result is the last table.
    """
    kept = _written.pop() if keep_last and len(_written) > since[0] else None
    while len(_named) > since[1]:
        spark, name = _named.pop()
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    while len(_written) > since[0]:
        spark, path = _written.pop()
        jvm = spark.sparkContext._jvm
        if jvm is None or spark.sparkContext._jsc is None:
            continue
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if kept:
        _written.append(kept)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the JVM may be gone already
        _written.clear()
        _named.clear()
