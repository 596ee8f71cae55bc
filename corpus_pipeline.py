"""The corpus pipeline: each stage reads what the one before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last
return the columns of ``docs``. Each result is written as Parquet and read
again, so a stage starts from stored rows and a lost executor costs a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import decontaminate, exact_dedup, minhash, packing, store, tokenizer, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 for toxicity, all rows of them; a null text scores as an empty one, and without
    labels of toxic documents all stay."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (null: empty), the one with the least id; of rows with one id and text, one. A row
    without an id stays only where no row of its text has one."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of shingles of 0.8 or more, the one with the least id; those without words or
    without an id stay, and rows of one id stay or go together."""
    return minhash.keep_one(docs, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited ones included; null and empty texts hold none."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, tokenizer.default_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("best_fit_packing", pack),
]

#: A trained classifier and a tokenizer are no SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before it kept; a stage's own tables go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    began = store.mark()
    for name, stage in STAGES:
        docs = store.write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        store.release(began, keep_last=True)
    return docs
