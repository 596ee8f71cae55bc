"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .line_dedup import line_report
from .minhash import near_duplicates
from .packing import pack_documents
from .sieve import marked
from .store import new_path, write_table
from .substring import remove_repeats
from .suffix_dedup import remove_repeated_bytes
from .token_counts import TokenRollup
from .tokenizer import default_path
from .toxicity import score_documents

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after five batches of changes, the first offered twice.

    All documents come in; those marked toxic are revised (their text trimmed, one signed batch of both versions), the
    revision is taken back, they are withdrawn, and come in again. What is left counts every document as it is.
    """
    tokenizers = {n: default_path(f"{n}.tiktoken") for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    rollup = TokenRollup(spark, new_path(spark, "token-rollup"), tokenizers)
    documents = _table(spark, sf_dir, "documents")
    rollup.commit("documents", documents)
    rollup.commit("documents", documents)  # the same batch again, as after a lost acknowledgement: nothing changes
    toxic = _table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("key")).distinct()
    likely = marked(documents.select("doc_id", "source", "lang", "text"), F.col("doc_id"), toxic).filter("__may")  # few others: texts are not dealt
    toxic = likely.join(toxic, likely["doc_id"] == toxic["key"], "left_semi").select("source", "lang", "text")
    toxic = write_table(toxic, "rollup-toxic")
    trimmed = toxic.withColumn("text", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    plus, minus = (lambda df: df.withColumn("sign", F.lit(1))), (lambda df: df.withColumn("sign", F.lit(-1)))
    rollup.commit("revised", minus(toxic).unionByName(plus(trimmed)), sign_col="sign")
    rollup.commit("taken-back", minus(trimmed).unionByName(plus(toxic)), sign_col="sign")
    rollup.commit("withdrawn", minus(toxic), sign_col="sign")
    rollup.commit("again", plus(toxic), sign_col="sign")
    return rollup.totals()


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("n_factors")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash": op2_minhash,
    "op3_substring": op3_substring,
    "op4_decontaminate": op4_decontaminate,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op2_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) AS p FROM d)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS least FROM d
            UNION
            SELECT b, least FROM reach JOIN links ON a = node WHERE least < b
        )
        SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(least) AS component_id, d.doc_id = min(least) AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON node = d.doc_id GROUP BY d.doc_id
    """,
    "op3_substring": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS key
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM d)
        ), firsts AS (
            SELECT key, min(doc_id) AS owner FROM windows GROUP BY key
        ), gone AS (
            SELECT DISTINCT doc_id, p + i AS q FROM windows JOIN firsts USING (key), range(13) AS r(i) WHERE owner < doc_id
        ), placed AS (
            SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS q FROM d
        ), kept AS (
            SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text
            FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.q = g.q GROUP BY p.doc_id
        )
        SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op10_line_dedup": r"""
        WITH raw AS (
            SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
        ), normal AS (
            SELECT doc_id, no, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw
        ), units AS (
            SELECT doc_id, no - 1 AS k, string_split(line, ' ') AS words, line AS unit FROM normal
        ), lines AS (
            SELECT unit, min({'d': doc_id, 'a': k}) AS place, any_value(words) AS words FROM units WHERE unit <> '' GROUP BY unit
        ), able AS (
            SELECT *, md5(unit) AS whole FROM lines WHERE len(words) >= 8
        ), variants AS (
            SELECT unit, place, i, md5(array_to_string(words[1:i - 1] || words[i + 1:], ' ')) AS key
            FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM able)
        ), near AS (
            SELECT unit, min(best) AS best FROM (
                SELECT unit, min(place) OVER (PARTITION BY key, i) AS best FROM variants
                UNION ALL SELECT v.unit, a.place FROM variants v JOIN able a ON a.whole = v.key
                UNION ALL SELECT a.unit, v.place FROM variants v JOIN able a ON a.whole = v.key
            ) GROUP BY unit
        ), owner AS (
            SELECT l.unit, least(l.place, coalesce(n.best, l.place)) AS owner FROM lines l LEFT JOIN near n ON n.unit = l.unit
        ), gone AS (
            SELECT u.doc_id, u.k FROM units u JOIN owner o ON o.unit = u.unit WHERE {'d': u.doc_id, 'a': u.k} > o.owner
        )
        SELECT c.doc_id, c.n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed
        FROM (SELECT doc_id, count(*) AS n_lines FROM units GROUP BY doc_id) c
        LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS removed FROM gone GROUP BY doc_id) g
        ON g.doc_id = c.doc_id
    """,
}
