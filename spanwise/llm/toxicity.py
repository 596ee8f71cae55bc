"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers in numpy are trained from confirmed toxic texts and
unlabelled ones. With class prior p, the risk is
``p R+(pos) + max(0, R-(unl) - p R-(pos))``: the second term corrects the
unlabelled risk for the positives hidden among it, and where it would turn
negative, its gradient is taken back instead, as in Kiryo et al. (2017).

Training reads a bounded sample; scoring reads every byte of every text and is
a column expression, so it moves no text between executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import give_back, giving_back
from .store import write_table
from .text import IS_WORD, LOWER, Rolling, Texts, byte_values

#: Byte n-grams that cross word edges, so that the start and the end of a word count.
WIDTHS = (4, 6, 8)
TABLE_BITS = 20
#: Bytes of text that are looked at together: their n-grams take a hundred times as much for a moment.
PART_BYTES = 1 << 19
#: Bounds of the training sample and of the features kept, unless ``train`` is told others.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 3000, 9000, 4096

_PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", dtype=np.uint8)
#: Lower case; white space and ASCII punctuation become one blank.
_FOLD = LOWER.copy()
_FOLD[~IS_WORD] = 0x20
_FOLD[_PUNCTUATION] = 0x20


def features(texts: Texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of each text's distinct hashed n-grams, in order; only slots flagged in ``wanted``."""
    n = len(texts)
    # A blank on both sides of each text: its first and last words have edges, and no n-gram crosses texts.
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(texts.offsets))
    data = np.full(len(texts.data) + 2 * n, 0x20, dtype=np.uint8)
    data[np.arange(len(texts.data)) + shift] = _FOLD[texts.data]
    offsets = texts.offsets + 2 * np.arange(n + 1)
    rolling = Rolling(byte_values(data))
    pairs = [np.empty(0, np.uint64)]
    for width in WIDTHS:
        slots = rolling.windows(width) >> np.uint64(64 - TABLE_BITS)
        at = np.flatnonzero(wanted[slots]) if wanted is not None else np.arange(len(slots))
        owner = np.searchsorted(offsets, at, "right") - 1 if wanted is not None else np.repeat(np.arange(n), np.diff(offsets))[: len(at)]
        whole = at + width <= offsets[owner + 1]
        pairs.append((owner[whole].astype(np.uint64) << np.uint64(TABLE_BITS)) | slots[at[whole]])
    keys = np.concatenate(pairs)
    if n <= 1 << (32 - TABLE_BITS):
        keys = keys.astype(np.uint32)  # sorts faster
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    keys = keys.astype(np.int64)
    return keys >> TABLE_BITS, keys & ((1 << TABLE_BITS) - 1)


@dataclass
class Model:
    """Weights by table slot (0 where unused) of several classifiers, whose mean score counts."""

    slots: np.ndarray
    weights: np.ndarray  # classifiers x slots
    bias: np.ndarray

    def scores(self, texts: Texts) -> np.ndarray:
        lookup = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        lookup[self.slots] = np.arange(len(self.slots))
        wanted = lookup >= 0
        out = np.empty(len(texts))
        for a, b in texts.parts(PART_BYTES):
            owner, slot = features(texts.part(a, b), wanted)
            column = lookup[slot]
            total = np.zeros(b - a)
            for w, c in zip(self.weights, self.bias):
                z = c + np.bincount(owner, weights=w[column], minlength=b - a)
                total += 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            out[a:b] = total / len(self.weights)
        return out


class _Sparse:
    """Rows of column numbers whose values are all 1."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.columns = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=w[self.columns], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=g[self.owner], minlength=self.width)


def nnpu_fit(pos: _Sparse, unl: _Sparse, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 4e-3):
    """Adam on the non-negative risk with the logistic loss; returns weights and bias."""
    w = np.zeros(pos.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        zp, zu = pos.dot(w[:-1]) + w[-1], unl.dot(w[:-1]) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp = prior * (sp - 1) / pos.n
        gn_p, gn_u = -prior * sp / pos.n, su / unl.n
        if negative >= 0:
            gp, gu = gp + gn_p, gn_u
        else:  # the corrected risk of the negatives overfits: step back on it alone
            gp, gu = -gn_p, -gn_u
        grad = np.append(pos.back(gp) + unl.back(gu), gp.sum() + gu.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], w[-1]


def _rows(column: pa.Array) -> list[np.ndarray]:
    texts = Texts.of(column)
    owner, slot = features(texts)
    return np.split(slot, np.searchsorted(owner, np.arange(1, len(texts))))


def _document_counts(batches):
    """Per task, in how many texts of each class a slot occurs: every slot that does, as sums over tasks decide; 2**20 rows at most."""
    counts = np.zeros((2, 1 << TABLE_BITS), dtype=np.int32)
    for batch in batches:
        positive = np.asarray(batch.column(1))
        texts = Texts.of(batch.column(0))
        for a, b in texts.parts(PART_BYTES):
            owner, slot = features(texts.part(a, b))
            for k in (0, 1):
                np.add.at(counts[k], slot[positive[a:b][owner] == k], 1)
    slots = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(slots, pa.int64()), pa.array(counts[0, slots], pa.int64()), pa.array(counts[1, slots], pa.int64())],
        names=["slot", "unlabelled", "positive"],
    )


def _selected(slots: np.ndarray):
    def run(batches):
        lookup = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        lookup[slots] = np.arange(len(slots))
        wanted = lookup >= 0
        for batch in batches:
            texts = Texts.of(batch.column(0))
            for a, b in texts.parts(PART_BYTES):
                owner, slot = features(texts.part(a, b), wanted)
                rows = np.split(lookup[slot], np.searchsorted(owner, np.arange(1, b - a)))
                columns = pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), columns], names=["positive", "columns"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    classifiers: int = 3,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
) -> Model | None:
    """Fit on the rows of ``docs`` for which the column expression ``usable(id)`` holds; None without positives.

    At most ``max_positive`` confirmed texts and about ``max_unlabelled`` others are read, chosen by a hash of
    their ids; at most ``max_features`` slots are kept. The class prior is the rate of toxic rows among the
    usable labels.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("toxicity"), F.col("id"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("toxic").isNotNull()).filter(usable(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))  # rows repeated, or at odds
    known = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not known["n"] or not known["p"]:
        return None
    prior = min(max(known["p"] / known["n"], 0.001), 0.9)
    chosen = marks.filter("toxic = 1").orderBy(order, "id").limit(max_positive).select("id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(usable(F.col("id")))
    share = min(1.0, max_unlabelled / max(1, texts.select("id").count()))
    sampled = F.pmod(F.xxhash64(F.lit("unlabelled"), F.col("id")), F.lit(1 << 20)) < int(share * (1 << 20))
    picked = texts.join(F.broadcast(chosen.withColumn("positive", F.lit(1))), "id", "left")  # max_positive rows at most
    picked = picked.filter(F.col("positive").isNotNull() | sampled)
    # A text in both roles counts in both: the unlabelled sample is drawn from all usable texts.
    roles = F.when(F.col("positive").isNull(), F.array(F.lit(0))).when(sampled, F.array(F.lit(0), F.lit(1)))
    sample = write_table(picked.select("text", F.explode(roles.otherwise(F.array(F.lit(1)))).alias("positive")), "toxicity-sample")
    n_pos = sample.filter("positive = 1").count()
    n_unl = sample.filter("positive = 0").count()
    if not n_pos or not n_unl:
        return None
    # Where a slot is likelier in positives than among all texts, by at least a few standard errors.
    counted = sample.mapInArrow(giving_back(_document_counts), "slot long, unlabelled long, positive long")
    counted = counted.groupBy("slot").agg(F.sum("unlabelled").alias("u"), F.sum("positive").alias("p"))
    rate_p, rate_u = F.col("p") / n_pos, (F.col("u") + 0.5) / (n_unl + 1)
    gain = (rate_p - rate_u) / F.sqrt(rate_u * (1 - F.least(rate_u, F.lit(0.999))) / n_pos + 1e-9)
    best = counted.select("slot", "p", gain.alias("gain")).filter((F.col("gain") >= 5) & (F.col("p") >= 3))
    slots = np.sort(np.array([r["slot"] for r in best.orderBy(F.col("gain").desc(), "slot").limit(max_features).collect()], dtype=np.int64))
    rows = sample.mapInArrow(giving_back(_selected(slots)), "positive int, columns binary").toArrow()
    positive = np.asarray(rows["positive"])
    vectors = [np.frombuffer(x.as_py(), dtype=np.int32) for x in rows["columns"]]
    # Sorted, so that the fit does not depend on the order in which tasks end.
    pos = sorted((v for v, k in zip(vectors, positive) if k == 1), key=lambda v: v.tobytes())
    unl = sorted((v for v, k in zip(vectors, positive) if k == 0), key=lambda v: v.tobytes())
    weights, bias = [], []
    rng = np.random.default_rng(7)
    for _ in range(classifiers):
        part = [unl[k] for k in rng.permutation(len(unl))[: max(1, (2 * len(unl) + 2) // 3)]]
        w, c = nnpu_fit(_Sparse(pos, len(slots)), _Sparse(part, len(slots)), prior)
        weights.append(w)
        bias.append(c)
    return Model(slots, np.array(weights), np.array(bias))


def scorer(spark: SparkSession, model: Model | None):
    """A column function ``text -> score``; without a model, every text scores 0."""
    if model is None:
        return lambda text: F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)  # MAX_FEATURES weights, whatever the corpus

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        found = pa.array(shared.value.scores(Texts.of(text)), pa.float64())
        give_back()
        return found

    return lambda text: score(text)


def fold(id_column, folds: int = 4):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    held: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    **bounds: int,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels are learnt only where crc32 of the id, modulo 4, is not ``held``.
    Defined cases: a null text scores as an empty one; without usable toxic
    labels all scores are 0; repeated rows score alike; a null id is not held
    out and matches no label; other columns are not read. ``bounds`` are those
    of the training sample (see ``train``).
    """
    model = train(docs, labels, lambda i: fold(i) != held, id_col, text_col, label_col, **bounds)
    score = scorer(docs.sparkSession, model)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == held).alias("held_out"), score(F.col(text_col)).alias("score")
    )
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held: int = 2, **bounds: int) -> DataFrame:
    """The documents that score under ``threshold``, all their columns; cases as in ``score_documents``."""
    model = train(docs, labels, lambda i: fold(i) != held, **bounds)
    return docs.filter(scorer(docs.sparkSession, model)(F.col("text")) < threshold)
