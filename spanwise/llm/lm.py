"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed with weights that depend on how
often the context was seen, in buckets of doubling frequency. The weights are
learned by expectation-maximisation on held-out counts: every training token is
scored by counts from which it has itself been deleted.

Counts of the whole corpus are merged by ranges of hash values, one entry per
block and n-gram (see ``blocks``), so neither frequent words nor the size of the
vocabulary meet in one place. What reaches the driver is a histogram over a
fixed grid of quantised estimates, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, BlockTable, answer
from .text import Words, mix

_END, _BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
_PAIR, _ONE = np.uint64(0x9FB21C651E98DF25), np.uint64(1)
#: Steps of the grid for each doubling, and the code of an estimate of zero.
STEPS, NONE = 4, 1023
ROUNDS = 60


class _Tokens:
    """The tokens of a block: lower-cased words of each text and one end."""

    def __init__(self, block: Block, folds: int, held: int):
        words = Words.of(block.texts)
        n = len(block.texts)
        self.sizes = np.diff(words.first) + 1
        self.last = np.cumsum(self.sizes) - 1
        self.first = self.last + 1 - self.sizes
        token = np.full(len(words.starts) + n, _END, dtype=np.uint64)
        inside = np.ones(len(token), dtype=bool)
        inside[self.last] = False
        token[inside] = words.hashes(block.texts, lower=True)
        self.held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == held for i in block.ids], dtype=bool)
        self.train = np.repeat(~self.held, self.sizes)
        self.words, self.word = np.unique(token, return_inverse=True)
        # Distinct pairs by the block's own numbers: exact, and the key of each is hashed once.
        context = np.empty(len(token), dtype=np.int64)
        context[1:] = self.word[:-1]
        context[self.first] = len(self.words)
        self.context = context
        pairs, self.pair = np.unique(context * (len(self.words) + 1) + self.word, return_inverse=True)
        values = np.append(self.words, _BEGIN)
        left, right = values[pairs // (len(self.words) + 1)], values[pairs % (len(self.words) + 1)]
        one = mix(self.words ^ _PAIR) & ~_ONE
        two = mix(mix(left) * _PAIR + right) | _ONE
        keys = np.concatenate([one, two])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self) -> np.ndarray:
        weight = self.train.astype(np.float64)
        one = np.bincount(self.word, weights=weight, minlength=len(self.words))
        two = np.bincount(self.pair, weights=weight)
        return np.concatenate([one, two])[self.order].astype(np.uint64)

    def known(self, given: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of each token's pair, context and word; and of the distinct words that this block speaks for."""
        planes = np.empty((2, len(self.keys)), dtype=np.int64)
        planes[:, self.order] = answer(given, 2).astype(np.int64)
        n = len(self.words)
        one, two, mine = planes[0, :n], planes[0, n:], planes[1, :n]
        begin = one[np.searchsorted(self.words, _END)]  # as many texts begin as end
        return two[self.pair], np.append(one, begin)[self.context], one[self.word], one[mine > 0]


def _totals(group: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The total of each key, and a mark on one of its entries."""
    found = np.zeros((2, len(group)), dtype=np.uint64)
    np.take(np.add.reduceat(values[0], first), group, out=found[0], mode="clip")
    found[1, first] = 1
    return found


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two below."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _code(value: np.ndarray, ok: np.ndarray) -> np.ndarray:
    return np.where(ok, np.rint(STEPS * np.log2(np.where(ok, value, 1))).astype(np.int64) + 512, NONE)


def _histogram(folds: int, held: int):
    """Cells (context bucket, pair estimate, word count) of the training tokens, each deleted from its counts."""

    def run(block: Block, given: list) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(block, folds, held)
        pair, context, word, mine = tokens.known(given[0])
        t = tokens.train
        pair, context, word = pair[t] - 1, context[t] - 1, word[t] - 1
        ok = (pair > 0) & (context > 0)
        cell = (bucket(context) << 20) | (_code(pair / np.maximum(context, 1), ok) << 10) | _code(word, word > 0)
        cells, n = np.unique(cell, return_counts=True)
        # Two cells beyond the grid: training tokens, and distinct training words that this block speaks for.
        cells = np.append(cells, [-1, -2])
        n = np.append(n, [len(pair), int((mine > 0).sum())])
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    return run


def learn_weights(cells: dict[int, int]) -> tuple[np.ndarray, int, int]:
    """Mixture weights (buckets, 3) of pair, word and uniform estimates; training tokens; distinct training words."""
    total, distinct = cells.get(-1, 0), cells.get(-2, 0)
    grid = sorted((c, n) for c, n in cells.items() if c >= 0)
    weights = np.zeros((64, 3))
    weights[:, 2] = 1
    if not grid:
        return weights, total, distinct
    cell, n = (np.array(x, dtype=np.int64) for x in zip(*grid))
    which, two, one = cell >> 20, cell >> 10 & 1023, cell & 1023
    p = np.stack(
        [
            np.where(two == NONE, 0, 2.0 ** ((two - 512) / STEPS)),
            np.where(one == NONE, 0, 2.0 ** ((one - 512) / STEPS) / max(1, total - 1)),
            np.full(len(n), 1 / (distinct + 1)),
        ],
        axis=1,
    )

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(ROUNDS):
            share = p[rows] * w
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            w = (share * n[rows, None]).sum(axis=0) / n[rows].sum()
            w = np.maximum(w, 1e-9)
            w /= w.sum()
        return w

    overall = fit(np.arange(len(n)), np.full(3, 1 / 3))
    weights[:] = overall
    for b in np.unique(which):
        weights[b] = fit(np.flatnonzero(which == b), overall)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # no context seen: nothing to condition on
    return weights, total, distinct


def _score(folds: int, held: int, weights: np.ndarray, total: int, distinct: int):
    def run(block: Block, given: list) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(block, folds, held)
        pair, context, word, _ = tokens.known(given[0])
        w = weights[bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, total) + w[:, 2] / (distinct + 1)
        base = np.log10((word + 1) / (total + distinct + 1))
        at = tokens.first
        columns = [
            pa.array(block.ids, pa.int64()),
            pa.array(tokens.held, pa.bool_()),
            pa.array(tokens.sizes, pa.int64()),
            pa.array(np.add.reduceat((word > 0).astype(np.int64), at), pa.int64()),
            pa.array(np.full(len(at), total), pa.int64()),
            pa.array(np.add.reduceat(base, at), pa.float64()),
            pa.array(np.add.reduceat(np.log10(p), at), pa.float64()),
        ]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model and the base learn from documents whose crc32 of the id modulo
    ``folds`` is not ``held``. Defined cases: a null or empty text is one end
    token; a null id is a training document; repeated rows count and are scored
    each time; with nothing to learn from, all known tokens being none, the
    score is that of the uniform estimate; an empty table gives an empty result;
    other columns are not read.
    """
    table = BlockTable(docs, id_col, text_col)

    def request(block: Block, _: list):
        tokens = _Tokens(block, folds, held)
        return tokens.keys, tokens.counts()

    table.ask("counts", request, _totals)
    cells = table.map(_histogram(folds, held), "cell long, n long", ("counts",)).groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()  # a fixed grid: 64 x 1024 x 1024 cells at most, of which few occur
    weights, total, distinct = learn_weights(dict(zip(found["cell"].to_pylist(), found["n"].to_pylist())))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.map(_score(folds, held, weights, total, distinct), schema, ("counts",))
