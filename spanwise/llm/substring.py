"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is cut into reference blocks, whose windows of ``width`` words are
indexed by hash. Every document is parsed greedily, left to right, relative to
them: where the index names an earlier place for the window at hand, the words
of that place are brought over and the factor goes on for as long as they are
the document's own words, compared word by word. Where a factor ends, the
windows across its edge are looked up and may open the next one, so that where
one reference ends and another begins nothing is missed. What factors of at
least ``width`` words cover is removed, and nothing else.

Exchanges: the first tells which sampled shingles (the least hash of those
inside a window) occur in several documents, and windows without such a shingle
are settled; the second asks the index for the first place of each remaining
window. Then the reference blocks hand out pages of ``PAGE`` words: each page
that anyone asked for is cut once, however many ask for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, BlockTable, answer, summed
from .store import write_bucketed
from .text import Rolling, Words, mix, ranges, window_counts

SHINGLE = 6
#: Words of a page of a reference block.
PAGE = 32
RUNS = "block long, runs binary, pages array<struct<no:int,ref:long,page:int>>"


class _Parse:
    """The words and windows of a block."""

    def __init__(self, block: Block, width: int):
        self.block, self.width = block, width
        self.words = Words.of(block.texts)
        rolling = Rolling(self.words.hashes(block.texts, lower=False))
        counts = window_counts(self.words.first, width)
        #: The first word of every window that lies in one document, and its document.
        self.at = ranges(self.words.first[:-1], counts)
        self.doc = np.repeat(np.arange(len(block.texts)), counts)
        self.rolling = rolling

    def sampled(self) -> np.ndarray:
        """For each window, the least hash of the shingles inside; equal windows sample alike."""
        q = min(SHINGLE, self.width)
        least, have, want = self.rolling.windows(q), 1, self.width - q + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            have += step
        return mix(least[self.at])

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        return self.rolling.spans(self.at[chosen], self.at[chosen] + self.width)


def _distinct_docs(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and in how many documents each occurs (2 stands for more)."""
    if not len(keys):
        return keys, keys
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    return keys[first], 1 + several.astype(np.uint64)


def _shared(group: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (summed(group, first, values) >= 2).astype(np.uint64)


def _first_place(group: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Least (document, block, word) of each key, as its values are; the entry that is the first itself gets zeros."""
    order = np.lexsort((values[2], values[1], values[0], group))
    found = values[:, order][:, first][:, group]
    found[:, order[first]] = 0  # packs to little, and the block knows the place
    return found


def _candidates(parse: _Parse, shared: list) -> np.ndarray:
    keys = parse.sampled()
    distinct = np.unique(keys)
    flags = answer(shared)[0].astype(bool)
    return np.flatnonzero(flags[np.searchsorted(distinct, keys)]) if len(keys) else np.empty(0, np.int64)


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers in the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def _lookups(parse: _Parse, chosen: np.ndarray):
    """The distinct hashes of chosen windows, each with its first place in the block (document, block, word + 1); and each window's own hash and document."""
    hashes = parse.windows(chosen)
    ids = _unsigned(parse.block.id_array())[parse.doc[chosen]]
    word = parse.at[chosen].astype(np.uint64) + np.uint64(1)
    order = np.lexsort((word, ids, hashes))
    sorted_hashes = hashes[order]
    first = order[np.append(True, sorted_hashes[1:] != sorted_hashes[:-1])] if len(order) else order
    return hashes[first], np.array([ids[first], np.full(len(first), parse.block.block, np.uint64), word[first]]), hashes, ids


def _claims(width: int):
    """For each block, the stretches that the index places in earlier documents, and the pages to compare them with.

    A stretch (document, first word, words, first page asked for, first word in it) is a row of consecutive windows
    whose places are consecutive words of one block.
    """

    def run(block: Block, given: list) -> Iterator[pa.RecordBatch]:
        parse = _Parse(block, width)
        chosen = _candidates(parse, given[0])
        keys, own_places, hashes, ids = _lookups(parse, chosen)
        places = answer(given[1], 3)
        places = np.where(places[2] == 0, own_places, places)[:, np.searchsorted(keys, hashes)]
        earlier = places[0] < ids  # only what a document with a smaller id holds
        start, doc = parse.at[chosen][earlier], parse.doc[chosen][earlier]
        ref, word = places[1][earlier].astype(np.int64), places[2][earlier].astype(np.int64) - 1
        goes_on = (np.diff(start) == 1) & (np.diff(doc) == 0) & (np.diff(ref) == 0) & (np.diff(word) == 1)
        first = np.flatnonzero(np.append(True, ~goes_on)) if len(start) else np.empty(0, np.int64)
        size = np.append(first[1:], len(start))[: len(first)] - first - 1 + width
        start, doc, ref, word = start[first], doc[first], ref[first], word[first]
        low, high = word // PAGE, (word + size - 1) // PAGE
        each = high - low + 1
        pages = np.stack([np.repeat(ref, each), ranges(low, each)], axis=1)
        pages, own = np.unique(pages, axis=0, return_inverse=True) if len(pages) else (pages, np.empty(0, np.int64))
        # Pages of one reference are numbered in order, so those of a stretch follow each other.
        at = own.reshape(-1)[np.cumsum(each) - each] if len(each) else own
        rows = np.stack([doc, start, size, at, word - low * PAGE]).astype("<i8")
        wanted = [{"no": k, "ref": r, "page": p} for k, (r, p) in enumerate(pages.tolist())]
        columns = [pa.array([block.block], pa.int64()), pa.array([rows.tobytes()], pa.binary())]
        columns.append(pa.array([wanted], pa.list_(pa.struct([("no", pa.int32()), ("ref", pa.int64()), ("page", pa.int32())]))))
        yield pa.RecordBatch.from_arrays(columns, names=["block", "runs", "pages"])

    return run


def _cut_pages(block: Block, given: list) -> Iterator[pa.RecordBatch]:
    """The words of each page asked for, joined by blanks."""
    words = Words.of(block.texts)
    data = block.texts.data.tobytes()
    starts, ends = words.starts.tolist(), words.ends.tolist()
    asked = [p for p, _ in given[0]]
    cut = [b" ".join([data[s:e] for s, e in zip(starts[p * PAGE : (p + 1) * PAGE], ends[p * PAGE : (p + 1) * PAGE])]) for p in asked]
    columns = [pa.array([block.block] * len(asked), pa.int64()), pa.array(asked, pa.int32()), pa.array(cut, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["ref", "page", "data"])


def same_words(own: list[bytes], other: list[bytes], at: int) -> int:
    """How many words of ``own`` from ``at`` on are those of ``other``."""
    n = min(len(own), len(other)) - at
    if own[at : at + n] == other[at : at + n]:
        return n
    return next(k for k in range(n) if own[at + k] != other[at + k])


def factors(own: list[bytes], reference: list[bytes], width: int) -> Iterator[tuple[int, int]]:
    """Greedy factors (first word, words) of ``own`` relative to ``reference``, whose words stand at the same places.

    A factor goes on until a word differs; factors under ``width`` words are none.
    """
    at = 0
    while at + width <= len(own):
        n = same_words(own, reference, at)
        if n >= width:
            yield at, n
        at += n + 1


def _finish(width: int):
    def run(block: Block, given: list) -> Iterator[pa.RecordBatch]:
        words = Words.of(block.texts)
        data = block.texts.data.tobytes()
        starts, ends = words.starts.tolist(), words.ends.tolist()
        n = len(starts)
        change = np.zeros(n + 1, dtype=np.int64)
        n_factors = [0] * len(block.texts)
        pages = [raw.split(b" ") for _, raw in given[1]]
        stretches = np.frombuffer(given[0][0][1], dtype="<i8").reshape(5, -1).T.tolist()
        for doc, start, size, page, skip in stretches:
            own = [data[s:e] for s, e in zip(starts[start : start + size], ends[start : start + size])]
            reference: list[bytes] = []
            while len(reference) < skip + size:
                reference += pages[page]
                page += 1
            for at, length in factors(own, reference[skip : skip + size], width):
                change[start + at] += 1
                change[start + at + length] -= 1
                n_factors[doc] += 1
        gone = np.cumsum(change[:n]) > 0
        sums = np.append(0, np.cumsum(gone))
        first = words.first
        n_words, n_removed, digest = [], [], []
        for k in range(len(block.texts)):
            a, b = first[k], first[k + 1]
            n_words.append(int(b - a))
            n_removed.append(int(sums[b] - sums[a]))
            if n_removed[-1] == 0:
                text = b" ".join(data[block.texts.offsets[k] : block.texts.offsets[k + 1]].split())
            else:
                kept = (np.flatnonzero(~gone[a:b]) + a).tolist()
                text = b" ".join([data[starts[j] : ends[j]] for j in kept])
            digest.append(hashlib.sha256(text).hexdigest())
        columns = [pa.array(block.ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        columns += [pa.array(digest, pa.string()), pa.array(n_factors, pa.int64())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, n_factors``.

    Removed is each word covered by a window of ``width`` words that also
    starts in a document with a smaller id; windows are judged on the input. A removed word is always one whose window
    was compared word by word; two windows of one 64-bit hash that are not the same can only keep words.
    Defined cases: a null text has no words; texts shorter than a window stay
    whole; rows repeated under one id do not count against each other; a null id
    sorts behind all ids; an empty table gives an empty result; other columns
    are not read.
    """
    table = BlockTable(docs, id_col, text_col)

    def sampled(block: Block, _: list):
        parse = _Parse(block, width)
        return _distinct_docs(parse.sampled(), parse.doc)

    def places(block: Block, given: list):
        parse = _Parse(block, width)
        keys, values, _, _ = _lookups(parse, _candidates(parse, given[0]))
        return keys, values

    table.ask("shared", sampled, _shared, key_bits=48)
    table.ask("places", places, _first_place, ("shared",), planes=3)
    claims = write_bucketed(table.map(_claims(width), RUNS, ("shared", "places")), "claims", table.buckets, "block")
    wanted = claims.select("block", F.inline("pages")).select(F.col("block").alias("asker"), "no", "ref", "page")
    # Distinct first: a page that very many ask for is cut once, and no block cuts more than its own pages.
    asked = wanted.select(F.col("ref").alias("block"), "page").distinct()
    asked = asked.groupBy("block").agg(F.collect_list(F.struct(F.col("page").alias("range"), F.lit(b"").alias("data"))).alias("asked"))
    cut = table.map(_cut_pages, "ref long, page int, data binary", ("asked",), table.blocks.join(asked, "block"))
    table.attach("pages", wanted.join(cut, ["ref", "page"]).select(F.col("asker").alias("block"), F.col("no").alias("range"), "data"))
    table.attach("runs", claims.select("block", F.lit(0).alias("range"), F.col("runs").alias("data")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long"
    return table.map(_finish(width), schema, ("runs", "pages"))
