"""Benchmark decontamination by pigeonhole edit matching.

With a budget of e edits, an item cut into e + 1 pieces keeps at least one
piece unchanged wherever it occurs. All pieces are found in one pass over a
text by an Aho-Corasick automaton; around each hit the whole item is verified
by Myers' bit-parallel edit distance. Texts and items are compared in lower
case with white space runs as one blank.

The items travel to the executors, so they are split by size: each slice holds
about ``SLICE_CHARS``. A benchmark of more is taken slice by slice, each with a
pass over the documents of its own, and a slice is given up before the next one
is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import write_table

#: One edit allowed for so many characters of an item: pieces have about this length.
CHARS_PER_EDIT = 16
#: Items with fewer characters are matched without edits, as whole words: inside others they occur by chance.
MIN_CHARS = 24
SLICE_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(item: str) -> int:
    return len(item) // CHARS_PER_EDIT if len(item) >= MIN_CHARS else 0


def whole_words(text: str, a: int, b: int) -> bool:
    """Whether neither edge of ``text[a:b]`` parts two characters of one word."""

    def inside(at: int) -> bool:
        return 0 < at < len(text) and all(c.isalnum() or c == "_" for c in text[at - 1 : at + 1])

    return not inside(a) and not inside(b)


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` spans that cover ``length`` characters, as even as can be."""
    n = budget + 1
    edges = [k * length // n for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and where its first best one ends."""
    m, last = len(pattern), 1 << (len(pattern) - 1)
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << m) - 1
    up, down, score = full, 0, m
    best = None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(diagonal | up) & full, up & diagonal
        score += bool(more & last) - bool(less & last)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(diagonal | more) & full, more & diagonal
        if score <= budget and (best is None or score < best[0]):
            best = (score, end)
    return best


@dataclass
class Items:
    """A slice of the benchmark: (item id, normalised text, budget) of each item."""

    rows: list[tuple[int, str, int]]

    def matcher(self) -> Matcher:
        return Matcher(self.rows)


class Matcher:
    def __init__(self, rows: list[tuple[int, str, int]]):
        import ahocorasick

        self.rows = rows
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(rows):
            for a, b in pieces(len(text), budget):
                owners.setdefault(text[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, held_by in owners.items():
            self.automaton.add_word(piece, (len(piece), held_by))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best match of each item found; places are in the normalised text."""
        if not self.rows:
            return []
        text = normalise(text)
        starts: dict[int, list[int]] = {}
        for last, (length, held_by) in self.automaton.iter(text):
            for k, a in held_by:
                starts.setdefault(k, []).append(last + 1 - length - a)
        found = []
        for k, begins in starts.items():
            item_id, item, budget = self.rows[k]
            if len(item) < MIN_CHARS:  # one piece, the item itself: each hit is an occurrence, and they come in order
                at = next((at for at in begins if whole_words(text, at, at + len(item))), None)
                if at is not None:
                    found.append((item_id, 0, at, at + len(item)))
                continue
            at = text.find(item)
            if at >= 0:
                found.append((item_id, 0, at, at + len(item)))
                continue
            best, upto = None, -1
            for begin in sorted(begins):
                low, high = max(0, begin - budget), min(len(text), begin + len(item) + budget)
                if high <= upto:
                    continue  # inside a stretch that was verified
                upto = high
                hit = myers(item, text[low:high], budget)
                if hit and (best is None or hit[0] < best[1]):
                    best = (item_id, hit[0], max(0, low + hit[1] - len(item)), low + hit[1])
            if best:
                found.append(best)
        return sorted(found)


def n_slices(benchmark: DataFrame, text_col: str = "text") -> int:
    total = benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(1, -(-total // SLICE_CHARS))


def slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items in slices of bounded size, whatever the size of the benchmark; the driver holds one at a time.

    Items with under ``MIN_CHARS`` normalised characters have no budget; those
    without characters, null ones too, match nothing.
    """
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    n = n_slices(rows)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        texts = [(r["id"], normalise(r["text"])) for r in part.collect()]
        kept = sorted({(i, t) for i, t in texts if t}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Items([(i, t, budget_of(t)) for i, t in kept])


HITS = "array<struct<item_id:long,distance:int,start:long,end:long>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def hits_column(shared: Broadcast):
    """A column function ``text -> hits`` of broadcast ``Items``: no text moves."""
    built: dict[str, Matcher] = {}

    @F.arrow_udf(HITS)
    def hits(text: pa.Array) -> pa.Array:
        if not built:
            built["matcher"] = shared.value.matcher()
        names = ("item_id", "distance", "start", "end")
        return pa.array([[dict(zip(names, h)) for h in built["matcher"].find(x.as_py())] for x in text], _HIT)

    return hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document, item) that matches: ``doc_id, item_id, distance, start, end``.

    ``start`` and ``end`` are places in the normalised text; ``start`` is exact
    where the distance is 0 and else within the budget. Defined cases: a null or
    empty text matches nothing; a null document id is returned as it is; a text
    of any length is searched whole, in memory by its own size; repeated rows
    give repeated hits; of several occurrences of an item in one text the
    closest is reported, the first of equals; items under ``MIN_CHARS``
    characters match exactly, as whole words; an empty benchmark matches
    nothing; other columns are not read.
    """
    n = n_slices(benchmark)
    out = None
    for items in slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # SLICE_CHARS characters at most
        part = docs.select(F.col(id_col).alias("doc_id"), F.inline(hits_column(shared)(F.col(text_col))))
        if n > 1:
            part = write_table(part, "benchmark-hits")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no item was found, all their columns. Null and empty texts hold none; cases as in ``decontaminate``."""
    n = n_slices(benchmark)
    for items in slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # SLICE_CHARS characters at most
        docs = docs.filter(F.size(hits_column(shared)(F.col(text_col))) == 0)
        if n > 1:
            docs = write_table(docs, "benchmark-clean")
            shared.destroy()
    return docs
