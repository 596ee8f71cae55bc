"""Repeated byte strings by a sparse suffix array, merged from front-coded sorted runs.

Every string of ``length`` bytes samples one anchor inside: the ``GRAM`` bytes
with the least hash. Equal strings have their anchors at the same place, so
only suffixes at anchors need sorting, and of those only anchors whose gram
occurs twice anywhere (a first exchange tells). For these, each block sorts two
runs, the texts onwards from the anchors and the texts backwards from them,
front-coded: each string is the length of the prefix that it shares with the one
before and the rest. Ranges of grams merge the blocks' runs with loser trees
that compare no known prefix again, which yields both suffix orders with their
common-prefix lengths. From these two it follows exactly how far the repeated
strings around each anchor reach.

A gram that more than ``HOT`` anchors have does not meet in one task: the
strings around its anchors are looked up one by one, spread by their hash, and
are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .blocks import Block, BlockTable, answer, pack_n, summed
from .text import Rolling, byte_values, mix, ranges

GRAM = 100
HOT = 100_000
_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
#: Starts that are looked at together.
_PART = 1 << 27
_KEY = 8  # bytes of the gram's hash before each string


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    while known < end:
        x, y = a[known : known + 64], b[known : known + 64]
        if x != y:
            n = min(len(x), len(y))
            x, y = int.from_bytes(x[:n], "big"), int.from_bytes(y[:n], "big")
            return known + (8 * n - (x ^ y).bit_length()) // 8
        known += len(x)
    return end


def front_code(run: list[bytes]) -> tuple[list[int], bytes]:
    """Common-prefix lengths and the rests of an ordered run, end to end (their lengths follow from ``sizes``)."""
    shared = [0] * len(run)
    for k in range(1, len(run)):
        shared[k] = common_prefix(run[k - 1], run[k], 0)
    return shared, b"".join(s[h:] for s, h in zip(run, shared))


def front_decode(shared: list[int], sizes: list[int], rests: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for h, n in zip(shared, sizes):
        last = last[:h] + rests[at : at + n - h]
        at += n - h
        out.append(last)
    return out


def loser_tree_merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge ordered runs (strings, common prefix with the one before): (run, place) in order, and common prefixes.

    A node keeps the loser of its match and how much that shares with the
    winner. Of two strings, the one that shares more with what went out last is
    the lesser; only where they share the same are bytes compared, from there on.
    """
    k = 1 << max(0, len(runs) - 1).bit_length()
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    known = [r[1] for r in runs] + [[]] * (k - len(runs))
    at = [0] * k
    shares = [0 if s else -1 for s in strings]  # -1: at its end, loses to all
    head = [s[0] if s else b"" for s in strings]
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets what the loser shares with the winner."""
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        if shares[a] < 0:
            return a, b
        x, y = head[a], head[b]
        h = common_prefix(x, y, shares[a])
        if x[h:] <= y[h:] if h < len(x) and h < len(y) else len(x) <= len(y):
            shares[b] = h
            return a, b
        shares[a] = h
        return b, a

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        winners = []
        for j in range(0, len(level), 2):
            win, lose = play(level[j], level[j + 1])
            losers[node + j // 2] = lose
            winners.append(win)
        level = winners
    top = level[0]
    order: list[tuple[int, int]] = []
    lengths: list[int] = []
    while shares[top] >= 0:
        order.append((top, at[top]))
        lengths.append(shares[top])
        place = at[top] = at[top] + 1
        if place < len(strings[top]):
            head[top], shares[top] = strings[top][place], known[top][place]
        else:
            head[top], shares[top] = b"", -1
        node = (top + k) >> 1
        while node:
            other = losers[node]
            if shares[top] > shares[other]:
                pass
            elif shares[top] < shares[other]:
                losers[node], top = top, other
            else:
                top, losers[node] = play(top, other)
            node >>= 1
    return order, lengths


class _Anchors:
    """The anchors of a block's strings of ``length`` bytes: their places, and their texts' edges."""

    def __init__(self, block: Block, length: int):
        self.block, self.length = block, length
        self.gram = min(GRAM, length)
        texts = block.texts
        self.rolling = Rolling(byte_values(texts.data))
        sizes = np.diff(texts.offsets)
        counts = np.maximum(sizes - (length - 1), 0)
        self.starts = ranges(texts.offsets[:-1], counts)  # of every string inside a text
        hashes = self.rolling.windows(self.gram)
        want = length - self.gram + 1
        of = np.empty(max(len(hashes) - want + 1, 0), dtype=np.int64)
        # Places are told apart by their low bits, so a longer text is looked at in parts that overlap.
        for base in range(0, len(of), _PART):
            part = hashes[base : base + _PART + want - 1]
            least, have = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), 1
            while have < want:
                step = min(have, want - have)
                least = np.minimum(least[:-step], least[step:])
                have += step
            of[base : base + len(least)] = (least & _PLACE).astype(np.int64) + base
        self.of_start = of[self.starts]
        flags = np.zeros(len(texts.data) + 1, dtype=bool)
        flags[self.of_start] = True
        self.places = np.flatnonzero(flags)
        self.grams = mix(self.rolling.spans(self.places, self.places + self.gram))
        text = np.searchsorted(texts.offsets, self.places, "right") - 1
        self.low, self.high = texts.offsets[text], texts.offsets[text + 1]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.grams, return_counts=True)

    def occurrences(self, given: list) -> np.ndarray:
        """In the corpus, of each anchor's gram: 1, or more."""
        if not len(self.places):
            return np.empty(0, dtype=np.int64)
        keys, _ = self.distinct()
        return answer(given)[0].astype(np.int64)[np.searchsorted(keys, self.grams)]

    def surroundings(self, chosen: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        """(gram's hash, text onwards, text backwards) of chosen anchors, as far as a string can reach."""
        data = self.block.texts.data.tobytes()
        back = data[::-1]
        n, out = len(data), []
        keys = self.grams[chosen].astype(">u8").tobytes()
        reach = self.length - self.gram
        rows = zip(self.places[chosen].tolist(), self.low[chosen].tolist(), self.high[chosen].tolist())
        for j, (a, low, high) in enumerate(rows):
            out.append((keys[8 * j : 8 * j + 8], data[a : min(a + self.length, high)], back[n - a : n - max(low, a - reach)]))
        return out


def _at_least_two(group: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.minimum(summed(group, first, values), 1 << 40)


def _numbers(values: list[int]) -> bytes:
    return np.array(values, dtype="<u2").tobytes()


def encode_run(strings: list[bytes]) -> list[bytes]:
    shared, rests = front_code(strings)
    return [_numbers(shared), _numbers([len(s) for s in strings]), rests]


def decode_run(fields: list[bytes]) -> tuple[list[bytes], list[int]]:
    shared = np.frombuffer(fields[0], dtype="<u2").tolist()
    return front_decode(shared, np.frombuffer(fields[1], dtype="<u2").tolist(), fields[2]), shared


def _joined(fields: list[bytes]) -> bytes:
    return b"".join(len(f).to_bytes(4, "little") + f for f in fields)


def _split(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def reaches(onward: list, backward: list, weights: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each run's entries, (most, least): how far before its anchor the first and the last repeated string begin.

    ``onward`` and ``backward`` are runs (strings, common prefixes, entry of each string). Returned are arrays
    (2, entries) with most + 1 and least, or 0 and 0 where no string around the anchor is repeated.
    """
    base = np.append(0, np.cumsum([len(w) for w in weights]))
    n = int(base[-1])
    weight = np.concatenate(weights)
    place, lcp = [], []
    for runs in (onward, backward):
        order, lengths = loser_tree_merge([(r[0], r[1]) for r in runs])
        rank = np.empty(n, dtype=np.int64)
        entry = np.array([base[r] + runs[r][2][k] for r, k in order], dtype=np.int64)
        rank[entry] = np.arange(n)
        place.append(rank)
        lcp.append(np.array(lengths, dtype=np.int64))
    # What each entry shares at most with any other, onwards and backwards; negative if not even the gram.
    best, size = [], []
    for rank, l, runs in zip(place, lcp, (onward, backward)):
        nearest = np.maximum(l, np.append(l[1:], 0))[rank] - _KEY
        own = np.empty(n, dtype=np.int64)
        for b, run in zip(base, runs):
            own[b + np.asarray(run[2], dtype=np.int64)] = [len(s) - _KEY for s in run[0]]
        best.append(np.where(weight > 1, own, nearest))
        size.append(own)
    most, least = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    # Twins, the same on both sides: all strings around them are repeated.
    whole = [np.cumsum(l < (s + _KEY)[np.argsort(rank)])[rank] for l, s, rank in zip(lcp, size, place)]
    pair = whole[0] * (n + 1) + whole[1]
    _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    same = np.bincount(inverse, weights=weight)[inverse] > 1
    done = same & (size[0] + size[1] >= length)
    most[done], least[done] = size[1][done] + 1, np.maximum(length - size[0][done], 0)
    keep = np.zeros(n, dtype=bool)
    keep[np.unique(inverse, return_index=True)[1]] = True  # one of each stands for its twins
    keep &= best[0] + best[1] >= length
    open_ones = np.flatnonzero(keep & ~done)
    if len(open_ones):
        top = int(min(length, best[1][open_ones].max()))
        for before in range(top, -1, -1):
            after = length - before
            # All that share so much on both sides; a partner does, too.
            some = np.flatnonzero(keep & (best[1] >= before) & (best[0] >= after))
            if len(some) < 2:
                continue
            classes = [np.cumsum(l < need + _KEY)[rank[some]] for l, need, rank in ((lcp[0], after, place[0]), (lcp[1], before, place[1]))]
            _, inv, cnt = np.unique(classes[0] * (n + 1) + classes[1], return_inverse=True, return_counts=True)
            hit = some[cnt[inv] > 1]
            hit = hit[~done[hit]]
            most[hit] = np.maximum(most[hit], before + 1)
            least[hit] = before  # the last one set is the least
    result = np.array([most, least])
    return [result[:, a:b] for a, b in zip(base, base[1:])]


def _send_runs(length: int, hot: int, n_ranges: int):
    """Front-coded runs of the surroundings of shared anchors, by ranges of their grams."""

    def run(block: Block, given: list) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        entries = _entries(_Anchors(block, length), given[0], hot)[0]
        rows = {}
        for k, (key, _, _) in enumerate(entries):
            rows.setdefault(int.from_bytes(key, "big") * n_ranges >> 64, []).append(k)
        blocks, ids, data = [], [], []
        for r, part in rows.items():
            first = part[0]
            onward = encode_run([entries[k][0] + entries[k][1] for k in part])
            by_back = sorted(part, key=lambda k: entries[k][0] + entries[k][2])
            backward = encode_run([entries[k][0] + entries[k][2] for k in by_back])
            places = np.array([k - first for k in by_back], dtype="<u4").tobytes()
            blocks.append(block.block)
            ids.append(r)
            data.append([onward, backward, places, part])
        raw = []
        for onward, backward, places, part in data:
            weights = np.array([min(entries.counts[entries[k]], 2) for k in part], dtype=np.uint8).tobytes()
            raw.append(packer.compress(_joined([*onward, *backward, places, weights])))
        columns = [pa.array(blocks, pa.int64()), pa.array(ids, pa.int32()), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "range", "data"])

    return run


class _Counted(list):
    """Ordered distinct surroundings that know how often each occurs."""

    counts: dict


def _entries(anchors: _Anchors, given: list, hot: int) -> tuple[_Counted, np.ndarray, list]:
    """The block's distinct surroundings in order, the anchors that have them, and each one's own."""
    times = anchors.occurrences(given)
    chosen = np.flatnonzero((times > 1) & (times <= hot))
    own = anchors.surroundings(chosen)
    counts: dict = {}
    for x in own:
        counts[x] = counts.get(x, 0) + 1
    entries = _Counted(sorted(counts))
    entries.counts = counts
    return entries, chosen, own


def _merge_runs(length: int):
    def gather(table: pa.Table) -> pa.Table:
        unpacker = zstandard.ZstdDecompressor()
        onward, backward, weights = [], [], []
        for raw in table["data"]:
            fields = _split(unpacker.decompress(raw.as_py()))
            strings, shared = decode_run(fields[0:3])
            onward.append((strings, shared, list(range(len(strings)))))
            strings, shared = decode_run(fields[3:6])
            backward.append((strings, shared, np.frombuffer(fields[6], dtype="<u4").tolist()))
            weights.append(np.frombuffer(fields[7], dtype=np.uint8).astype(np.int64))
        data = [pack_n(x.reshape(-1).astype(np.uint64)) for x in reaches(onward, backward, weights, length)]
        return pa.table({"block": table["block"], "range": table["range"], "data": pa.array(data, pa.binary())})

    return gather


def _hot_windows(anchors: _Anchors, given: list, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the strings whose anchor's gram is hot, and two hashes of each."""
    times = anchors.occurrences(given)
    flags = np.zeros(len(anchors.block.texts.data) + 1, dtype=bool)
    flags[anchors.places[times > hot]] = True
    starts = anchors.starts[flags[anchors.of_start]]
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    other = Rolling(mix(byte_values(anchors.block.texts.data)))
    return starts, *(r.spans(starts, starts + anchors.length) for r in (anchors.rolling, other))


def distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of numbers: where each distinct one is first, in order, the number of each one's, and how often it occurs."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    inverse = np.empty(len(a), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order[first], inverse, np.diff(np.append(first, len(a)))


def same_strings(group: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How often each string of hot grams occurs; strings of one key are told apart by their second hash."""
    _, inverse, _ = distinct_pairs(group.astype(np.uint64), values[1])
    total = np.zeros(int(inverse.max()) + 1, dtype=np.uint64)
    np.add.at(total, inverse, values[0])
    return np.minimum(total, 1 << 40)[inverse][None]


def _finish(length: int, hot: int, any_hot: bool):
    def run(block: Block, given: list) -> Iterator[pa.RecordBatch]:
        anchors = _Anchors(block, length)
        n = len(block.texts.data)
        change = np.zeros(n + 1, dtype=np.int64)
        entries, chosen, own = _entries(anchors, given[0], hot)
        if entries:
            reach = answer(given[1], 2).astype(np.int64)
            number = {x: k for k, x in enumerate(entries)}
            at = np.array([number[x] for x in own], dtype=np.int64)
            most, least = reach[0][at], reach[1][at]
            found = most > 0
            place = anchors.places[chosen][found]
            np.add.at(change, place - (most[found] - 1), 1)
            np.add.at(change, place - least[found] + length, -1)
        if any_hot:
            starts, one, two = _hot_windows(anchors, given[0], hot)
            if len(starts):
                several = answer(given[2])[0] > 1
                starts = starts[several[distinct_pairs(one, two)[1]]]
                np.add.at(change, starts, 1)
                np.add.at(change, starts + length, -1)
        gone = np.cumsum(change[:n]) > 0
        data, offsets = block.texts.data, block.texts.offsets
        n_removed, n_spans, digest = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            part = gone[a:b]
            removed = int(part.sum())
            n_removed.append(removed)
            n_spans.append(int((part[1:] & ~part[:-1]).sum() + part[0]) if removed else 0)
            digest.append(hashlib.sha256((data[a:b][~part] if removed else data[a:b]).tobytes()).hexdigest())
        columns = [pa.array(block.ids, pa.int64()), pa.array(np.diff(offsets), pa.int64())]
        columns += [pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def remove_repeated_bytes(
    docs: DataFrame, length: int = 400, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Removed is each byte covered by a string of ``length`` bytes that also
    starts anywhere else, in the same text too; overlapping occurrences count.
    Defined cases: a null text is empty; texts shorter than ``length`` stay
    whole; repeated rows are texts of their own, so both lose what they share,
    whatever their ids; a null id is kept; an empty table gives an empty result;
    other columns are not read.
    """
    table = BlockTable(docs, id_col, text_col)

    def grams(block: Block, _: list):
        return _Anchors(block, length).distinct()

    def windows(block: Block, given: list):
        _, one, two = _hot_windows(_Anchors(block, length), given[0], hot)
        at, _, counts = distinct_pairs(one, two)
        return one[at], np.array([counts.astype(np.uint64), two[at]])

    table.ask("grams", grams, _at_least_two)
    table.exchange("reach", _send_runs(length, hot, table.ranges), _merge_runs(length), ("grams",))
    any_hot = table.any_answer("grams", lambda values: bool((values > hot).any()))
    if any_hot:
        table.ask("windows", windows, same_strings, ("grams",), planes=2)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    answers = ("grams", "reach", "windows") if any_hot else ("grams", "reach")
    return table.map(_finish(length, hot, any_hot), schema, answers)
