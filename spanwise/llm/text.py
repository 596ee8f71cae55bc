"""Vectorised bytes, words and rolling hashes of whole texts held in one buffer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: The bytes that separate words (space, tab to carriage return).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: A random 64-bit value for each byte, the same in every process.
_OF_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes whose running sums are held at a time when words are hashed.
HASH_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or of its inverse, modulo 2**64; kept, and grown by doubling."""
    found = _powers.get(kind)
    if found is None or len(found) < n:
        base = _BASE if kind == "up" else _INVERSE
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        found = _powers[kind] = np.multiply.accumulate(steps)
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any spans of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _power("up", n), out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of values[start:end] for each pair; spans of equal values and length hash alike."""
        raw = (self.sums[ends] - self.sums[starts]) * _power("down", len(self.sums))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of ``width`` values, from each start on."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        raw = (self.sums[width:] - self.sums[:n]) * _power("down", len(self.sums))[:n]
        return mix(raw + np.uint64(width * 0xD6E8FEB86659FD93 % (1 << 64)))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _OF_BYTE[data]


@dataclass
class Texts:
    """Texts as UTF-8 bytes in one buffer; text k is data[offsets[k]:offsets[k + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @staticmethod
    def of(column: pa.Array) -> Texts:
        """From an Arrow string or binary column; null counts as empty."""
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
        return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def parts(self, most: int):
        """Runs (first, last) of texts of about ``most`` bytes at a time; a longer text comes alone."""
        first = 0
        while first < len(self):
            last = int(np.searchsorted(self.offsets, self.offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), len(self))
            yield first, last
            first = last

    def part(self, first: int, last: int) -> Texts:
        a, b = self.offsets[first], self.offsets[last]
        return Texts(self.data[a:b], self.offsets[first : last + 1] - a)


@dataclass
class Words:
    """The words of texts: byte spans of the buffer, and text k has words[first[k]:first[k + 1]]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: Texts) -> Words:
        inside = IS_WORD[texts.data]
        edges = texts.offsets[:-1][np.diff(texts.offsets) > 0]  # where non-empty texts begin
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[edges] = inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        last = edges[1:] - 1
        closes[last] = inside[last]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return Words(starts, ends, np.searchsorted(starts, texts.offsets))

    def hashes(self, texts: Texts, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word, whatever stands around it; ``HASH_BYTES`` of text at a time."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        at = 0
        while at < len(out):
            base = self.starts[at]
            last = max(at + 1, int(np.searchsorted(self.ends, base + HASH_BYTES, "right")))
            data = texts.data[base : self.ends[last - 1]]
            rolling = Rolling(byte_values(LOWER[data] if lower else data))
            out[at:last] = rolling.spans(self.starts[at:last] - base, self.ends[at:last] - base)
            at = last
        return out


def window_counts(first: np.ndarray, width: int) -> np.ndarray:
    """How many windows of ``width`` items each run has."""
    return np.maximum(np.diff(first) - (width - 1), 0)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count values) of each pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    steps = np.ones(total, dtype=np.int64)
    used = counts > 0
    starts, counts = np.asarray(starts)[used], np.asarray(counts)[used]
    at = np.cumsum(counts)[:-1]
    steps[0] = starts[0]
    steps[at] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(steps)
