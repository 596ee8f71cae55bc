"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash (Ertl, 2017) deals each element of a set to the places of the
signature in the order of a random permutation of its own, the j-th place with
the value j plus a random fraction. The ranks of one element are thus
correlated (each once), which lowers the variance of the estimate, and rounds
stop as soon as every place holds less than the round's number.

Sets that are equal count once. Members of a band's bucket are never paired
all with all: each round compares members with a few pivots of their bucket,
and only across groups that are not linked yet; links found elsewhere count,
and pairs that their rare shingles rule out are not looked at (see ``_linked``).
A bucket is done when its members are one group, find no partner or have all
been pivots, so no link between groups of a bucket is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import giving_back
from .sieve import without
from .store import write_bucketed, write_table
from .text import Rolling, Texts, Words, mix, ranges, window_counts

#: Places of a signature unless told otherwise.
PLACES = 64
#: Rows of a band at most, places of several rows a band at most, and how often a pair at the threshold may be missed.
ROWS, MOST_PLACES, MISSED = 4, 128, 1e-5
PART_BYTES = 1 << 20
#: Elements whose permutations are drawn at a time: a longer text takes no more memory for them.
SLICE = 1 << 18
#: Bits of the map of ids that tells whose sets are needed again: 8 MB at most.
MOST_BITS = 1 << 26
#: A shingle is rare among open nodes if so many hold it at most.
RARE = 8
#: Pairs of one pivot and bucket for which its set is copied once more.
CROWD = 64
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at the threshold shares no band with a probability under ``MISSED``."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent {percent!r}: 1 to 100")
    for rows in range(ROWS, 0, -1):
        differs = 1 - (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log(differs)) if differs else 1
        if bands * rows <= MOST_PLACES:
            break
    return bands, rows


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, in order of both: ``width`` lower-cased words, or all if fewer."""
    words = Words.of(texts)
    rolling = Rolling(words.hashes(texts, lower=True))
    counts = window_counts(words.first, width)
    at = ranges(words.first[:-1], counts)
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    starts = np.concatenate([at, words.first[short]])
    ends = np.concatenate([at + width, words.first[short + 1]])
    owner = np.concatenate([np.repeat(np.arange(len(texts)), counts), short])
    hashes = rolling.spans(starts, ends)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])) if len(owner) else np.empty(0, bool)
    return owner[new], hashes[new]


def superminhash(owner: np.ndarray, hashes: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """The signatures (n, places) of n sets given as (set, element) pairs; places of empty sets are infinite."""
    out = np.full((n, places), np.inf)
    for at in range(0, len(hashes), SLICE):  # minima combine, and what earlier slices have left stops later ones sooner
        _deal(owner[at : at + SLICE], hashes[at : at + SLICE], places, out)
    return out


def _deal(owner: np.ndarray, hashes: np.ndarray, places: int, out: np.ndarray) -> None:
    """Lower the signatures ``out`` by some elements."""
    flat = out.reshape(-1)
    left = np.tile(np.arange(places, dtype=np.min_scalar_type(places)), (len(hashes), 1))  # each element's permutation, as far as drawn
    active = np.arange(len(hashes))
    for j in range(places):
        if not len(active):
            break
        draw = mix(hashes[active] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        fraction = (draw >> np.uint64(32)).astype(np.float64) / (1 << 32)
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        place = left[active, k]
        left[active, k] = left[active, j]
        np.minimum.at(flat, owner[active] * places + place, fraction + j)
        open_sets = out.max(axis=1) >= j + 1
        active = active[open_sets[owner[active]]]


def _sign(width: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = Texts.of(batch.column(1))
            for a, b in all_texts.parts(PART_BYTES):
                texts = all_texts.part(a, b)
                owner, hashes = shingle_sets(texts, width)
                sizes = np.bincount(owner, minlength=b - a)
                some = np.flatnonzero(sizes)
                at = np.cumsum(sizes[some]) - sizes[some]
                digests = np.zeros((2, b - a), dtype=np.uint64)
                if len(some):
                    digests[0, some] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    digests[1, some] = np.add.reduceat(mix(hashes + np.uint64(0x632BE59BD9B4E019)), at)
                places = superminhash(owner, hashes, b - a, n_bands * rows).view(np.uint64)
                bands = np.zeros((b - a, n_bands), dtype=np.uint64)
                for r in range(rows):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + places[:, r::rows])
                flat = pa.array(bands.view(np.int64).reshape(-1), pa.int64())
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests[0].view(np.int64), pa.int64()),
                    pa.array(digests[1].view(np.int64), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * n_bands, pa.int32()), flat),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _marks(bits: int):
    """Words of a bit map of ids, two bits for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(np.asarray(batch.column(0)), bits)
            words = np.unique(at >> np.uint64(6))
            values = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(values, np.searchsorted(words, at >> np.uint64(6)), np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(values.view(np.int64))], names=["word", "bits"])

    return run


def _bits(ids: np.ndarray, bits: int) -> np.ndarray:
    first = mix(ids.astype(np.int64).view(np.uint64))
    return np.concatenate([first, mix(first)]) & np.uint64(bits - 1)


def _bit_map(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids: 16 bits for each, ``MOST_BITS`` at most. More ids only let more others pass."""
    bits = 1 << max(16, min((16 * ids.count() - 1).bit_length(), MOST_BITS.bit_length() - 1))
    found = ids.mapInArrow(_marks(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[np.asarray(found["word"])] = np.asarray(found["bits"]).view(np.uint64)
    return words


def _sets(width: int, shared):
    """The sets of texts whose ids pass the shared bit map: all that are wanted, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            at = _bits(np.asarray(batch.column(0)), 64 * len(words)).reshape(2, -1)
            hit = (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)
            batch = batch.filter(pa.array(hit, pa.bool_()))
            all_texts = Texts.of(batch.column(1))
            for a, b in all_texts.parts(PART_BYTES):
                owner, hashes = shingle_sets(all_texts.part(a, b), width)
                edges = pa.array(np.searchsorted(owner, np.arange(b - a + 1)), pa.int32())
                shingles = pa.ListArray.from_arrays(edges, pa.array(hashes.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), shingles], names=["node", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(pivot, node)`` whose full sets are similar enough, as ``(a, b)`` in order.

    ``n`` bounds the pairs that the pivot has in its bucket. The set of a pivot with over ``CROWD`` of them is copied,
    once for so many, and its pairs are dealt over the copies: a bucket may hold a third of all documents.
    """
    a, b = F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    pairs = pairs.groupBy(a, b).agg(F.max("pivot").alias("pivot"), F.max("n").alias("n"))
    other = F.when(F.col("pivot") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    pairs = write_table(pairs.select("pivot", other.alias("node"), F.ceil(F.col("n") / CROWD).alias("copies")), "minhash-pairs")
    left = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("left"))
    right = sets.select("node", F.col("shingles").alias("right"))
    both = pairs.filter("copies <= 1").select("pivot", "node").join(left, "pivot")
    crowded = pairs.filter("copies > 1")
    if not crowded.isEmpty():
        copies = left.join(crowded.groupBy("pivot").agg(F.max("copies").alias("copies")), "pivot")
        copies = copies.select("pivot", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        dealt = crowded.select("pivot", "node", F.pmod(F.xxhash64("node"), F.col("copies")).alias("copy"))
        both = both.unionByName(dealt.join(copies, ["pivot", "copy"]).select("pivot", "node", "left"))
    both = both.join(right, "node")
    common = F.size(F.array_intersect("left", "right"))
    both = both.select(a, b, common.alias("common"), (F.size("left") + F.size("right")).alias("total"))
    return both.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked where 100 * common >= ``percent`` * all shingles, of
    ``width`` lower-cased words each. Candidates share a band of
    signature places; ``banding`` has so many bands that a pair at the threshold
    is missed by all with a probability under 1e-5. Defined cases: texts without words
    (null, empty) link with nothing and are kept; rows repeated with one id and
    text give the same row each; of rows of one id and different texts, one
    text stands for the id where links are verified; a null id takes part in no link and is its own group
    (component null, kept); an empty table gives an empty result; other columns
    are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = write_table(source.mapInArrow(giving_back(_sign(width, *banding(percent))), SIGNED), "minhash-signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one node, named by the least id; their bands are equal too.
    nodes = write_table(
        usable.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")
        ),
        "minhash-nodes",
    )
    members = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    # What is summed by bucket is written before it is joined by bucket: only then can a crowded one be split.
    full = members.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key")
    full = write_table(full, "minhash-full")
    bucketed = write_table(members.join(full, ["band", "key"], "left_semi"), "minhash-buckets")
    ids = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = not ids.filter("n > 1").isEmpty()
    links = _linked(source, bucketed, width, percent, repeated)
    twice = signed.filter("doc_id IS NOT NULL").select("doc_id", "set_a", "set_b", "n_shingles")
    named = twice.join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"], "left")
    named = named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id")).alias("node"))
    if links is not None:
        labels = components(links)
        named = named.join(labels, "node", "left")
        named = named.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    else:
        named = named.withColumnRenamed("node", "component_id")
    loose = signed.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(loose).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _can_link(size_a, rare_a, size_b, rare_b, percent: int):
    """Whether sets that share none of their rare shingles can be similar enough: the rest is all they can share."""
    most = F.least(size_a - rare_a, size_b - rare_b)
    return 100 * most >= percent * (size_a + size_b - most)


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that hold more than one component."""
    now = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = now.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    undone = write_table(spans.filter("least < most").select("band", "key"), "minhash-undone")
    return now.join(undone, ["band", "key"], "left_semi")


def _rarity(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, rare, prefix``: how many shingles at most ``RARE`` open nodes hold, and those of them in the prefix.

    The prefix of a set is so many of its rarest shingles that a similar set
    cannot miss them all; both sides order shingles alike.
    """
    held = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    held = write_table(held, "minhash-held")
    counted = held.groupBy("shingle").agg(F.count("*").alias("times"))
    seldom = held.join(counted.filter(F.col("times") <= RARE), "shingle").groupBy("node")
    seldom = seldom.agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("seldom"))
    sizes = sets.select("node", F.size("shingles").alias("n"))
    prefix = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    return seldom.join(sizes, "node").select(
        "node", F.size("seldom").alias("rare"), F.slice("seldom.shingle", F.lit(1), prefix).alias("prefix")
    )


def _linked(source: DataFrame, members: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame | None:
    """Verified links ``(a, b)`` that join all nodes which links inside the buckets ``(band, key, node, size)`` join.

    1. Every member is compared with the least of its bucket.
    2. Of buckets that still hold several groups, members that share a rare
       shingle of their prefixes are compared; such a shingle has ``RARE``
       holders at most.
    3. Other pairs can only share what is not rare, which rules most of them
       out unseen. Those left are compared with more and more pivots.
    """
    if members.isEmpty():
        return None
    shared = source.sparkSession.sparkContext.broadcast(_bit_map(members.select("node").distinct()))  # MOST_BITS
    sets = source.mapInArrow(giving_back(_sets(width, shared)), "node long, shingles array<long>")
    buckets = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = sets.repartition(buckets, "node")
    if repeated:  # rows of one id: one of them stands for it
        sets = sets.groupBy("node").agg(F.min("shingles").alias("shingles"))
    # A set moves here, once; the joins by node below take it from its bucket, one file each.
    sets = write_bucketed(sets, "minhash-sets", buckets, "node")

    least = members.groupBy("band", "key").agg(F.min(F.struct("node", "size")).alias("pivot"), F.count("*").alias("n"))
    least = write_table(least.select("band", "key", "pivot.*", "n").toDF("band", "key", "pivot", "pivot_size", "n"), "minhash-pivots")
    close = F.least("size", "pivot_size") * 100 >= F.greatest("size", "pivot_size") * percent
    pairs = members.join(least, ["band", "key"]).filter(F.col("node") != F.col("pivot")).filter(close)
    links = write_table(_verified(pairs.select("pivot", "node", "n"), sets, percent), "minhash-links")
    labels = components(links)
    used = least.select("band", "key", F.col("pivot").alias("node"))
    members = members.join(used, ["band", "key", "node"], "left_anti")
    now = write_table(_open(members, labels), "minhash-open")
    if now.isEmpty():
        return links

    rarity = write_table(_rarity(now, sets, percent), "minhash-rarity")
    nodes = now.select("node", "size", "component").distinct().join(rarity, "node", "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    left = nodes.select("node", "size", "component", F.explode("prefix").alias("shingle"))
    right = left.toDF("pivot", "pivot_size", "group", "shingle")
    pairs = left.join(right, (left["shingle"] == right["shingle"]) & (F.col("node") < F.col("pivot")) & (F.col("component") != F.col("group")) & close)
    # A shingle brings a node RARE - 1 partners at most, so none is crowded.
    found = write_table(_verified(pairs.select("pivot", "node", F.lit(1).alias("n")), sets, percent), "minhash-links")
    links = links.unionByName(found)
    known = write_table(nodes.select("node", "rare"), "minhash-rare")
    members = now.drop("component").join(known, "node", "left")
    pivots = 16
    while True:
        # More pivots than one at a time: rounds cost more than comparisons do. Whom the bucket's smallest set is too large for finds no partner in it.
        smallest = members.drop("n").groupBy("band", "key").agg(F.min("size").alias("smallest"), F.count("*").alias("n"))
        smallest = write_table(smallest, "minhash-smallest")
        reach = (F.col("size") - F.col("rare")) * (100 + percent) - percent * F.col("size")
        # Written, so that what follows is summed before it is dealt out: a join alone can split a crowded bucket.
        members = members.drop("n").join(smallest, ["band", "key"]).filter(reach >= percent * F.col("smallest")).drop("smallest")
        members = write_table(members, "minhash-left")
        labels = components(links)
        now = write_table(_open(members, labels), "minhash-open")
        if now.isEmpty():
            return links
        slot = F.pmod(F.xxhash64("node", "band", F.lit(pivots)), F.lit(pivots))
        chosen = now.groupBy("band", "key", slot.alias("slot")).agg(F.min(F.struct("node", "component", "size", "rare")).alias("pivot"))
        chosen = chosen.select("band", "key", "pivot.*").toDF("band", "key", "pivot", "group", "pivot_size", "pivot_rare")
        chosen = write_table(chosen, "minhash-pivots")
        able = _can_link(F.col("size"), F.col("rare"), F.col("pivot_size"), F.col("pivot_rare"), percent)
        pairs = now.join(chosen, ["band", "key"]).filter((F.col("component") != F.col("group")) & able)
        links = links.unionByName(write_table(_verified(pairs.select("pivot", "node", "n"), sets, percent), "minhash-links"))
        used = chosen.select("band", "key", F.col("pivot").alias("node"))
        members = now.drop("component").join(used, ["band", "key", "node"], "left_anti")
        pivots = 256


def keep_one(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """The document with the least id of each group, all its columns; of rows under one id, all or none.

    Rows without words or without an id stay; an empty table gives an empty one. Only rows that may go are dealt by id.
    """
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("key")).distinct()
    gone = write_table(gone, "minhash-gone").withColumn("__gone", F.col("key"))
    return without(docs, F.col("doc_id"), gone, F.col("doc_id") == F.col("__gone"))
