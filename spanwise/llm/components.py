"""Connected components of link tables: union-find inside tasks, hooking between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import write_table


def find(parent: dict, x):
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def forest(links) -> dict:
    """Union-find over (a, b) pairs: the root of each node, which is its least one."""
    parent: dict = {}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        low, high = min(a, b), max(a, b)
        parent.setdefault(low, low)
        parent[high] = low
    return {x: find(parent, x) for x in list(parent)}


#: Links that one union-find holds at a time; no more than these settle in one task.
CHUNK = 200_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each node of all links that the task reads."""
    roots = forest((a, b) for x in batches for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist()))
    columns = [pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["node", "component"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the least node of each tree: no more links than before."""

    def stars(links: list) -> pa.RecordBatch:
        rows = [(x, r) for x, r in forest(links).items() if x != r]
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["high", "low"]
        )

    held: list = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(held) >= CHUNK:
            yield stars(held)
            held = []
    yield stars(held)


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))


def components(links: DataFrame, chunk: int | None = None) -> DataFrame:
    """``node, component`` for each node of links ``(a, b)``: the least node that it reaches.

    Tasks first reduce their links to forests. If these hold ``chunk`` links at
    most, one union-find settles them. Otherwise every round hooks each node to
    its least neighbour, follows the hooks to their roots by doubling, and
    contracts. Rounds are few, since each node with a smaller neighbour
    vanishes. Aggregates are pre-summed map-side, so a node with very many links
    is no hot spot.
    """
    stars = "high long, low long"
    links = write_table(_ordered(links).mapInArrow(_local, stars), "links")
    if links.count() <= (CHUNK if chunk is None else chunk):
        return write_table(links.coalesce(1).mapInArrow(_settle, "node long, component long"), "labels")
    links = write_table(links.distinct(), "links")
    nodes = links.select(F.col("high").alias("node")).union(links.select("low")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        roots = write_table(links.groupBy("high").agg(F.min("low").alias("root")), "hooks")
        while True:
            onward = roots.select(F.col("high").alias("root"), F.col("root").alias("next"))
            joined = roots.join(onward, "root", "left")
            if joined.filter("next IS NOT NULL").isEmpty():
                break
            roots = write_table(joined.select("high", F.coalesce("next", "root").alias("root")), "hooks")
        own = roots.select(F.col("high").alias("component"), "root")
        labels = write_table(
            labels.join(own, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels"
        )
        low = roots.select(F.col("high").alias("low"), F.col("root").alias("low_root"))
        moved = links.join(roots, "high").join(low, "low", "left")
        moved = moved.select(F.col("root").alias("a"), F.coalesce("low_root", "low").alias("b"))
        links = write_table(_ordered(moved).mapInArrow(_local, stars).distinct(), "links")
    return labels
