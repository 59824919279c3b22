"""Connected components of a graph that no machine holds: alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import hashing as H
from loomspan.llm.common import materialise

_CHUNK = 1 << 20  # edges that a task contracts at a time
_BATCH = 1 << 16


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, sorted, and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        # x and y are roots: of each edge the larger is hung below its smallest neighbour, then all paths are shortened
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while len(np.flatnonzero((above := up[up]) != up)):
            up = above
        x, y = up[x], up[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[up]


def _edges(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars (a: node, b: the smallest it is connected with there), in chunks of _CHUNK edges."""
    held, n = [], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        nodes, least = _least(*(np.concatenate(x) for x in zip(*held, strict=True)))
        leaf = nodes != least
        return nodes[leaf], least[leaf]

    def rows(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), _BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + _BATCH]), pa.array(b[i : i + _BATCH])], names=["a", "b"])

    for batch in batches:
        held.append(_edges(batch))
        n += batch.num_rows
        if n >= _CHUNK:
            held = [stars()]
            n = len(held[0][0])
            if 2 * n > _CHUNK:
                yield from rows(*held[0])
                held, n = [], 0
    if n:
        yield from rows(*stars())


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges, in one task."""
    held = [_edges(batch) for batch in batches if batch.num_rows]
    if held:
        nodes, least = _least(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(nodes), _BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + _BATCH]), pa.array(least[i : i + _BATCH])], names=["node", "root"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point down (a > b): a node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, label: str = "edges", within: int = 0) -> DataFrame:
    """node, root (the smallest node of its component), for every node that has an edge (columns a, b: long).

    Each task first contracts its own edges to stars.  With ``within``, while more edges than that are left, the stars
    of a node meet and are contracted again, as long as that helps; then one task connects them.  What doesn't shrink to
    that goes through rounds of stars in Spark, until nothing changes.

    Sizes are reduced before every join; a star with very many leaves meets one row for its centre, which
    adaptive execution splits.  Each half of a round is written to the shared folder, so a lost executor costs one, and
    the driver plans one star at a time: each star reads its edges three or four times, and plans of both would multiply.
    """
    down = materialise(edges.filter("a <> b").select("a", "b").mapInArrow(H.released(_contracted), "a long, b long"), label)
    n = down.count() if within else 0
    while within and n > within:
        down = materialise(down.repartition(-(-n // _CHUNK), "a").mapInArrow(H.released(_contracted), "a long, b long"), label)
        before, n = n, down.count()
        if n > 0.7 * before:
            break
    if within and n <= within:
        return materialise(down.repartition(1).mapInArrow(H.released(_rooted), "node long, root long"), label)
    current = materialise(_small_star(down), label)
    state = _state(current)
    while True:
        following = materialise(_small_star(materialise(_large_star(current), label)), label)
        now = _state(following)
        current = following
        if now == state:
            break
        state = now
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
