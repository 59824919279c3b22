"""MinHash near-duplicates with sequential Bayesian verification.

1.  Texts with equal shingle sets are one class.  A class gets BANDS x ROWS minima of its shingles, one byte of each
    (its sketch) and a key for each band of ROWS minima.
2.  Classes that have a band key in common are candidates.  A bucket of more than ``bucket`` classes is cut again by
    pairs of band keys (two texts of similarity 0.8 that meet in one band meet in another but for 5 in a million); what is
    larger even then is joined by exact metric cells (jaccard_join), so no bucket is capped.
3.  In a bucket the sketches are compared a batch of minima at a time.  Given m matches of n, the posterior of the
    similarity (flat before) says how likely it is at the threshold or above; a pair for which that falls below ``miss``
    is pruned, the others see the next batch.  Pairs that survivors connect already are left out, so a bucket of n near
    copies costs about n comparisons and gives n - 1 edges.
4.  Survivors form regions (connected components).  The texts of a region meet in one task; its pairs that share a band
    and survive are verified on the full shingle sets, 100 * |x & y| >= percent * |x | y|.  Links that connect make the
    components.  Regions of more classes than a task holds are joined by exact metric cells as well.

What can be missed: at the threshold itself 0.672^32 = 3e-6 of the pairs by bands and ``miss`` by pruning; above it
less.  No wrong link is made.

Defined results: null or wordless text has no shingles and is linked with nothing; fewer than k words are one shingle;
rows without doc_id get component null and are not kept; rows that share a doc_id are judged each on its own text; other columns
are left out; 64-bit hashes tell shingles and classes apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import hashing as H
from loomspan.llm import jaccard_join as J
from loomspan.llm.common import materialise
from loomspan.llm.components import connected_components

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 5
MISS = 1e-6
BUCKET = 1 << 12
_STEP = 16  # minima compared at a time
_SALTS = 8

_A = H.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = H.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def minima(rows: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS * ROWS) smallest values of each set under as many hash functions; sets are sorted by row, an empty one gives zeros."""
    out = np.zeros((n, BANDS * ROWS), dtype=np.uint64)
    if len(rows):
        have, at = np.unique(rows, return_index=True)
        for i in range(BANDS * ROWS):
            out[have, i] = np.minimum.reduceat((shingles ^ _B[i]) * _A[i], at)
    return out


def sketches(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum; two different minima share it once in 256."""
    return (H.mix(least) >> np.uint64(40)).astype(np.uint8)


def band_keys(least: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of a band's minima and its number."""
    out = np.empty((len(least), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(least), b + 1, dtype=np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = H.join2(key, least[:, i])
        out[:, b] = key
    return out


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m): after n minima a pair with fewer than m matching bytes is above the threshold with probability under ``miss``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    above = s >= percent / 100
    out = []
    for n in [*range(_STEP, BANDS * ROWS, _STEP), BANDS * ROWS]:
        for m in range(n + 1):
            ll = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(ll - ll.max())
            if like[above].sum() >= miss * like.sum():
                break
        out.append((n, m))
    return out


def survivors(one: np.ndarray, others: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Places of the sketches that no batch of minima prunes."""
    left, matches, before = np.arange(len(others)), np.zeros(len(others), np.int64), 0
    for n, m in bounds:
        matches = matches + (others[left, before:n] == one[before:n]).sum(axis=1)
        stay = matches >= m
        left, matches, before = left[stay], matches[stay], n
        if not len(left):
            break
    return left


def _signed(text: str, k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index(text))
            for words in H.words_of(column, H.BLANK, True):
                rows, shingles = J._sets(words, k)
                size, cls = J._classes(rows, shingles, words.n_rows)
                least = minima(rows, shingles, words.n_rows)
                keys, sketch = band_keys(least).view(np.int64), sketches(least)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(words.first_row, words.n_rows),
                        pa.array(size),
                        pa.array(cls.view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(words.n_rows + 1, dtype=np.int32) * BANDS, pa.array(keys.reshape(-1))),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "cls", "keys", "sketch"],
                )

    return of


def _connect(n: int, found) -> list[tuple[int, int]]:
    """A forest over n classes; found(x, ys) says which of the ys, all of other components than x, are joined with x."""
    comp, edges = np.arange(n), []
    for x in range(n):
        ys = np.flatnonzero(comp != comp[x])
        if not len(ys):
            break
        ys = ys[ys > x]  # pairs with smaller ones have been met
        for y in (found(x, ys) if len(ys) else ys).tolist():
            if comp[y] != comp[x]:
                edges.append((x, y))
                comp[comp == comp[y]] = comp[x]
    return edges


def _screened(percent: int, miss: float):
    """Rows (k, cls, sketch) sorted by bucket: edges of survivors that connect the classes of each bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = least_matches(percent, miss)
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> list[np.ndarray]:
            table = pa.Table.from_batches(held).combine_chunks()
            cls, first = np.unique(table.column("cls").to_numpy(), return_index=True)
            sketch = np.frombuffer(b"".join(table.column("sketch").take(pa.array(first)).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            edges = _connect(len(cls), lambda x, ys: ys[survivors(sketch[x], sketch[ys], bounds)])
            return [cls[[x for x, _ in edges]], cls[[y for _, y in edges]]] if edges else []

        out: list[list[np.ndarray]] = []
        for batch in batches:
            k = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and k[a] != now:
                    out.append(done())
                    held = []
                now = k[a]
                held.append(batch.slice(a, b - a))
            if len(out) > 1024:
                yield _pairs(out)
                out = []
        if held:
            out.append(done())
        yield _pairs(out)

    return of


def _pairs(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Edges of some buckets, each once: near copies meet in many bands."""
    sides = [x for x in found if x]
    both = np.unique(np.concatenate([np.stack(x, axis=1) for x in sides]), axis=0) if sides else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])


def _verified(k: int, percent: int, miss: float):
    """Rows sorted by region: edges between linked classes that connect each region."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = least_matches(percent, miss)
        for _, table, rows, hashes in J._groups(batches, ["root"], k):
            cls = table.column(table.schema.get_field_index("cls")).to_numpy()
            n = len(cls)
            sets, least = J._Sets(rows, hashes, n), minima(rows, hashes, n)
            keys, sketch = band_keys(least), sketches(least)

            def linked(x: int, ys: np.ndarray) -> np.ndarray:
                ys = ys[(keys[ys] == keys[x]).any(axis=1)]  # candidates are what shares a band  # noqa: B023
                ys = ys[survivors(sketch[x], sketch[ys], bounds)]  # noqa: B023
                if not len(ys):
                    return ys
                common = J._Index(sets, ys).shared(sets.of(x))  # noqa: B023
                return ys[100 * common >= percent * (sets.size[ys] + sets.size[x] - common)]  # noqa: B023

            yield J._edges_batch(cls, _connect(n, linked))

    return of


def _members(keys: DataFrame) -> DataFrame:
    """k, cls, n: the rows of keys that n > 1 classes have."""
    met = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(met.hint("merge"), "k")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Groups side by side, over as many tasks as the session shuffles to: their work counts, not their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)


def candidates(firsts: DataFrame, percent: int, miss: float, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of survivors (a, b), and the classes of buckets too large for a task even by two bands (k, cls)."""
    keys = firsts.select("cls", F.explode("keys").alias("k"))
    met = materialise(_members(keys), "buckets")
    small, rest = met.filter(F.col("n") <= bucket).select("k", "cls"), None
    large = met.filter(F.col("n") > bucket)
    if not large.isEmpty():
        # once more, by this band and each other one
        other = firsts.select("cls", F.col("keys").alias("others"))
        pairs = large.select("k", "cls").join(other, "cls").select(F.col("k").alias("_k"), "cls", F.explode("others").alias("_o")).filter("_k <> _o")
        twice = pairs.select("cls", F.xxhash64(F.least("_k", "_o"), F.greatest("_k", "_o")).alias("k")).distinct()
        again = materialise(_members(twice), "two-band-buckets")
        small = small.unionByName(again.filter(F.col("n") <= bucket).select("k", "cls"))
        rest = again.filter(F.col("n") > bucket).select("k", "cls")
        rest = None if rest.isEmpty() else rest
    rows = small.join(firsts.select("cls", "sketch").hint("merge"), "cls").select("k", "cls", "sketch")
    found = _spread(rows, "k").mapInArrow(H.released(_screened(percent, miss)), "a long, b long")
    return materialise(found, "survivors"), rest


def links(docs: DataFrame, firsts: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between linked classes that connect all that were found to be linked."""
    pairs, rest = candidates(firsts, percent, miss, bucket)
    if rest is not None:  # its classes are one region each bucket, over which cells are exact
        pairs = pairs.unionByName(rest.join(rest.groupBy("k").agg(F.min("cls").alias("b")), "k").filter("cls <> b").select(F.col("cls").alias("a"), "b"))
    regions = connected_components(pairs, "regions", J._EDGES).withColumnRenamed("node", "cls")
    regions = materialise(regions.join(firsts.select("cls", "doc_id", "n"), "cls"), "regions")
    sizes = regions.groupBy("root").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") / J._SET)).cast("long").alias("size"))
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    # sorted at every size: texts are dealt out once, whether few or many of them are in a region
    members = materialise(texts.join(regions.join(sizes, "root").hint("merge"), "doc_id").select("root", "size", "cls", "text"), "members")
    few = _spread(members.filter(F.col("size") <= J._TASK).select("root", "cls", "text"), "root")
    edges = materialise(few.mapInArrow(H.released(_verified(k, percent, miss)), "a long, b long"), "links")
    many = members.filter(F.col("size") > J._TASK)
    if not many.isEmpty():
        edges = edges.unionByName(J._join_large(many, k, percent))
    return edges


def near_duplicates(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (whether it is that one)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = materialise(named.mapInArrow(H.released(_signed("text", k)), "doc_id long, n_shingles long, cls long, keys array<long>, sketch binary"), "documents")
    of_class = every.filter("cls <> 0 and doc_id is not null").groupBy("cls")
    firsts = materialise(of_class.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    comps = connected_components(links(named, firsts, "text", k, percent, miss, bucket), "links", J._EDGES).withColumnRenamed("node", "cls")
    # a component is named through its classes; one of very many classes is dealt out by salt
    tied = firsts.select("cls", "doc_id").join(comps, "cls").withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(_SALTS)).cast("int"))
    ids = tied.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    connected = tied.join(ids, ["root", "_salt"]).select("cls", "component_id")
    by_class = materialise(firsts.select("cls", "doc_id").join(connected, "cls", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id")), "class-components")
    # texts without shingles share no class: they are kept apart from the join, so their number is no hot key
    filled = every.filter("cls <> 0").select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left").select("doc_id", "n_shingles", "component_id")
    bare = every.filter("cls = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = filled.unionByName(bare)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
