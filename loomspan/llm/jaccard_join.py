"""Exact n-gram Jaccard join as a metric-space join with pivots.

Jaccard distance d = 1 - J is a metric, so for a pivot p and linked x, y:
|d(x, p) - d(y, p)| <= r = 1 - threshold.  Pivot by document is hopeless on
its own here, since nearly all texts are at distance 1 from each other; so the
first cut is by tiny pivots, single shingles, of which a text is at distance
< 1 exactly if it holds them:

1.  Texts with equal shingle sets are one class; only classes are compared.
2.  Two linked classes share at least ``l`` shingles among their first
    (n - ceil(t n) + l) by hash.  Classes with fewer shared shingles there have
    no link at all and leave.  Of the others all shingles are counted; who has
    fewer than ceil(t n) shared ones leaves too.  Of c shared ones the rarest
    (c - ceil(t n) + 1) are pivots: linked classes have one of them in common.
3.  Classes that have pivots in common, directly or over others, form a region
    (connected components); all links lie inside regions.
4.  A region is joined recursively.  Some classes of it are pivots; every class
    gets its distances to them, is linked with those within r (the star of a
    pivot), and belongs to the Voronoi cell of its nearest pivot.  A class that
    is still asked for goes, as a replica, to each cell whose members its
    triangle windows reach (all pivots at once), and is joined there with the
    members of the cell by the same step, with pivots of its own.  Every pair is
    met in one cell, that of its member; a pivot has met all and is asked no
    more.  The steps end where few classes are left, or where these are so close
    to each other that windows spare less than half of the comparisons: there
    each asked class is a pivot.  Classes of the largest component need no
    comparison with each other, they are connected.
5.  What one task can hold (``_TASK`` classes) goes through all these steps
    there.  A larger region takes the first step in Spark: pivots are sent to
    all its parts, replicas to all cells they reach, and each cell, in parts and
    blocks that a task can hold, goes on from there.

Every class pair that can link and is not connected yet is compared with the
exact rule 100 * |x & y| >= 100 t * |x | y| on whole shingle sets.  Shared hot
shingles are combined before the shuffle (one row for each Arrow batch), the
order by frequency comes from a counter table of fixed size.

Joins with tables of classes sort at every size: as a broadcast such a table
would be in the driver three times (as rows, as hash table, in blocks), ten to
thirty times its size on disk, by which Spark decides.

Shingles and classes are told apart by 64-bit hashes.

Defined results: null or wordless text has no shingles and is linked with
nothing, not even its like; fewer than k words are one shingle; rows without
doc_id get component null; rows that share a doc_id are judged each on its
own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import hashing as H
from loomspan.llm.common import materialise
from loomspan.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
_SPARE = 12  # per cent of a set that is looked at beyond the shortest prefix
_TASK = 2_000  # classes that one task holds at a time
_SET = 1_000  # shingles of a class, for sizing tasks
_PIVOTS = 8  # of a cell at most; a small one has the root of its classes
_LEAF = 4  # members of a cell that is not cut
_COUNTERS = 1 << 20
_BLOCK = 1 << 12  # counters of a row that the driver gets
_SALTS = 8
_EDGES = 1 << 22  # edges that one task connects; more go through rounds in Spark


def _need(n, percent: int):
    """Shared shingles of a set of n with any partner: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def _sets(words: H.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) pairs of a slice, distinct, sorted by row and shingle."""
    lengths = np.diff(words.doc_off)
    row = words.row_of_word()
    grams = H.windows(words.hashes, k)
    at = np.flatnonzero(H.starts_in_row(words.doc_off, k))
    rows, hashes = [row[at]], [grams[at]]
    for n in range(1, k):
        short = np.flatnonzero(lengths == n)
        if len(short):
            rows.append(short)
            hashes.append(H.mix(H.windows(words.hashes, n)[words.doc_off[short]] + np.uint64(n)))
    r, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def _classes(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, class) of each row; the class is a hash of the whole set, 0 for the empty one."""
    size = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(size)
    run = np.concatenate([[np.uint64(0)], np.cumsum(H.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))])
    total = run[ends] - run[ends - size]
    return size, np.where(size > 0, H.mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 0).astype(np.uint64)


def _documents(text: str, k: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for words in H.words_of(batch.column(batch.schema.get_field_index(text)), H.BLANK, True):
                size, cls = _classes(*_sets(words, k), words.n_rows)
                sizes.append(size)
                classes.append(cls)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(classes).view(np.int64))], names=["doc_id", "n_shingles", "cls"]
            )

    return of


def _combine(hashes: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
    """Rows (k, h, cls) of a batch: of each shingle one class stands for the batch (k = shingle).

    h is 0 for a class that has its shingle alone in the batch; elsewhere it is the shingle, which is then known to be
    shared, and classes that don't stand for the batch get a k of their own.  Rows are in the order of classes, which
    shuffle files compress well.
    """
    order = np.lexsort((classes, hashes))
    hashes, classes = hashes[order], classes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (classes[1:] != classes[:-1])
    hashes, classes = hashes[new], classes[new]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    known = ~first | ~np.append(first[1:], True) if len(first) else first
    k = np.where(first, hashes, H.join2(hashes, classes))
    h = np.where(known, hashes, np.uint64(0))
    order = np.argsort(classes, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(x[order].view(np.int64)) for x in (k, h, classes)], names=["k", "h", "cls"])


def _shingles(text: str, k: int, percent: int, whole: bool):
    """Rows of the first shingles of each class, or of all (then of rows whose text is that of their class)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, classes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for words in H.words_of(batch.column(batch.schema.get_field_index(text)), H.BLANK, True):
                rows, shingles = _sets(words, k)
                size, cls = _classes(rows, shingles, words.n_rows)
                if whole:
                    meant = batch.column(batch.schema.get_field_index("cls")).to_numpy()[words.first_row : words.first_row + words.n_rows]
                    used = (cls.view(np.int64) == meant)[rows]
                else:
                    length = np.minimum(size, size - _need(size, percent) + -(-size * _SPARE // 100))
                    used = np.arange(len(rows)) - (np.cumsum(size) - size)[rows] < length[rows]
                hashes.append(shingles[used])
                classes.append(cls[rows[used]])
            yield _combine(np.concatenate(hashes), np.concatenate(classes))

    return of


def _shared(rows: DataFrame) -> DataFrame:
    """cls, hs: the shingles of each class that another class has as well."""
    by_key = Window.partitionBy("k")
    met = rows.withColumn("lo", F.min("cls").over(by_key)).withColumn("hi", F.max("cls").over(by_key)).filter("h <> 0 or lo <> hi")
    return met.select("cls", F.when(F.col("h") == 0, F.col("k")).otherwise(F.col("h")).alias("h")).groupBy("cls").agg(F.collect_set("h").alias("hs"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_COUNTERS, dtype=np.int64)
    for batch in batches:
        h = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=_COUNTERS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array((used // _BLOCK).astype(np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["block", "slot", "n"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of slots, whose counts of all tasks are here: a byte a slot, eight steps for each doubling.

    Pivots only need one order for all, so the driver gets 2^20 bytes at most and no counts.
    """
    counts = np.zeros(_COUNTERS, dtype=np.int64)
    seen = np.zeros(_COUNTERS // _BLOCK, dtype=bool)
    for batch in batches:
        seen[batch.column(0).to_numpy()] = True
        np.add.at(counts, batch.column(1).to_numpy(), batch.column(2).to_numpy())
    blocks = np.flatnonzero(seen)
    levels = np.minimum(8 * np.log2(counts.reshape(-1, _BLOCK)[blocks] + 1), 255).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([x.tobytes() for x in levels], pa.binary())], names=["block", "levels"])


def _frequencies(lists: DataFrame) -> DataFrame:
    """block, levels: how often the shingles of each slot occur."""
    counted = lists.select("hs").mapInArrow(H.released(_counted), "block int, slot int, n long")
    return counted.repartition("block").mapInArrow(H.released(_levels), "block int, levels binary")


def _pivots(percent: int, counters):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counters.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("hs"))
            have = np.asarray(lists.value_lengths())
            h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            row = np.repeat(np.arange(len(lists)), have)
            cls = batch.column(batch.schema.get_field_index("cls")).to_numpy().view(np.uint64)
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            order = np.lexsort((h, table[(h >> np.uint64(44)).astype(np.int64)], row))
            h, row = h[order], row[order]
            place = np.arange(len(h)) - (np.cumsum(have) - have)[row]
            rare = place < (have - _need(n, percent) + 1)[row]
            h, c = h[rare], cls[row[rare]]
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            same = h[1:] == h[:-1]
            # inside the batch classes with a pivot in common are chained; its first class stands for the batch
            pairs = np.unique(np.stack([c[:-1][same], c[1:][same]], axis=1), axis=0) if same.any() else np.empty((0, 2), np.uint64)
            first = np.append(True, ~same) if len(h) else np.empty(0, bool)
            k = np.concatenate([h[first], H.join2(pairs[:, 0], pairs[:, 1])])
            a = np.concatenate([c[first], pairs[:, 0]])
            b = np.concatenate([np.zeros(int(first.sum()), np.uint64), pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (k, a)] + [pa.array(b.view(np.int64), mask=np.arange(len(b)) < first.sum())], names=["k", "a", "b"])

    return of


class _Sets:
    """The shingle sets of some classes."""

    def __init__(self, rows: np.ndarray, hashes: np.ndarray, n: int):
        self.size = np.bincount(rows, minlength=n)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.hashes = hashes

    def of(self, x: int) -> np.ndarray:
        return self.hashes[self.at[x] : self.at[x + 1]]


class _Index:
    """From a shingle to those of the given classes that hold it."""

    def __init__(self, sets: _Sets, classes: np.ndarray):
        many = sets.size[classes]
        row = np.repeat(np.arange(len(classes)), many)
        held = sets.hashes[np.repeat(sets.at[classes] - (np.cumsum(many) - many), many) + np.arange(len(row))]
        order = np.argsort(held, kind="stable")
        self.hashes, self.row, self.n = held[order], row[order], len(classes)

    def shared(self, some: np.ndarray) -> np.ndarray:
        """Size of the intersection of a set with every class."""
        first = np.searchsorted(self.hashes, some, side="left")
        many = np.searchsorted(self.hashes, some, side="right") - first
        where = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.bincount(self.row[where], minlength=self.n)


def _join(sets: _Sets, percent: int, asked: np.ndarray, comp: np.ndarray, all_asked: bool = False, log: list | None = None) -> list[tuple[int, int]]:
    """Links that connect the asked classes with all classes, until nothing can be connected any more.

    comp: what is connected already.  all_asked: every pair has both its classes among the asked ones, so the largest
    component need not ask.  log gets (depth, asked, members) of each cell.
    """
    edges: list[tuple[int, int]] = []
    comp, size = comp.copy(), sets.size
    r = 1 - percent / 100 + 1e-9

    def tie(x: int, linked: np.ndarray) -> None:
        for y in linked[comp[linked] != comp[x]].tolist():
            if comp[y] != comp[x]:
                edges.append((x, y))
                comp[comp == comp[y]] = comp[x]

    cells = [(0, asked, np.arange(len(size)), False)]
    while cells:
        depth, left, members, whole = cells.pop()
        asked = _open(left, members, comp, all_asked and not depth)
        if not len(asked):
            continue
        if log is not None:
            log.append((depth, len(asked), len(members)))
        many = min(_PIVOTS, math.isqrt(len(asked)))
        if whole or len(asked) <= many or len(members) <= _LEAF:  # each asked class is a pivot
            index = _Index(sets, members)
            for x in asked.tolist():
                if (comp[members] != comp[x]).any():
                    common = index.shared(sets.of(x))
                    tie(x, members[100 * common >= percent * (size[members] + size[x] - common)])
            continue
        both = np.union1d(left, members)
        index = _Index(sets, both)
        place = np.searchsorted(both, members)
        far = np.empty((0, len(both)))
        while len(asked) and len(far) < many:
            # the next pivot is an asked class as far from the others as can be
            x = int(asked[far[:, np.searchsorted(both, asked)].min(axis=0).argmax()]) if len(far) else int(asked[0])
            common = index.shared(sets.of(x))
            union = size[both] + size[x] - common
            far = np.vstack([far, 1 - common / np.maximum(union, 1)])
            tie(x, members[(100 * common >= percent * union)[place]])
            # from all that are left: another component may have become the largest
            left = left[left != x]
            asked = _open(left, members, comp, all_asked and not depth)
        if not len(asked):
            continue
        cell = far[:, place].argmin(axis=0)
        mine = far[:, np.searchsorted(both, asked)]
        cut = []
        for c in np.unique(cell).tolist():
            inside = far[:, place[cell == c]]
            reach = ((mine >= inside.min(axis=1)[:, None] - r) & (mine <= inside.max(axis=1)[:, None] + r)).all(axis=0)
            if reach.any():
                cut.append((depth + 1, asked[reach], members[cell == c], False))
        # where windows spare less than half of the comparisons the classes are too close to each other for cells
        if sum(len(a) * len(m) for _, a, m, _ in cut) > 0.5 * len(asked) * len(members):
            cut = [(depth + 1, asked, members, True)]
        cells += cut
    return edges


def _open(asked: np.ndarray, members: np.ndarray, comp: np.ndarray, all_asked: bool) -> np.ndarray:
    """The asked classes that have a member of another component, but those of the largest one if all are asked."""
    found, n = np.unique(comp[members], return_counts=True)
    if len(found) == 1 or all_asked:
        return asked[comp[asked] != found[n.argmax()]]
    return asked


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], k: int):
    """For rows sorted by their keys: (key, batch of the group's rows, rows, shingles)."""
    held: list[pa.RecordBatch] = []
    now = None

    def done():
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rows, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for words in H.words_of(table.column(table.schema.get_field_index("text")), H.BLANK, True):
            r, h = _sets(words, k)
            rows.append(r + words.first_row)
            hashes.append(h)
        rows, hashes = np.concatenate(rows), np.concatenate(hashes)
        # rows that share a doc_id may differ in text: of each class one row stays, with the text of the class
        cls = table.column(table.schema.get_field_index("cls")).to_numpy()
        meant = _classes(rows, hashes, len(cls))[1].view(np.int64) == cls
        if not meant.all():
            renumbered = np.cumsum(meant) - 1
            stay = meant[rows]
            rows, hashes = renumbered[rows[stay]], hashes[stay]
            table = table.filter(pa.array(meant))
        return now, table, rows, hashes

    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(values[a].tolist())
            if held and key != now:
                yield done()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def _edges_batch(cls: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = [cls[x] for x, _ in edges], [cls[y] for _, y in edges]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _small(k: int, percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, rows, hashes in _groups(batches, ["root"], k):
            cls = table.column(table.schema.get_field_index("cls")).to_numpy()
            n = len(cls)
            yield _edges_batch(cls, _join(_Sets(rows, hashes, n), percent, np.arange(n), np.arange(n), True))

    return of


def _stars(k: int, percent: int):
    """For each part of a region, its pivots first: distances of every class, and links with pivots."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (root, _), table, rows, hashes in _groups(batches, ["root", "part"], k):
            cls = table.column(table.schema.get_field_index("cls")).to_numpy()
            pivot = table.column(table.schema.get_field_index("pivot")).to_numpy(zero_copy_only=False)
            sets = _Sets(rows, hashes, len(cls))
            at = np.flatnonzero(pivot)
            at = at[np.argsort(cls[at])]
            mine = np.flatnonzero(~pivot)
            index = _Index(sets, mine)
            both = np.array([index.shared(sets.of(x)) for x in at.tolist()]).reshape(len(at), len(mine))
            union = sets.size[mine][None, :] + sets.size[at][:, None] - both
            far = 1 - both / np.maximum(union, 1)
            linked = 100 * both >= percent * union
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([root] * len(mine), pa.int64()),
                    pa.array(cls[mine], pa.int64()),
                    pa.array(far.T.tolist(), pa.list_(pa.float64())),
                    pa.array([cls[at[linked[:, j]]].tolist() for j in range(len(mine))], pa.list_(pa.int64())),
                ],
                names=["root", "cls", "far", "links"],
            )

    return of


def _cells(k: int, percent: int):
    """For each part of a cell, with a block of replicas: links of the replicas with classes of other components."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, rows, hashes in _groups(batches, ["root", "cell", "part", "block"], k):
            cls = table.column(table.schema.get_field_index("cls")).to_numpy()
            comp = np.unique(table.column(table.schema.get_field_index("comp")).to_numpy(), return_inverse=True)[1]
            asked = np.flatnonzero(table.column(table.schema.get_field_index("replica")).to_numpy(zero_copy_only=False))
            yield _edges_batch(cls, _join(_Sets(rows, hashes, len(cls)), percent, asked, comp))

    return of


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _join_large(members: DataFrame, k: int, percent: int, rounds: int = 4) -> DataFrame:
    """Edges of the large regions (root, size, cls, text)."""
    edges = None
    outside = members.select("root", "cls")
    parts = F.ceil(F.col("size") / _TASK).cast("long")
    placed = members.withColumn("part", F.pmod(F.xxhash64("cls"), parts))
    for turn in range(rounds):
        chosen = outside.withColumn("_salt", F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(_PIVOTS))).groupBy("root", "_salt").agg(F.min_by("cls", F.xxhash64("cls", F.lit(turn + 100))).alias("cls"))
        pivots = members.join(chosen.select("root", "cls"), ["root", "cls"], "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        both = placed.select("root", "part", "cls", "text", F.lit(False).alias("pivot")).unionByName(pivots.select("root", "part", "cls", "text", F.lit(True).alias("pivot")))
        stars = materialise(_dealt(both, "root", "part").mapInArrow(H.released(_stars(k, percent)), "root long, cls long, far array<double>, links array<long>"), "stars")
        found = stars.select(F.col("cls").alias("a"), F.explode("links").alias("b")).filter("a <> b")
        edges = materialise(found if edges is None else edges.unionByName(found), "star-edges")
        comps = connected_components(edges, "edges", _EDGES)
        state = members.select("root", "cls").join(comps.select(F.col("node").alias("cls"), F.col("root").alias("_comp")).hint("merge"), "cls", "left").select("root", "cls", F.coalesce("_comp", "cls").alias("comp"))
        state = materialise(state, "components")
        sizes = state.groupBy("root", "comp").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("root").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
        outside = materialise(state.join(main, "root").filter("comp <> main").select("root", "cls", "comp"), "outside")
        left = outside.count()
        if left <= _TASK or turn and left > 0.7 * before:
            break
        before = left  # noqa: F841 (used in the next turn)
    near = stars.join(state.hint("merge"), ["root", "cls"]).select("root", "cls", "comp", "far", F.expr("array_position(far, array_min(far)) - 1").cast("long").alias("cell"))
    near = materialise(near, "cells")
    cells = near.groupBy("root", "cell").agg(F.max(F.expr("far[cell]")).alias("radius"), F.count(F.lit(1)).alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / _TASK).cast("long"))
    texts = members.select("cls", "text")
    # blocks of replicas: each goes to the cells that its triangle window reaches
    blocks = outside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / _TASK).cast("long").alias("blocks"))
    mine = near.join(outside.select("cls").hint("merge"), "cls", "left_semi").join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")))
    reach = mine.select("root", "cls", "comp", "far", "block").join(cells.select("root", "cell", "radius", "parts"), "root").filter(F.expr("far[cell]") <= F.col("radius") + (1 - percent / 100) + 1e-9)
    replicas = reach.select("root", "cell", "cls", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    replicas = materialise(replicas, "replicas")
    used = replicas.select("root", "cell", "part", "block").distinct()
    owners = near.join(cells.select("root", "cell", "parts"), ["root", "cell"]).select("root", "cell", "cls", "comp", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"))
    owners = owners.join(used, ["root", "cell", "part"]).join(replicas.select("root", "cell", "part", "block", "cls").hint("merge"), ["root", "cell", "part", "block", "cls"], "left_anti")
    columns = ["root", "cell", "part", "block", "cls", "comp"]
    rows = owners.select(*columns, F.lit(False).alias("replica")).unionByName(replicas.select(*columns, F.lit(True).alias("replica")))
    found = _dealt(rows.join(texts.hint("merge"), "cls"), "root", "cell", "part", "block").mapInArrow(H.released(_cells(k, percent)), "a long, b long")
    return edges.unionByName(materialise(found, "cell-edges"))


def classes(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and cls (0: no shingles) of every document."""
    return docs.select("doc_id", text).mapInArrow(H.released(_documents(text, k)), "doc_id long, n_shingles long, cls long")


def by_class(of: DataFrame) -> DataFrame:
    """cls, doc_id (the smallest), n: a row for each class, written once."""
    return materialise(of.filter("cls <> 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")), "classes")


def links(docs: DataFrame, by_class: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) between classes that connect all linked classes: every one is a link, and none that connects is lost."""
    spark = docs.sparkSession
    named = docs.filter(F.col("doc_id").isNotNull())
    kind = "k long, h long, cls long"
    first = _shared(named.select(text).mapInArrow(H.released(_shingles(text, k, percent, False)), kind)).join(by_class.hint("merge"), "cls")
    # a partner has percent n / 100 shingles at least, and its spare ones are shared with this class
    spare = F.ceil(F.ceil(F.col("n") * percent / 100) * _SPARE / 100)
    likely = first.filter(F.size("hs") >= F.greatest(spare, F.lit(1))).drop("hs")
    texts = named.select("doc_id", F.col(text).alias("text"))
    likely = materialise(texts.join(likely.hint("merge"), "doc_id").select("cls", "n", "text"), "likely")
    lists = _shared(likely.select("cls", "text").mapInArrow(H.released(_shingles("text", k, percent, True)), kind)).join(by_class.select("cls", "n").hint("merge"), "cls")
    lists = materialise(lists.filter(F.size("hs") >= F.ceil(F.col("n") * percent / 100)), "shared")
    table = np.zeros((_COUNTERS // _BLOCK, _BLOCK), dtype=np.uint8)
    for block, levels in _frequencies(lists).collect():  # _COUNTERS bytes at most
        table[block] = np.frombuffer(levels, np.uint8)
    counters = spark.sparkContext.broadcast(table.reshape(-1))
    near = lists.mapInArrow(H.released(_pivots(percent, counters)), "k long, a long, b long")
    before = F.lag("a").over(Window.partitionBy("k").orderBy("a"))
    pairs = near.select("a", F.coalesce("b", before).alias("b")).filter("b is not null and a <> b")
    regions = connected_components(pairs, "regions", _EDGES).withColumnRenamed("node", "cls")
    regions = materialise(regions.join(by_class.hint("merge"), "cls"), "regions")
    # a region counts as its classes, or as many as its shingles would make at _SET each
    sizes = regions.groupBy("root").agg(F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") / _SET)).cast("long").alias("size"))
    # only large regions, of which there are few, need their size
    large = F.broadcast(sizes.filter(F.col("size") > _TASK))
    members = regions.select("cls", "root").join(large, "root", "left").fillna(1, ["size"])
    # rows that share a doc_id may differ in text: the class says which row is meant
    members = materialise(likely.select("cls", "text").join(members.hint("merge"), "cls").select("root", "size", "cls", "text"), "members")
    few = _dealt(members.filter(F.col("size") <= _TASK).select("root", "cls", "text"), "root")
    edges = materialise(few.mapInArrow(H.released(_small(k, percent)), "a long, b long"), "links")
    many = members.filter(F.col("size") > _TASK)
    if not many.isEmpty():
        edges = edges.unionByName(_join_large(many, k, percent))
    return edges


def components(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
    every = materialise(classes(docs, text, k), "documents")
    firsts = by_class(every)
    comps = connected_components(links(docs, firsts, text, k, percent), "links", _EDGES).withColumnRenamed("node", "cls")
    # components are named through their classes, copies of a text being one; a component of very many classes is dealt out by salt
    named = firsts.select("cls", "doc_id").join(comps.hint("merge"), "cls").withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(_SALTS)).cast("int"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    connected = named.join(ids.hint("merge"), ["root", "_salt"]).select("cls", "component_id")
    every_class = materialise(firsts.join(connected.hint("merge"), "cls", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id")), "class-components")
    out = every.join(every_class.hint("merge"), "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
