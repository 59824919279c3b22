"""Benchmark decontamination with suffix arrays over training shards.

Up to 4 MB of consecutive documents are a shard.  Its words are numbered by the
benchmark's vocabulary (0: not in it), and a sparse suffix array is built over
the places where a match of full length can begin at all: a run of vocabulary
words at least as long as a window, opening with a word pair that opens some
benchmark window.  Every benchmark suffix that opens a window is then
binary-searched in the shard, all together, one word deeper at a time, to the
end of its window: that gives the range of all places where the window occurs.
Suffixes in the last ``window`` - 1 words of a longer item open none and are not
searched: what they match beyond a window is part of a longer match, and a match
shorter than a window counts for nothing.  How far the matches reach is found
from one suffix array of the hit stretches and the items they hit, by doubling
(1, 2, 4, ... words): the longest match of a place is with one of the benchmark
suffixes next to it in that order.  So a match of thousands of words costs no
more steps than its logarithm.  ``matches`` gives the places of all matches.

A document lies in one shard as a whole, so nothing is shuffled.  The
benchmark is broadcast in blocks of at most ``block_bytes`` of text.  A worker
holds the index of one block at a time: with one block it is kept for all
shards, with more each goes over ``HELD_BYTES`` of documents before the next is
built.  The blocks of one pass have ``pass_bytes`` at most, which bounds what is
broadcast and what the driver holds; a larger benchmark takes several passes,
each of which writes the documents with what was found so far to the shared
folder.

Defined results: null or wordless text has 0 words and no hits; a null or
wordless item has no windows; repeated rows are judged alike, each on its own;
items that share an id count once; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import hashing as H
from loomspan.llm.common import aside, materialise

WINDOW = 10
BLOCK_BYTES = 16 << 20
PASS_BYTES = 256 << 20
HELD_BYTES = 32 << 20
_SHARD_BYTES = 4 << 20
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


@dataclass
class Suffixes:
    """A block of benchmark items: vocabulary, item words one after another, windows."""

    names: list[str]
    vocabulary: np.ndarray
    ids: np.ndarray  # 0 closes each item
    item: np.ndarray  # item of each word
    left: np.ndarray  # words from here to the end of the item
    width: np.ndarray  # window that begins here, 0: none
    widths: list[int]
    openings: dict[int, np.ndarray]  # width -> hashes of the first one or two word ids


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def build_suffixes(names: list[str], texts: list[str | None], window: int) -> Suffixes:
    words = list(H.words_of(pa.array(texts, pa.string()), H.ALNUM, True, max_bytes=1 << 40))
    hashes = words[0].hashes if words else np.empty(0, np.uint64)
    lengths = np.diff(words[0].doc_off) if words else np.empty(0, np.int64)
    vocabulary = np.unique(hashes)
    n = len(hashes) + len(lengths)
    ids, item, left, width = (np.zeros(n, dtype=np.int64) for _ in range(4))
    ends = np.cumsum(lengths + 1)
    inside = np.ones(n, dtype=bool)
    inside[ends - 1] = False
    ids[inside] = np.searchsorted(vocabulary, hashes) + 1
    item[:] = np.repeat(np.arange(len(lengths)), lengths + 1)
    left[:] = np.repeat(ends - 1, lengths + 1) - np.arange(n)
    size = np.minimum(lengths, window)[item] if n else left
    width = np.where(inside & (left >= size), size, 0)
    widths = sorted({int(w) for w in width} - {0})
    after = np.append(ids[1:], 0)
    openings = {w: np.unique(_pair(ids[width == w], after[width == w] if w > 1 else np.int64(0))) for w in widths}
    return Suffixes(names, vocabulary, ids, item, left, width, widths, openings)


def _suffix_array(ids: np.ndarray, run: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at``, sorted by the words that follow (0 beyond the run), up to ``depth`` words."""
    rank = np.zeros(len(at), dtype=np.int64)
    order = np.arange(len(at))
    for d in range(0, depth, 2):
        step = [np.where(d + k < run[at], ids[np.minimum(at + d + k, len(ids) - 1)], 0) for k in (0, 1)]
        key = _pair(*step)
        order = np.lexsort((key, rank))
        new = np.empty(len(at), dtype=np.int64)
        change = (np.diff(rank[order]) != 0) | (np.diff(key[order]) != 0)
        new[order] = np.concatenate([[0], np.cumsum(change)])
        rank = new
        if len(at) == 0 or rank.max() == len(at) - 1:
            break
    return at[np.argsort(rank, kind="stable")]


def search(words: H.Words, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, suffix, ids): pairs where the window that begins the suffix occurs, and the shard's words by number.

    One suffix stands for all that begin with the same window.
    """
    n = len(words.hashes)
    none = np.empty(0, dtype=np.int64)
    if not n or not len(s.vocabulary):
        return none, none, none
    spot = np.searchsorted(s.vocabulary, words.hashes)
    spot[spot == len(s.vocabulary)] = 0
    ids = np.where(s.vocabulary[spot] == words.hashes, spot + 1, 0)
    # words of the vocabulary from each place on, within its document
    stop = np.zeros(n + 1, dtype=bool)
    stop[:-1] = ids == 0
    ends = words.doc_off[1:]
    places = np.unique(np.concatenate([np.flatnonzero(stop), ends]))
    ahead = places[np.searchsorted(places, np.arange(n), side="right")]  # a place is also where the next document begins
    ahead = np.minimum(ahead, np.repeat(ends, np.diff(words.doc_off)))
    run = np.where(ids > 0, ahead - np.arange(n), 0)
    after = np.append(ids[1:], 0)
    may = np.zeros(n, dtype=bool)
    for w, opening in s.openings.items():
        here = np.flatnonzero(run >= w)
        may[here[np.isin(_pair(ids[here], after[here] if w > 1 else np.int64(0)), opening)]] = True
    at = np.flatnonzero(may)
    if not len(at):
        return none, none, ids
    deep = max(s.widths)
    sa = _suffix_array(ids, run, at, deep)

    # all suffixes that begin a window go down together; lo..hi is the range of each
    suffix = np.flatnonzero(s.width > 0)
    lo, hi = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(sa))
    group = np.zeros(len(sa), dtype=np.int64)
    mine = np.zeros(len(suffix), dtype=np.int64)
    size = len(s.vocabulary) + 1
    found_at, found_suffix = [], []
    for d in range(deep):
        word = np.where(d < run[sa], ids[np.minimum(sa + d, n - 1)], 0)
        key = group * size + word
        go = np.flatnonzero(s.width[suffix] > d)
        suffix, lo, hi, mine = suffix[go], lo[go], hi[go], mine[go]
        want = mine * size + s.ids[suffix + d]
        new_lo, new_hi = np.searchsorted(key, want, side="left"), np.searchsorted(key, want, side="right")
        go = np.flatnonzero(new_hi > new_lo)
        if not len(go):
            break
        suffix, lo, hi = suffix[go], new_lo[go], new_hi[go]
        group = np.concatenate([[0], np.cumsum(np.diff(key) != 0)])
        mine = group[lo]
        full = np.flatnonzero(s.width[suffix] == d + 1)
        for (a, b), first in {(int(lo[i]), int(hi[i])): int(suffix[i]) for i in full[::-1]}.items():
            found_at.append(sa[a:b])
            found_suffix.append(np.full(b - a, first))
    if not found_at:
        return none, none, ids
    return np.concatenate(found_at), np.concatenate(found_suffix), ids


def _reach(stretches: np.ndarray, is_end: np.ndarray, n_shard: int, asked: np.ndarray) -> np.ndarray:
    """For the asked places of the first n_shard words: words of the longest match with a place behind them.

    stretches: word numbers, each stretch closed by a place marked in is_end, at which no match goes on.
    """
    n = len(stretches)
    alone = np.where(is_end, int(stretches.max()) + 1 + np.arange(n), stretches)
    ranks, k = [np.unique(alone, return_inverse=True)[1]], 1
    while int(ranks[-1].max()) < n - 1:
        ahead = np.append(ranks[-1][k:], np.zeros(min(k, n), np.int64))
        ranks.append(np.unique(_pair(ranks[-1], ahead), return_inverse=True)[1])
        k *= 2
    order = np.argsort(ranks[-1])
    spot = np.empty(n, dtype=np.int64)
    spot[order] = np.arange(n)
    behind = (order >= n_shard) & ~is_end[order]
    before = np.maximum.accumulate(np.where(behind, np.arange(n), -1))[spot[asked]]
    after = np.minimum.accumulate(np.where(behind, np.arange(n), n)[::-1])[::-1][spot[asked]]
    best = np.zeros(len(asked), dtype=np.int64)
    for other, has in ((order[before], before >= 0), (order[np.minimum(after, n - 1)], after < n)):
        p, q, length = asked.copy(), other.copy(), np.zeros(len(asked), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            same = (p < n) & (q < n)
            same[same] = ranks[level][p[same]] == ranks[level][q[same]]
            p, q, length = p + (same << level), q + (same << level), length + (same << level)
        best = np.maximum(best, np.where(has, length, 0))
    return best


def _window_ranks(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` words at the places, equal for equal windows."""
    rank, have = ids, 1
    while have < width:
        step = min(have, width - have)
        rank = np.unique(_pair(rank[:-step], rank[step:]), return_inverse=True)[1]
        have += step
    return rank[at]


class Index:
    """A block with its equal windows: for each window's first place, all items and places that hold it (arrays only)."""

    def __init__(self, names: list[str], texts: list[str | None], window: int):
        self.s = s = build_suffixes(names, texts, window)
        self.window = window
        self.begins = np.searchsorted(s.item, np.arange(len(names)))
        group, n_groups = np.full(len(s.ids), -1), 0
        for w in s.widths:
            at = np.flatnonzero(s.width == w)
            found, mine = np.unique(_window_ranks(s.ids, at, w), return_inverse=True)
            group[at] = mine + n_groups
            n_groups += len(found)
        self.group = group
        at = np.flatnonzero(group >= 0)
        at = at[np.argsort(group[at], kind="stable")]
        self.place, self.place_of = at, np.searchsorted(group[at], np.arange(n_groups + 1))
        both = np.unique(np.stack([group[at], s.item[at]]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        self.item, self.item_of = both[1], np.searchsorted(both[0], np.arange(n_groups + 1))

    def spread(self, values: np.ndarray, of: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the suffixes, value) for all values of the windows that the suffixes begin."""
        g = self.group[suffix]
        many = of[g + 1] - of[g]
        which = np.repeat(np.arange(len(suffix)), many)
        return which, values[np.repeat(of[g] - (np.cumsum(many) - many), many) + np.arange(len(which))]


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def mark(words: H.Words, index: Index) -> tuple[np.ndarray, list[set[str]], np.ndarray]:
    """For the rows of a slice: which words are hit, the items found, the longest match."""
    s = index.s
    place, suffix, ids = search(words, s)
    n = len(words.hashes)

    def covered(some: np.ndarray) -> np.ndarray:
        step = np.zeros(n + 1, dtype=np.int64)
        np.add.at(step, place[some], 1)
        np.add.at(step, place[some] + s.width[suffix[some]], -1)
        return np.cumsum(step[:-1]) > 0

    hit = covered(np.ones(len(place), dtype=bool))
    row = words.row_of_word()
    names: list[set[str]] = [set() for _ in range(words.n_rows)]
    best = np.zeros(words.n_rows, dtype=np.int64)
    if not len(place):
        return hit, names, best
    pairs = np.unique(np.stack([row[place], suffix]), axis=1)
    which, item = index.spread(index.item, index.item_of, pairs[1])
    for r, i in np.unique(np.stack([pairs[0][which], item]), axis=1).T.tolist():
        if s.names[i] is not None:
            names[r].add(s.names[i])
    np.maximum.at(best, row[place], s.width[suffix])
    long = s.width[suffix] == index.window  # an item that is one window ends with it
    if long.any():
        inside = covered(long)
        at = np.flatnonzero(inside)
        stop = np.append((np.diff(at) > 1) | (np.diff(row[at]) > 0), True)
        # each stretch with a place behind it that ends it, then the items
        new = np.arange(len(at)) + np.append(0, np.cumsum(stop)[:-1])
        n_shard = len(at) + int(stop.sum())
        ours, end = np.zeros(n_shard, dtype=np.int64), np.ones(n_shard, dtype=bool)
        ours[new], end[new] = ids[at], False
        some = np.zeros(len(s.names), dtype=bool)
        some[index.spread(index.item, index.item_of, np.unique(suffix[long]))[1]] = True
        theirs = s.ids[some[s.item]]
        asked = np.unique(place[long])
        found = _reach(np.append(ours, theirs), np.append(end, theirs == 0), n_shard, new[np.searchsorted(at, asked)])
        np.maximum.at(best, row[asked], found)
    return hit, names, best


def _passes(benchmark: DataFrame, block_bytes: int, pass_bytes: int) -> Iterator[tuple[list, bool]]:
    """(broadcast blocks, whether they are the last) of each pass; no block is larger than block_bytes of text (or one item)."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id", "text")
    blocks, names, texts, held, passed = [], [], [], 0, 0
    for r in rows.toLocalIterator():
        if held and held + len(r["text"] or "") > block_bytes:
            blocks.append(context.broadcast((names, texts)))
            names, texts, passed, held = [], [], passed + held, 0
            if passed >= pass_bytes:
                yield blocks, False
                blocks, passed = [], 0
        names.append(r["item_id"])
        texts.append(r["text"])
        held += len((r["text"] or "").encode())
    yield [*blocks, context.broadcast((names, texts))], True


_INDEX: dict[tuple, Index] = {}


def _index(block, window: int) -> Index:
    """The index of a block; a worker holds one."""
    names, texts = block.value
    key = (window, hash((tuple(names), tuple(texts))))
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = Index(names, texts, window)
    return _INDEX[key]


def _held(batches: Iterator[pa.RecordBatch], text: str, many: bool) -> Iterator[pa.RecordBatch]:
    """The batches; where the index changes from block to block, several as one, up to HELD_BYTES."""
    some: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not many:
            yield batch
            continue
        some.append(batch)
        size += batch.column(batch.schema.get_field_index(text)).nbytes
        if size >= HELD_BYTES:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, size = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def _spans(words: H.Words, index: Index) -> Iterator[tuple[int, str | None, int, int, int]]:
    """(row, item, word in the item, word in the row, words) of all maximal matches that hold a window."""
    s = index.s
    place, suffix, _ = search(words, s)
    row = words.row_of_word()
    which, other = index.spread(index.place, index.place_of, suffix)
    place = place[which]
    order = np.lexsort((place, place - other))  # windows of one match lie on one diagonal, next to each other
    place, other = place[order], other[order]
    if not len(place):
        return
    goes_on = (np.diff(place) == 1) & (np.diff(other) == 1) & (row[place[1:]] == row[place[:-1]]) & (s.item[other[1:]] == s.item[other[:-1]])
    first = np.flatnonzero(np.append(True, ~goes_on))
    last = np.append(first[1:], len(place)) - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        p, q = int(place[a]), int(other[a])
        r, item = int(row[p]), int(s.item[q])
        yield r, s.names[item], q - int(index.begins[item]), p - int(words.doc_off[r]), int(place[b]) - p + int(s.width[other[b]])


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """A row for each maximal verbatim match of a window at least: the document's key, item_id, item_place, place, length.

    Places are counted in words from 0; rows of a document that share a key each give their own.
    """

    def shard(blocks: list):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _held(batches, text, len(blocks) > 1):
                for block in blocks:
                    index = _index(block, window)
                    for words in H.words_of(batch.column(1), H.ALNUM, True, max_bytes=_SHARD_BYTES):
                        found = list(_spans(words, index))
                        keys = batch.column(0).take(pa.array([words.first_row + m[0] for m in found], pa.int64()))
                        rest = [pa.array([m[i] for m in found], t) for i, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))]
                        yield pa.RecordBatch.from_arrays([keys, *rest], names=[key, "item_id", "item_place", "place", "length"])

        return of

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id string, item_place long, place long, length long"
    out = None
    for blocks, last in _passes(benchmark, block_bytes, pass_bytes):
        found = docs.select(key, text).mapInArrow(H.released(shard(blocks)), schema)
        if not last:
            found = materialise(found, "matches")
            _forget(blocks)
        out = found if out is None else out.unionByName(found)
    return out


def _forget(blocks: list) -> None:
    for block in blocks:
        block.destroy()


_STATE = "_hit binary, _items array<string>, _longest long"


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents with, beside their own columns, what the benchmark has in common with each.

    Adds n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated
    and longest_match (words of the longest verbatim match that holds a window).  Own columns of these
    names are replaced.
    """
    added = [c.split()[0] for c in RESULT.split(", ")]
    state = [c.split()[0] for c in _STATE.split(", ")]
    docs, back = aside(docs, text)
    kept = docs.columns
    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def shard(blocks: list, began: bool, last: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _held(batches, text, len(blocks) > 1):
                column = batch.column(batch.schema.get_field_index(text))
                before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in state] if began else None
                hits: list[np.ndarray] = [np.empty(0, bool)] * batch.num_rows
                names: list[set[str]] = [set(before[1][i]) if began else set() for i in range(batch.num_rows)]
                best = np.array(before[2] if began else np.zeros(batch.num_rows), dtype=np.int64)
                for block in blocks:
                    index = _index(block, window)
                    for words in H.words_of(column, H.ALNUM, True, max_bytes=_SHARD_BYTES):  # a shard
                        hit, found, longest = mark(words, index)
                        for i in range(words.n_rows):
                            r, mine = words.first_row + i, hit[words.doc_off[i] : words.doc_off[i + 1]]
                            if block is blocks[0]:
                                hits[r] = mine | np.unpackbits(np.frombuffer(before[0][r], np.uint8), count=len(mine)).astype(bool) if began else mine
                            elif mine.any():
                                hits[r] = hits[r] | mine
                            if found[i]:
                                names[r] |= found[i]
                        at = slice(words.first_row, words.first_row + words.n_rows)
                        best[at] = np.maximum(best[at], longest)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                if last:
                    n_hit = [int(h.sum()) for h in hits]
                    lists = [sorted(x) for x in names]
                    columns += [pa.array([len(h) for h in hits], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64())]
                    columns += [pa.array([_digest(x) for x in lists], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(best)]
                else:
                    columns += [pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(best)]
                yield pa.RecordBatch.from_arrays(columns, names=kept + (added if last else state))

        return of

    now = docs.select(*[F.col(f"`{c}`") for c in kept])
    began = False
    for blocks, last in _passes(benchmark, block_bytes, pass_bytes):
        now = now.mapInArrow(H.released(shard(blocks, began, last)), f"{own}, {RESULT if last else _STATE}")
        if not last:
            now = materialise(now, "decontaminated")
            _forget(blocks)
        began = True
    return back(now, tuple(added))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a benchmark window."""
    renamed, back = aside(docs, text)
    return back(contamination(renamed, benchmark, text, window).filter(~F.col("contaminated")))
