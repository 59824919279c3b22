"""Substring dedup by level-wise doubling of repeated word windows.

Level 1 looks at windows of a quarter of the wanted length (4 words of 13), and
there only at each run's minimizer: a wanted window that is repeated carries the
same minimizer in each of its places.  Only what is repeated at one level, in
two documents or more, is extended to twice its length: 4 words to 8, to the
right where that stays inside the wanted window and to the left where not, and
windows of 8 to those of 13, the wanted length.  ``dedup`` ends there, as longer
windows change nothing for it (a repeated longer window consists of repeated
windows of the wanted length); ``longest_repeats`` doubles on, 26, 52, ...,
until no candidate survives.

Each level is one shuffle by hash, with one row for each hash and Arrow batch
that holds it, so a passage shared by a third of all documents is a few rows for
each batch; other documents of the batch are known to share the hash and are
dealt out by a key of their own.  What survives goes to its document.  The text
is dealt out once by doc_id and joined with what was found at each level; the
joins sort and spill, none builds a table in memory.

Hashes are 64 bits at each level, so two different windows are taken for one
only if their hashes and those of their parts at all levels agree.

Defined results: null text has no words and loses none; a row without doc_id
loses nothing and is nobody's source; rows that share a doc_id are judged each
on its own text, and none is the other's source; equal windows inside one
document don't count; windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm import hashing as H
from loomspan.llm.common import aside, materialise

WINDOW = 13
_ROWS = "k long, h long, doc_id long, known boolean"


def widths(window: int) -> list[int]:
    """Words of the windows at each level: a quarter, its double, and the wanted length."""
    first = -(-window // 4)
    return [w for w in (first, 2 * first) if w < window] + [window]


def _combine(hashes: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle from (hash, document) pairs of a batch.

    Of each hash the smallest document stands for the batch (k = h); other documents get a k of their own.  known: the
    batch alone shows that documents share the hash.
    """
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = hashes[1:] != hashes[:-1]
    known = ~first | ~np.append(first[1:], True) if len(first) else first
    k = np.where(first, hashes, H.join2(hashes, docs.astype(np.uint64)))
    # in the order of documents, which shuffle files compress well
    order = np.argsort(docs, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(k[order].view(np.int64)), pa.array(hashes[order].view(np.int64)), pa.array(docs[order]), pa.array(known[order])], names=["k", "h", "doc_id", "known"])


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(batch.schema.get_field_index("doc_id"))
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False)


def _listed(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each element of a list column of hashes."""
    lists = batch.column(batch.schema.get_field_index(name))
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _among(rows: np.ndarray, hashes: np.ndarray, listed_rows: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether each (row, hash) is among the listed pairs."""
    if not len(listed):
        return np.zeros(len(hashes), dtype=bool)
    of = lambda r, h: H.join2(r.astype(np.uint64) + np.uint64(1), h)
    return np.isin(of(rows, hashes), of(listed_rows, listed))


def _parts(words: H.Words, window: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all runs of ``width`` words, place of the part of each wanted window at this level, whether the window lies in one row)."""
    inside = H.starts_in_row(words.doc_off, window)
    if width == window:
        return H.windows(words.hashes, window), np.arange(len(inside)), inside
    first = widths(window)[0]
    anchor = H.minimizers(H.windows(words.hashes, first), window - first + 1)
    if width > first:  # the minimizer and the words after it, or before it where those would leave the window
        anchor = anchor - np.where(anchor - np.arange(len(anchor)) + width <= window, 0, width - first)
    return H.windows(words.hashes, width), anchor, inside


def _candidates(text: str, window: int, level: int):
    """Rows of the windows of one level, of those whose part at the level below is among the hashes of their row."""
    width, below = widths(window)[level], widths(window)[level - 1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, valid = _ids(batch)
            column = batch.column(batch.schema.get_field_index(text))
            if level:
                listed_rows, listed = _listed(batch, "hashes")
                column = pc.if_else(batch.column(batch.schema.get_field_index("hashes")).is_valid(), column, "")
            hashes, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for words in H.words_of(column, H.BLANK, False):
                grams, part, inside = _parts(words, window, width)
                row = words.first_row + words.row_of_word()
                if level:
                    lower, lower_part, _ = _parts(words, window, below)
                    used = np.unique(lower_part[inside])
                    alive = np.zeros(len(lower), dtype=bool)
                    alive[used] = _among(row[used], lower[used], listed_rows, listed)
                    inside = inside & alive[lower_part]
                used = np.unique(part[inside])
                used = used[valid[row[used]]]
                hashes.append(grams[used])
                docs.append(ids[row[used]])
            yield _combine(np.concatenate(hashes), np.concatenate(docs))

    return of


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list("h").alias("hashes"))


def _met(rows: DataFrame) -> DataFrame:
    """The rows with the smallest document of their hash, and whether it is in two documents or more."""
    by_key = Window.partitionBy("k")
    met = rows.withColumn("least", F.min("doc_id").over(by_key)).withColumn("most", F.max("doc_id").over(by_key))
    return met.withColumn("shared", F.expr("known or least < most")).withColumn("later", F.expr("k <> h or least < doc_id"))


def level_rows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> list[DataFrame]:
    """For each level its candidates (h, doc_id) with shared and later (a smaller doc_id has it); a level reads what the one below shares."""
    pairs = docs.select("doc_id", text)
    out: list[DataFrame] = []
    for level in range(len(widths(window))):
        # an outer join, so that the texts dealt out by doc_id are the same at all levels and in dedup(): dealt out once
        held = pairs.join(_lists(out[-1].filter("shared")).hint("merge"), "doc_id", "left").select("doc_id", text, "hashes") if level else pairs
        out.append(_met(held.mapInArrow(H.released(_candidates(text, window, level)), _ROWS)))
    return out


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id and the hashes of its windows that a smaller doc_id has as well."""
    return _lists(level_rows(docs, text, window)[-1].filter("later"))


def _removed(text: str, window: int, kept: list[str], with_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed_rows, listed = _listed(batch, "hashes")
            touched = np.zeros(batch.num_rows, dtype=bool)
            touched[listed_rows] = True
            n_words, n_removed, digests, texts = [], [], [], []
            column = batch.column(batch.schema.get_field_index(text))
            for words in H.words_of(column, H.BLANK, False):
                n = len(words.hashes)
                grams = H.windows(words.hashes, window)
                row = words.first_row + words.row_of_word()
                at = np.flatnonzero(H.starts_in_row(words.doc_off, window) & touched[row[: len(grams)]])
                at = at[_among(row[at], grams[at], listed_rows, listed)]
                gone = H.covered(at, window, n)
                sums = np.concatenate([[0], np.cumsum(gone)])[words.doc_off]
                n_words += np.diff(words.doc_off).tolist()
                n_removed += np.diff(sums).tolist()
                raw = words.raw.tobytes()
                for i in range(words.n_rows):
                    body = raw[words.at[i] : words.at[i + 1]]
                    if sums[i + 1] == sums[i]:
                        left = None
                        pieces = body.split()
                    else:
                        mine = slice(words.doc_off[i], words.doc_off[i + 1])
                        stay = ~gone[mine]
                        pieces = [w for w, s in zip(body.split(), stay.tolist(), strict=True) if s]
                        left = _left(body, words.starts[mine] - words.at[i], words.ends[mine] - words.at[i], stay) if with_text else None
                    digests.append(hashlib.sha256(b" ".join(pieces)).hexdigest())
                    if with_text:
                        texts.append(left)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = [*kept, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("left_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return of


def _left(body: bytes, starts: np.ndarray, ends: np.ndarray, stay: np.ndarray) -> str:
    """The text without its removed words: each kept run with the white space inside it, runs joined by a line feed."""
    edge = np.diff(np.concatenate([[0], stay.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return b"\n".join(body[starts[a] : ends[b]] for a, b in zip(first, last, strict=True)).decode("utf-8", "replace")


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The documents with n_words, n_removed, kept_sha256 (the kept words joined by one blank) instead of their text.

    with_text: the text stays, and left_text is what is left of it (null where nothing is removed).
    """
    added = ("n_words", "n_removed", "kept_sha256", *(("left_text",) if with_text else ()))
    docs, back = aside(docs, "doc_id", text)
    kept = [c for c in docs.columns if with_text or c != text]
    found = repeated_windows(docs, text, window)
    own = docs.columns
    joined = docs.select(*own).join(found.hint("merge"), "doc_id", "left").select(*own, "hashes")
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["n_words long, n_removed long, kept_sha256 string"]
    return back(joined.mapInArrow(H.released(_removed(text, window, kept, with_text)), ", ".join(fields + (["left_text string"] if with_text else []))), added)


def longest_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, words: the longest of window, 2 x window, 4 x window, ... at which it holds a window of an earlier document."""
    pairs = docs.select("doc_id", F.col(text).alias("text"))
    width = window
    rows = level_rows(pairs, "text", window)[-1]
    out = None
    while True:
        shared = materialise(rows.filter("shared").select("doc_id", "h", "later"), "repeats")
        found = shared.filter("later").select("doc_id", F.lit(width).alias("words")).distinct()
        out = found if out is None else out.unionByName(found)
        if shared.isEmpty():
            return out.groupBy("doc_id").agg(F.max("words").alias("words"))
        width *= 2
        rows = _met(pairs.join(_lists(shared).hint("merge"), "doc_id").mapInArrow(H.released(_doubled(width)), _ROWS))


def _doubled(width: int):
    """Rows of the windows of ``width`` words both halves of which are among the hashes of their row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = _ids(batch)
            listed_rows, listed = _listed(batch, "hashes")
            hashes, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for words in H.words_of(batch.column(batch.schema.get_field_index("text")), H.BLANK, False):
                half = width // 2
                row = words.first_row + words.row_of_word()
                short = H.windows(words.hashes, half)
                alive = H.starts_in_row(words.doc_off, half) & _among(row[: len(short)], short, listed_rows, listed)
                at = np.flatnonzero(H.starts_in_row(words.doc_off, width))
                at = at[alive[at] & alive[at + half]]
                hashes.append(H.windows(words.hashes, width)[at])
                docs.append(ids[row[at]])
            yield _combine(np.concatenate(hashes), np.concatenate(docs))

    return of
