"""Best-fit packing planned on the histogram of lengths.

Documents are encoded and cut into pieces of at most ``capacity`` ids; only the
piece table (no ids) is kept.  The driver sees one number for each length
(``capacity`` at most) and plans best-fit-decreasing over these counts: a whole
class of equally filled sequences takes a whole class of equal pieces in one
step.  The plan is a list of runs (length, first rank, how many, first
sequence, offset); its size depends on ``capacity``, not on the documents.
Pieces then take their slots by joining on their rank within their length.

Ranks are made from counts in buckets and row numbers within a bucket, so a
length that a third of all pieces has is not ranked in one task.

Defined results: null or empty text is the end id alone, a piece of length 1;
repeated rows are packed each; the order of equal pieces is free but fixed by
(doc_id, piece, start, ids_crc32).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import materialise
from loomspan.llm.hashing import released
from loomspan.llm.token_binary import _encoded

CAPACITY = 2048
_PER_BUCKET = 50_000
_BUCKETS = 32  # at least, so that a length that a third of all pieces has is dealt out at any size
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, ids, lengths in _encoded(batch.column(1).to_pylist(), batch.column(0).to_pylist(), path):
                n_pieces = -(-lengths // capacity)
                doc = np.repeat(np.arange(len(lengths)), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(lengths[doc] - start, capacity)
                at = (np.cumsum(lengths) - lengths)[doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                docs = pa.array(names, pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([docs, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return of


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The piece table of all documents."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(released(_cut(tokenizer_path, capacity)), _PIECE)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences."""
    room: dict[int, list[tuple[int, int]]] = {}  # what is left -> (first sequence, count)
    runs: list[tuple[int, int, int, int, int]] = []
    n_sequences = 0
    free = np.zeros(capacity + 1, dtype=bool)

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            room.setdefault(left, []).append((first, count))
            free[left] = True

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            fit = length + int(np.argmax(free[length:])) if free[length:].any() else capacity
            fresh = not free[fit]
            layers = min(fit // length, n)
            if fresh:
                first, count = n_sequences, max(1, n // layers)
                n_sequences += count
            else:
                first, have = room[fit].pop()
                count = min(have, max(1, n // layers))
                if count < have:
                    room[fit].append((first + count, have - count))
                if not room[fit]:
                    free[fit] = False
            for j in range(layers):
                runs.append((length, rank, count, first, capacity - fit + j * length))
                rank += count
            n -= layers * count
            put(fit - layers * length, first, count)
    return runs, n_sequences


def ranked(table: DataFrame, total: int) -> DataFrame:
    """The piece table with its rank (from 0) among the pieces of its length."""
    buckets = max(_BUCKETS, total // _PER_BUCKET)
    dealt = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("_row", F.row_number().over(within))
    return numbered.join(offsets, ["length", "_bucket"]).withColumn("rank", F.col("_ahead") + F.col("_row") - 1).drop("_bucket", "_ahead", "_row")


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    table = materialise(pieces(docs, tokenizer_path, text, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each length
    runs, _ = plan(histogram, capacity)
    spark = docs.sparkSession
    schema = "length long, _first long, _count long, _sequence long, offset long"
    slots = spark.createDataFrame(runs, schema)
    if len(runs) <= 64 * capacity:  # the plan's size is bounded by the capacity; beyond this Spark chooses the join
        slots = F.broadcast(slots)
    placed = ranked(table, sum(histogram.values())).join(slots, "length").filter((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_count")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("rank") - F.col("_first")).alias("sequence_id"), "offset")
