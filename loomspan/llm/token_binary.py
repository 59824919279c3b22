"""Token-id shards with Re-Pair grammar compression.

Documents are dealt out in ascending doc_id order, encoded, and written as
shards of about ``shard_ids`` ids.  In a shard, frequent pairs of neighbouring
symbols are replaced by new symbols, round after round: each round counts all
pairs, takes up to ``per_round`` (4096) of the most frequent ones and replaces
them, from the left, until no pair pays: a rule is 12 bytes in the file, a
replacement saves 2, so pairs that occur less than ``least`` (8) times stay, and
rules end where the next would no longer fit in 16 bits and make every symbol 4
bytes wide (vocabularies below 2^16).  Pairs never reach over the end of a document.

File format: one Parquet row for a shard, written by Spark's committer to any
store that the session can reach:

    part, seq      place of the shard: range partition, number in it
    before, n_ids  ids of the part before this shard, ids in it
    base           first new symbol; rule i makes symbol base + i
    rules          uint32 pairs (left, right), each of older symbols
    spans          uint32, the ids that each rule stands for
    width          bytes of a symbol in payload (2 or 4)
    payload        the symbols, little-endian
    doc_ids        int64 (null: see doc_nulls), symbols and ids of each document: uint32
    doc_nulls      uint8, 1 where the doc_id is null

A document is decoded alone from its symbols (``read_ids``); its place in the
stream is before + the spans of the symbols ahead of it in the shard.

Defined results: null or empty text is the end id alone; a null doc_id comes
first; rows that share a doc_id follow each other in order of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import materialise
from loomspan.llm.encoding import encoder

END_ID = 0
SHARD_IDS = 1 << 20
_SHARD = (
    "part int, seq int, before long, n_ids long, base long, rules binary, spans binary, width int, payload binary, "
    "doc_ids binary, doc_nulls binary, doc_symbols binary, doc_lengths binary"
)


_SLOTS = 1 << 20


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(12)


def _best_pairs(pairs: np.ndarray, least: int, most: int) -> np.ndarray:
    """The most frequent of the pairs (left symbol in the upper half), those that occur ``least`` times at least, in order."""
    pairs = np.sort(pairs)
    # of a pair that occurs n times, n - least + 1 stay
    pairs = pairs[np.flatnonzero(pairs[least - 1 :] == pairs[: max(0, len(pairs) - least + 1)])]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, dtype=np.int64)
    found, times = pairs[first], np.diff(np.append(first, len(pairs)))
    if len(found) > most:
        found = np.sort(found[np.lexsort((found, -times))[:most]])
    return found


def compress(ids: np.ndarray, lengths: np.ndarray, end_id: int = END_ID, rounds: int | None = None, per_round: int = 4096, least: int = 8):
    """(symbols, symbols of each document, base, rules) of documents that each end with end_id."""
    ends = np.cumsum(lengths) - 1
    base = max(int(ids.max()) + 1 if len(ids) else 1, end_id + 1)
    rules = np.empty((0, 2), dtype=np.uint32)
    # rules never reach beyond 16 bits, so two symbols fit in 32 where the vocabulary does
    narrow, wide, half = (np.uint16, np.uint32, np.uint32(16)) if base < 1 << 16 else (np.uint32, np.uint64, np.uint64(32))
    low = (wide(1) << half) - wide(1)
    symbols = ids.astype(narrow)
    done, new = 0, None
    while (rounds is None or done < rounds) and len(symbols) > 1:
        done += 1
        room = (1 << 16) - base - len(rules) if base < 1 << 16 else per_round
        if room < 1:
            break
        inside = np.ones(len(symbols), dtype=bool)
        inside[ends] = False
        inside[ends[ends > 0] - 1] = False
        inside = inside[:-1]
        left, right = symbols[:-1], symbols[1:]
        at = None
        if new is not None:  # all other pairs were looked at in the round before
            young = symbols >= new
            at = np.flatnonzero(inside & (young[:-1] | young[1:]))
            left, right = left[at], right[at]
        left, right = left.astype(np.uint32), right.astype(np.uint32)
        every = left.astype(wide) << half | right
        most = min(per_round, room)
        pairs = _best_pairs(every[inside] if at is None else every, least, most)
        if not len(pairs):
            break
        # the slot tells the pair; of pairs that share a slot one is replaced in this round
        slots = _slots((pairs >> half).astype(np.uint32), (pairs & low).astype(np.uint32))
        taken, of_slot = np.zeros(_SLOTS, dtype=bool), np.empty(_SLOTS, dtype=np.int32)
        taken[slots], of_slot[slots] = True, np.arange(len(pairs))
        new = base + len(rules) if len(pairs) < most and (of_slot[slots] == np.arange(len(pairs))).all() else None
        spot = _slots(left, right)
        some = np.flatnonzero(taken[spot] & inside if at is None else taken[spot])
        which = of_slot[spot[some]]
        fits = np.flatnonzero(pairs[which] == every[some])
        some, which = some[fits], which[fits]
        at = some if at is None else at[some]
        # of overlapping places every second one is replaced, from the left
        after = np.flatnonzero(np.diff(at) == 1) + 1
        if len(after):
            begins = np.append(True, np.diff(after) > 1)
            turn = np.ones(len(at), dtype=bool)
            turn[after] = (after - np.maximum.accumulate(np.where(begins, after - 1, 0))) % 2 == 0
            turn = np.flatnonzero(turn)
            at, which = at[turn], which[turn]
        # pairs that others left no place for get no rule
        used = np.bincount(which, minlength=len(pairs)) > 0
        symbols[at] = (base + len(rules) - 1 + np.cumsum(used)).astype(narrow)[which]
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols = symbols[stay]
        ends = ends - np.searchsorted(at, ends)  # a document ends outside of pairs, so places before its end lose one symbol each
        pairs = pairs[used]
        rules = np.concatenate([rules, np.stack([pairs >> half, pairs & low], axis=1).astype(np.uint32)])
    return symbols.astype(np.uint32), np.diff(np.concatenate([[0], ends + 1])), base, rules


def spans_of(base: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, dtype=np.uint32)


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for."""
    full: list[list[int]] = []
    for a, b in rules.tolist():
        full.append(([a] if a < base else full[a - base]) + ([b] if b < base else full[b - base]))
    lengths = np.concatenate([np.ones(base, dtype=np.int64), np.array([len(x) for x in full], dtype=np.int64)])
    flat = np.concatenate([np.arange(base, dtype=np.uint32), np.array([i for x in full for i in x], dtype=np.uint32)])
    at = np.concatenate([[0], np.cumsum(lengths)])
    symbols = symbols.astype(np.int64)
    each = lengths[symbols]
    places = np.repeat(at[symbols] - (np.cumsum(each) - each), each)
    places += np.arange(len(places))
    return flat[places]


def _encoded(texts: list | pa.Array, ids: list, path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Groups of documents of about 2^20 characters; up to four groups of an Arrow column are encoded in one call."""
    enc = encoder(path)
    column = isinstance(texts, pa.Array)
    sizes = (pc.fill_null(pc.utf8_length(texts), 0).to_numpy() + 1).tolist() if column else [len(t or "") + 1 for t in texts]
    a = 0
    while a < len(texts):
        edges, total = [a], 0
        while edges[-1] < len(texts) and total < (4 << 20 if column else 1):
            b, size = edges[-1], 0
            while b < len(texts) and size < 1 << 20:
                size += sizes[b]
                b += 1
            edges.append(b)
            total += size
        found, lengths = enc.encode(texts[a:b])
        found, lengths = np.insert(found, np.cumsum(lengths), END_ID), lengths + 1
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for b, c in pairwise(edges):
            yield ids[b:c], found[ends[b - a] : ends[c - a]], lengths[b - a : c - a]
        a = c


def _shards(path: str, shard_ids: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, before = 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            nonlocal seq, before
            names = [d for h in held for d in h[0]]
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            held.clear()
            symbols, doc_symbols, base, rules = compress(ids, lengths)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            row = {
                "part": part, "seq": seq, "before": before, "n_ids": len(ids), "base": base, "rules": rules.tobytes(), "spans": spans_of(base, rules).tobytes(),
                "width": width, "payload": symbols.astype("<u2" if width == 2 else "<u4").tobytes(), "doc_ids": np.array([d or 0 for d in names], dtype="<i8").tobytes(),
                "doc_nulls": bytes(d is None for d in names), "doc_symbols": doc_symbols.astype("<u4").tobytes(), "doc_lengths": lengths.astype("<u4").tobytes(),
            }
            seq, before = seq + 1, before + len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for some in _encoded(batch.column(1), batch.column(0).to_pylist(), path):
                held.append(some)
                if sum(len(h[1]) for h in held) >= shard_ids:
                    yield shard()
        if held:
            yield shard()

    return of


def write_shards(docs: DataFrame, tokenizer_path: str, text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode, compress and write all documents; returns the written shards as read back."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(_shards(tokenizer_path, shard_ids), _SHARD), "token-shards")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            symbols = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
            ids = expand(symbols, row["base"], np.frombuffer(row["rules"], np.uint32).reshape(-1, 2))
            symbols_of = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
            spans = np.concatenate([np.ones(row["base"], np.int64), np.frombuffer(row["spans"], np.uint32).astype(np.int64)])[symbols.astype(np.int64)]
            ends = np.concatenate([[0], np.cumsum(spans)])[np.cumsum(symbols_of)]  # from the symbols alone, not from doc_lengths
            starts = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            nulls = row["doc_nulls"]
            names = [None if nulls[i] else d for i, d in enumerate(np.frombuffer(row["doc_ids"], "<i8").tolist())]
            n = len(names)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array(names, pa.int64()), pa.array(row["before"] + starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the decoded shards."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("offset"))
    docs = shards.mapInArrow(_documents, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, "part").select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(row: dict, i: int) -> np.ndarray:
    """The ids of document i of one shard row, expanding the rules of its own symbols only, a level at a time."""
    ends = np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))
    width, base = row["width"], row["base"]
    a, b = (int(ends[i - 1]) if i else 0), int(ends[i])
    symbols = np.frombuffer(row["payload"][a * width : b * width], "<u2" if width == 2 else "<u4").astype(np.uint32)
    rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    while (open_ := symbols >= base).any():
        at = np.flatnonzero(open_)
        pairs = rules[symbols[at] - base]
        places = at + np.arange(len(at))
        symbols = np.repeat(symbols, 1 + open_)
        symbols[places], symbols[places + 1] = pairs[:, 0], pairs[:, 1]
    return symbols
