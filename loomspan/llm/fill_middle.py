"""Fill-in-middle: a text is cut at two token ranks and its parts are put in another order.

A token is a run of letters A-Z, a-z or one other character, so a token starts at each character but at a letter
after a letter: a predicate on two adjacent characters.  The texts of an Arrow column are decomposed into chunks that
overlap by one byte; token starts and code points are counted for all chunks at once, running sums over the chunks give
each document its number of tokens and lead both cut ranks to the chunks that own them, and only those are scanned
again for the place of the cut.  Counting goes through the column in blocks of bounded size, whatever a text's
length.  A document is neither shuffled nor sent back: the pass returns three numbers, forms and outputs are
expressions.

Which documents are cut, where and in what form is drawn from the sha256 of their key, so it does not depend on how rows are dealt out.

Defined results: null text is empty and plain; rows without doc_id draw as an empty key; repeated rows get the
same result each; texts that hold a marker stay plain; other columns are left out (join by doc_id), so names never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 10
_BLOCK = 1 << 20  # bytes looked at together
_SCANS = 1 << 11  # chunks scanned again together

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_OPENS = (_BYTES & 0xC0) != 0x80  # first byte of a code point
_CUTS = "struct<n:bigint,first:bigint,second:bigint>"


def _column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, np.uint8), offsets


def _chunks(offsets: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of all chunks, in order; an empty text has none."""
    many = -(-np.diff(offsets) // chunk)
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - (np.cumsum(many) - many)[row]
    begin = offsets[row] + place * chunk
    return row, begin, np.minimum(begin + chunk, offsets[row + 1])


def _counts(data: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token starts and code points of every chunk."""
    starts, points = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + _BLOCK, side="right")))
        low, high = int(begin[a]), int(end[b - 1])
        letter = np.zeros(high - low + 1, dtype=bool)
        over = 1 if low > offsets[0] else 0  # the overlap: the byte before
        letter[1 - over :] = _LETTER[data[low - over : high]]
        opens = _OPENS[data[low:high]]
        inner = letter[1:] & letter[:-1]
        inner[offsets[row[a] : row[b - 1] + 1][offsets[row[a] : row[b - 1] + 1] >= low] - low] = False  # nothing stands before a text
        at = begin[a:b] - low
        points[a:b] = np.add.reduceat(opens.astype(np.int64), at)
        starts[a:b] = np.add.reduceat((opens & ~inner).astype(np.int64), at)
        a = b
    return starts, points


def _scan(data: np.ndarray, begin: np.ndarray, end: np.ndarray, top: np.ndarray, rank: np.ndarray, chunk: int) -> np.ndarray:
    """Code points of each chunk before its token start of this rank; top: the chunk begins a text."""
    out = np.empty(len(begin), np.int64)
    for a in range(0, len(begin), _SCANS):
        s = slice(a, a + _SCANS)
        place = begin[s, None] + np.arange(-1, chunk)[None, :]
        inside = (place >= begin[s, None]) & (place < end[s, None])
        found = data[np.clip(place, 0, len(data) - 1)]
        letter = _LETTER[found] & (place < end[s, None])
        letter[:, 0] &= ~top[s]
        opens = (_OPENS[found] & inside)[:, 1:]
        starts = opens & ~(letter[:, 1:] & letter[:, :-1])
        at = (np.cumsum(starts, axis=1) == rank[s, None] + 1).argmax(axis=1)
        out[s] = (np.cumsum(opens, axis=1) - opens)[np.arange(len(at)), at]
    return out


def cut_places(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and the code points before its lower and its upper cut (ranks h modulo n + 1)."""
    data, offsets = _column(texts)
    row, begin, end = _chunks(offsets, chunk)
    starts, points = _counts(data, row, begin, end, offsets)
    tokens, before = np.concatenate([[0], np.cumsum(starts)]), np.concatenate([[0], np.cumsum(points)])
    top = np.searchsorted(row, np.arange(len(texts) + 1))  # first chunk of each text
    n = tokens[top[1:]] - tokens[top[:-1]]
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    places = []
    for r in ranks:
        place = before[top[1:]] - before[top[:-1]]  # a rank of n is the end of the text
        cut = np.flatnonzero(r < n)
        wanted = tokens[top[cut]] + r[cut]
        owner = np.searchsorted(tokens, wanted, side="right") - 1
        inside = _scan(data, begin[owner], end[owner], owner == top[cut], wanted - tokens[owner], chunk)
        place[cut] = before[owner] - before[top[cut]] + inside
        places.append(place)
    return n, places[0], places[1]


def _cuts(chunk: int):
    def of(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        columns = cut_places(texts, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), chunk)
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["n", "first", "second"])

    of.__annotations__ = {"texts": pa.Array, "h1": pa.Array, "h2": pa.Array, "return": pa.Array}
    return F.arrow_udf(of, _CUTS)


def _draw(key: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the key's sha256."""
    return F.conv(F.substring(key, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1", plain: int = 10, spm: int = 20, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every document.

    plain: per cent of documents left as they are; spm: per cent of the others with the suffix first.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    drawn = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), *(_draw(key, k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cut = drawn.select("doc_id", "text", form.alias("form"), _cuts(chunk)("text", "h1", "h2").alias("cuts")).select("doc_id", "text", "form", "cuts.*")
    head, middle, tail = F.expr("left(text, int(first))"), F.expr("substring(text, int(first) + 1, int(second - first))"), F.expr("substring(text, int(second) + 1)")
    p, s, m = F.concat(F.lit(PREFIX), head), F.concat(F.lit(SUFFIX), tail), F.concat(F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("text"))
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id", F.col("n"), "form", F.when(moved, F.col("first")).alias("prefix_chars"), F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no text holds a marker, so the parts are what lies between the three."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
