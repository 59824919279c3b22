"""Ordinal quality classifier: a cumulative-link model over hashed text.

Grades: 0 toxic, 1 not toxic but of low quality, 2 good.  One weight vector
over hashed tokens is shared by all grades; ordered thresholds t0 < t1 cut its
score: P(grade > j) = sigmoid(score - t_j).  Tokens are the distinct words of
the whole text and leveled measures of its form (share of symbols, capitals,
digits, blanks, repeated lines; length; share of distinct words), coded level by level.

The model is fitted on at most ``max_labelled`` labelled documents, those with
the smallest hash of doc_id: a documented bound, so the fit has one size on any
corpus.  Fitting is a proximal gradient method with an L1 penalty, so words
that say nothing get no weight at all; it runs in one task on the bounded
sample.  All documents are scored, each in one pass over its whole text.

Defined results: null text has no words and is graded by its form alone;
labels that are null say nothing; of several labels of a document the worst
counts; without any label nothing is known and every document is kept with
null scores; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import hashing as H

BITS = 18
MAX_LABELLED = 20_000
KEEP_TAIL = 0.5
_LEVELS = 14
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>!@~^_{}[]\\=+", np.uint8))
_CAPITALS = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGITS = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _form(words: H.Words) -> np.ndarray:
    """Buckets of the leveled measures: rows x measures."""
    at = words.at
    size = np.maximum(np.diff(at), 1)
    n = np.diff(words.doc_off)
    row = words.row_of_word()
    distinct = np.bincount(np.unique(H.join2(row.astype(np.uint64), words.hashes), return_index=True)[1], minlength=len(row))
    distinct = _per_row(distinct, words.doc_off)
    raw = words.raw
    cut = np.zeros(len(raw), dtype=bool)
    cut[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(cut | np.append(False, raw[:-1] == 10)) if len(raw) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(raw))
    line = H.hash_spans(raw, starts, ends - (raw[ends - 1] == 10)) if len(starts) else np.empty(0, np.uint64)
    line_off = np.searchsorted(starts, at)
    line_row = np.repeat(np.arange(words.n_rows), np.diff(line_off))
    first = np.bincount(np.unique(H.join2(line_row.astype(np.uint64), line), return_index=True)[1], minlength=len(line))
    lines = np.maximum(np.diff(line_off), 1)
    share = [
        _per_row(_SYMBOLS[raw], at) / size, _per_row(_CAPITALS[raw], at) / size, _per_row(_DIGITS[raw], at) / size, 1 - _per_row(H.BLANK[raw], at) / size,
        1 - _per_row(first, line_off) / lines, distinct / np.maximum(n, 1), n / np.maximum(np.diff(line_off), 1) / 200,
    ]
    # thermometer coding: a measure of level b has the tokens 0..b, so what is learned at one level holds above it
    levels = [np.minimum(np.floor(np.log2(np.maximum(s, 0) * 1024 + 1)), _LEVELS - 1) for s in share] + [np.minimum(np.floor(np.log2(n + 1)), _LEVELS - 1)]
    names = np.stack([np.minimum(np.arange(_LEVELS)[None, :], b[:, None]) + 64 * (i + 1) for i, b in enumerate(levels)], axis=1).reshape(words.n_rows, -1)
    return H.mix(names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _tokens(column: pa.Array) -> Iterator[tuple[H.Words, np.ndarray, np.ndarray]]:
    """(slice, bucket of each word, buckets of each row's form)."""
    for words in H.words_of(column, H.ALNUM, True):
        yield words, (words.hashes >> np.uint64(64 - BITS)).astype(np.int64), _form(words).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for words, bucket, form in _tokens(batch.column(0)):
            out += [np.unique(np.concatenate([bucket[words.doc_off[i] : words.doc_off[i + 1]], form[i]])).astype(np.int32) for i in range(words.n_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], names=["x", "grade"])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, l1: float = 1e-3, steps: int = 300, least_rows: int = 3):
    """(weights over 2 ** BITS buckets, thresholds) of the cumulative-link model.

    Accelerated proximal gradient on centred, scaled columns; buckets in fewer than least_rows documents have no say.
    """
    dim = 1 << BITS
    n = len(rows)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=dim)
    useful = (seen >= least_rows) & (seen < n)
    used = useful[flat]
    keep = np.flatnonzero(useful & (seen > 0))
    place = np.zeros(dim, dtype=np.int32)
    place[keep] = np.arange(len(keep))
    col, row = place[flat[used]], row[used]
    del flat, used
    mean = seen[keep] / n
    scale = np.minimum(1 / np.sqrt(mean * (1 - mean) + 1.0 / n), 20.0)  # rare words may weigh as much as common ones
    middle = mean * scale
    above = np.array([(grades > j).astype(float) for j in range(n_grades - 1)])
    rate = np.clip(above.mean(axis=1), 1e-3, 1 - 1e-3)
    t = -np.log(rate / (1 - rate))

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=(scale * x)[col], minlength=n) - (middle * x).sum()

    def backward(u: np.ndarray) -> np.ndarray:
        return scale * np.bincount(col, weights=u[row], minlength=len(keep)) - middle * u.sum()

    w = np.zeros(len(keep))
    z, momentum = w.copy(), 1.0
    v, top = np.ones(len(keep)), 1.0
    for _ in range(12):  # the step follows the curvature along the leading direction
        v = backward(forward(v)) / n
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1 / (0.25 * (n_grades - 1) * 1.1 * top + 1e-9)
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(forward(z)[None, :] - t[:, None], -30, 30))) - above
        new = z - step * backward(miss.sum(axis=0)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        t = np.maximum.accumulate(t + 2.0 * miss.mean(axis=1))  # thresholds stay ordered
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        change = new - w
        z = new + (momentum - 1) / following * change
        w, momentum = new, following
        if np.linalg.norm(change) < 2e-3 * np.linalg.norm(new):
            break
    weights = np.zeros(dim)
    weights[keep] = w * scale
    return weights, t + (middle * w).sum()


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, grades = [], []
    for batch in batches:
        lists = batch.column(0)
        flat, off = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        rows += [flat[off[i] : off[i + 1]] for i in range(len(lists))]
        grades += batch.column(1).to_pylist()
    if not rows:
        return
    # one order whatever way the rows came
    order = sorted(range(len(rows)), key=lambda i: (grades[i], rows[i].tobytes()))
    weights, thresholds = fit([rows[i] for i in order], np.array([grades[i] for i in order]))
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([weights[used].tolist()], pa.list_(pa.float64())), pa.array([thresholds.tolist()], pa.list_(pa.float64()))], names=["bucket", "weight", "thresholds"]
    )


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, grade: 0 toxic, 1 low quality, 2 good; the worst of a document's labels."""
    known = labels.filter(F.col("quality").isNotNull() & F.col(key).isNotNull())
    worst = known.groupBy(key).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("t"), F.min("quality").alias("q"))
    return worst.select(key, F.when(F.col("t") > 0, 0).when(F.col("q") < 1, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = MAX_LABELLED):
    """(weights, thresholds), or None without labelled documents."""
    sample = graded(labels, key).orderBy(F.xxhash64(key), key).limit(max_labelled)
    # the sample has at most max_labelled rows of two numbers
    met = docs.select(key, text).join(F.broadcast(sample), key)
    # rows that share a key count once, by their least text: max_labelled bounds what the fit gets
    one = met.groupBy(key).agg(F.min(text).alias(text), F.min("grade").alias("grade"))
    rows = one.select(text, "grade").mapInArrow(H.released(_features), "x array<int>, grade int")
    found = rows.repartition(1).mapInArrow(H.released(_train), "bucket array<int>, weight array<double>, thresholds array<double>").collect()
    if not found:
        return None
    weights = np.zeros(1 << BITS)
    weights[found[0]["bucket"]] = found[0]["weight"]
    return weights, np.array(found[0]["thresholds"])


def _score(kept: list[str], text: str, model):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = model.value
        for batch in batches:
            tails = [np.empty((0, len(thresholds)))]
            for words, bucket, form in _tokens(batch.column(batch.schema.get_field_index(text))):
                row = words.row_of_word()
                some = np.flatnonzero(weights[bucket])
                code = np.unique(np.concatenate([row[some] << BITS | bucket[some], (np.arange(words.n_rows)[:, None] << BITS | form).ravel()]))
                score = np.bincount(code >> BITS, weights=weights[code & ((1 << BITS) - 1)], minlength=words.n_rows)
                tails.append(1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -30, 30))))
            tail = np.concatenate(tails)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(tail.sum(axis=1)), pa.array(tail[:, -1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "expected_grade", "p_top"])

    return of


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = MAX_LABELLED, keep_tail: float = KEEP_TAIL, training: DataFrame | None = None) -> DataFrame:
    """The documents with expected_grade, p_top = P(best grade) and kept = p_top >= keep_tail."""
    added = ("expected_grade", "p_top", "kept")
    own = [c for c in docs.columns if c not in added]
    found = train(training if training is not None else docs, labels, text, key, max_labelled)
    if found is None:
        return docs.select(*own, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_top"), F.lit(True).alias("kept"))
    model = docs.sparkSession.sparkContext.broadcast(found)  # 2 ** BITS numbers
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + ["expected_grade double, p_top double"])
    return docs.select(*own).mapInArrow(H.released(_score(own, text, model)), schema).withColumn("kept", F.col("p_top") >= keep_tail)
