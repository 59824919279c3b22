"""Walk-forward ridge regressions from sufficient statistics.

A ridge fit needs no rows, only counts, sums and cross products.  They are additive, so sessions are cut into segments
at all places where a training span begins or ends, each segment is reduced once for each horizon, and the statistics
of a span are a difference of two running sums.  A row is read once for each horizon, however many fits it serves, and a
task holds the rows of one segment or the sums of one horizon, never a training span.

Columns are standardised by the present values of the span, missing ones stand at the mean, targets are centred:
(G + alpha I) w = c with G = Z'Z / n and c = Z'(y - mean) / n, where Z'Z and Z'y follow from sums over present cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 63  # sessions of a segment at most
_FIELDS = ("n", "pairs", "first", "cross", "y", "present_y", "x_y")


def reduce_rows(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The sums of some rows: of present cells of x (m: its mask) and of y, which is complete."""
    m = np.isfinite(x).astype(float)
    x = np.where(m > 0, x, 0.0)
    return {"n": np.array([float(len(x))]), "pairs": m.T @ m, "first": x.T @ m, "cross": x.T @ x, "y": y.sum(axis=0), "present_y": m.T @ y, "x_y": x.T @ y}


def solve(s: dict[str, np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights of raw columns: columns x targets, centres of columns, means of targets)."""
    n, have = s["n"][0], np.maximum(np.diag(s["pairs"]), 1)
    centre = np.diag(s["first"]) / have
    spread = np.sqrt(np.maximum(np.diag(s["cross"]) / have - centre**2, 0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    base = s["y"] / n
    gram = s["cross"] - s["first"] * centre[None, :] - (s["first"] * centre[None, :]).T + np.outer(centre, centre) * s["pairs"]
    moved = s["x_y"] - centre[:, None] * s["present_y"] - np.outer(np.diag(s["first"]), base) + np.outer(centre * have * (np.diag(s["pairs"]) > 0), base)
    system = gram / np.outer(spread, spread) / n + alpha * np.eye(len(centre))
    return np.linalg.solve(system, moved / spread[:, None] / n) / spread[:, None], centre, base


def _pack(s: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([s[f].ravel() for f in _FIELDS]).tobytes()


def _unpack(raw: bytes, p: int, q: int) -> dict[str, np.ndarray]:
    shapes = {"n": (1,), "pairs": (p, p), "first": (p, p), "cross": (p, p), "y": (q,), "present_y": (p, q), "x_y": (p, q)}
    flat, out, at = np.frombuffer(raw), {}, 0
    for f, shape in shapes.items():
        size = int(np.prod(shape))
        out[f], at = flat[at : at + size].reshape(shape), at + size
    return out


def coefficients(rows: DataFrame, spans: list, features: list[str], targets: dict[int, list[str]], alpha: float, least: int) -> DataFrame:
    """retrain, h, target, weights, centre, base of each fit with ``least`` rows.  spans: (retrain, h, train_start, train_end), a few for each month."""
    spark = rows.sparkSession
    sessions = sorted(r[0] for r in rows.select("session_idx").distinct().collect())  # the calendar
    where = []
    for h in targets:
        edges = np.unique([e for _, k, a, b in spans if k == h for e in (a, b)])
        for s in sessions:
            if len(edges) and edges[0] <= s < edges[-1]:
                start = int(edges[np.searchsorted(edges, s, side="right") - 1])
                where.append((h, s, start + (s - start) // SEGMENT * SEGMENT))
    dealt = rows.filter("tradable").join(F.broadcast(spark.createDataFrame(where, "h int, session_idx int, segment int")), "session_idx")
    complete = F.lit(False)
    for h, names in targets.items():
        complete = complete | ((F.col("h") == h) & F.expr(" AND ".join(f"`{t}` IS NOT NULL" for t in names)))
    every = sorted({t for ts in targets.values() for t in ts})

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        h = int(part["h"].iloc[0])
        s = reduce_rows(part[features].to_numpy(dtype=float), part[targets[h]].to_numpy(dtype=float))
        return pd.DataFrame({"h": [h], "segment": [int(part["segment"].iloc[0])], "sums": [_pack(s)]})

    reduced = dealt.filter(complete).select("h", "segment", *features, *every).groupBy("h", "segment").applyInPandas(sums, "h int, segment int, sums binary")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, kept, left = None, None, {}, []

        def closed(upto: float) -> Iterator[pa.RecordBatch]:
            """Keep the sums where a span begins, fit the spans that end, at all edges up to here."""
            nonlocal left
            for _, _, a, _ in left:
                if a <= upto and a not in kept:
                    kept[a] = total
            done = [s for s in left if s[3] <= upto]
            left = [s for s in left if s[3] > upto]
            for retrain, h, a, _ in done:
                mine = {f: total[f] - kept[a][f] for f in _FIELDS} if kept[a] is not None else total
                if mine is None or mine["n"][0] < least:
                    continue
                w, centre, base = solve(mine, alpha)
                q = len(targets[h])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([retrain] * q, pa.int32()), pa.array([h] * q, pa.int32()), pa.array(targets[h]), pa.array(w.T.tolist(), pa.list_(pa.float64())), pa.array([centre.tolist()] * q, pa.list_(pa.float64())), pa.array(base)],
                    names=["retrain", "h", "target", "weights", "centre", "base"],
                )
            for a in [a for a in kept if all(s[2] != a for s in left)]:
                del kept[a]

        for batch in batches:
            for row in batch.to_pylist():
                if row["h"] != now:
                    if now is not None:
                        yield from closed(float("inf"))
                    now, total, kept, left = row["h"], None, {}, sorted((s for s in spans if s[1] == row["h"]), key=lambda s: s[3])
                yield from closed(row["segment"])
                s = _unpack(row["sums"], len(features), len(targets[now]))
                total = s if total is None else {f: total[f] + s[f] for f in _FIELDS}
        if now is not None:
            yield from closed(float("inf"))

    schema = "retrain int, h int, target string, weights array<double>, centre array<double>, base double"
    return reduced.repartition("h").sortWithinPartitions("h", "segment").mapInArrow(fits, schema)
