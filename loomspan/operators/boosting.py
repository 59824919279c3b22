"""Gradient-boosted regression trees over spans of sessions: one model for each (span, target), all grown in step.

Rows never meet in one place; only histograms do.

1.  Cuts of each feature are quantiles from one mergeable sketch, taken over rows that end before the first span does,
    so no later value shapes them.  Rows are binned once (a byte a feature, 0: missing) and written; that table serves
    every span and target.
2.  A level of all models' trees is one Spark job.  Each task sums residuals and counts by (model, node, feature, bin) over
    its rows; the sums of a node meet, and only those of the smaller child of a split are summed from rows: its
    sibling is the parent less that child.  The best splits, a row a node, come to the driver, which holds trees and
    nothing else.
3.  Scores are rows' own: every few rounds the table is written again with the scores so far; the trees grown since then
    are applied as rows are read.

Models are grown in groups whose histograms fit into a given memory for each task.  Squared loss, shrinkage, L2 on
leaf values, least rows of a leaf, a share of features for each tree, a share of rows drawn by hash for some rounds, and
missing values that go to the side where they gain more.  Nodes are numbered as in a heap: 1, then 2 i and 2 i + 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.keeping import folder

_HISTOGRAMS = 1 << 26  # bytes of histograms in a task
_KEEP = 8  # rounds between writes of the scores
_SHUFFLED = 64  # tasks that meet a level's sums, at most


@dataclass(frozen=True)
class Settings:
    num_leaves: int = 31
    learning_rate: float = 0.1
    num_boost_round: int = 150
    min_data_in_leaf: int = 20
    max_bin: int = 63
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 0
    lambda_l2: float = 0.0
    seed: int = 0

    def __post_init__(self) -> None:
        if not 2 <= self.max_bin <= 254 or self.num_leaves < 2 or self.num_boost_round < 0:
            raise ValueError("max_bin is 2 to 254, num_leaves at least 2, num_boost_round not negative")

    @property
    def depth(self) -> int:
        return (self.num_leaves - 1).bit_length()


@dataclass
class Trees:
    """The trees of one model: arrays (rounds, nodes)."""

    base: float
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def none(cls, base: float, depth: int) -> Trees:
        n = 2 << depth
        return cls(base, np.empty((0, n), np.int16), np.empty((0, n), np.uint8), np.empty((0, n), bool), np.empty((0, n)))

    def add(self, tree: Trees) -> None:
        for name in ("feature", "bin", "missing_left", "value"):
            setattr(self, name, np.vstack([getattr(self, name), getattr(tree, name)]))


def leaves(tree: Trees, bins: np.ndarray, k: int, levels: int) -> np.ndarray:
    """The node that each row reaches in the k-th tree within some levels."""
    node = np.ones(len(bins), dtype=np.int64)
    for _ in range(levels):
        f = tree.feature[k][node]
        split = f >= 0
        b = bins[np.arange(len(bins)), np.maximum(f, 0)]
        left = np.where(b == 0, tree.missing_left[k][node], b <= tree.bin[k][node])
        node = np.where(split, 2 * node + ~left, node)
    return node


def predict(tree: Trees, bins: np.ndarray, depth: int, first: int = 0) -> np.ndarray:
    """Sum of the trees from the first one on; the base is not in it."""
    out = np.zeros(len(bins))
    for k in range(first, len(tree.feature)):
        out += tree.value[k][leaves(tree, bins, k, depth)]
    return out


def best_split(sums: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int, bool, float, float]:
    """(gain, feature, bin, missing left, rows left, residuals left) of a node; sums: (features, bins, (residuals, rows))."""
    total = sums[0].sum(axis=0)
    rest = np.cumsum(sums[:, 1:], axis=1)[:, :-1]
    sides = np.stack([rest, rest + sums[:, :1]])  # missing right, missing left
    g, n = sides[..., 0], sides[..., 1]
    other_g, other_n = total[0] - g, total[1] - n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / (n + s.lambda_l2) + other_g**2 / (other_n + s.lambda_l2) - total[0] ** 2 / (total[1] + s.lambda_l2)
    gain[~((n >= s.min_data_in_leaf) & (other_n >= s.min_data_in_leaf) & allowed[None, :, None])] = -np.inf
    side, f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[side, f, b]), int(f), int(b) + 1, bool(side), float(n[side, f, b]), float(g[side, f, b])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isfinite(x[:, j]), 1 + np.searchsorted(c, x[:, j], side="left"), 0)
    return out


def quantile_cuts(rows: DataFrame, features: list[str], max_bin: int) -> list[np.ndarray]:
    """Cuts of each feature: a sketch of all rows, merged by Spark; (features x max_bin) numbers reach the driver."""
    shares = [i / max_bin for i in range(1, max_bin)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 10_000).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [np.unique([v for v in found[f"_{i}"] or () if np.isfinite(v)]) for i in range(len(features))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bagged(key: np.ndarray, round_: int, s: Settings) -> np.ndarray:
    """Whether a row is used in a round: drawn anew every bagging_freq rounds from the row's own hash."""
    if not s.bagging_freq or s.bagging_fraction >= 1:
        return np.ones(len(key), dtype=bool)
    with np.errstate(over="ignore"):
        drawn = _mix(key.view(np.uint64) ^ _mix(np.array([s.seed * 1_000_003 + round_ // s.bagging_freq + 1], dtype=np.uint64)))
    return (drawn >> np.uint64(11)).astype(float) / 2.0**53 < s.bagging_fraction


def allowed_features(n: int, round_: int, model: tuple, s: Settings) -> np.ndarray:
    """The features that a tree may use."""
    k = max(1, round(n * s.feature_fraction))
    out = np.ones(n, dtype=bool)
    if k < n:
        rng = np.random.default_rng([s.seed, round_, *(abs(hash_of(str(m))) for m in model)])
        out[:] = False
        out[rng.permutation(n)[:k]] = True
    return out


def hash_of(text: str) -> int:
    out = 0
    for b in text.encode():
        out = (out * 131 + b) % (1 << 31)
    return out


def split_level(trees: Trees, splits: dict[int, tuple], open_leaves: int, s: Settings) -> tuple[list[tuple[int, int]], int]:
    """Put a level's splits into the newest tree, best first, while it may have more leaves.

    splits: node -> (gain, feature, bin, missing left, rows left, residuals left, rows, residuals).  Returns the pairs
    (smaller child, sibling) and the number of leaves.
    """
    made = []
    for node, (gain, f, b, missing, n_left, g_left, n, g) in sorted(splits.items(), key=lambda x: (-x[1][0], x[0])):
        if not gain > 1e-12 or open_leaves >= s.num_leaves:
            continue
        open_leaves += 1
        trees.feature[-1, node], trees.bin[-1, node], trees.missing_left[-1, node] = f, b, missing
        for child, rows, residuals in ((2 * node, n_left, g_left), (2 * node + 1, n - n_left, g - g_left)):
            trees.value[-1, child] = s.learning_rate * residuals / (rows + s.lambda_l2)
        made.append((2 * node, 2 * node + 1) if 2 * n_left <= n else (2 * node + 1, 2 * node))
    return made, open_leaves


@dataclass
class Plan:
    """What a task has to know of the models that are grown together."""

    settings: Settings
    n_features: int
    spans: list[tuple[int, int, int]]  # (first session, last session, place of the target) of each model
    together: list[tuple[int, ...]]  # targets that must all be there for a model's row
    trees: dict[int, Trees] = field(default_factory=dict)
    written: int = 0  # trees whose sums are in the rows' scores


def _of(batch: pa.RecordBatch, n_features: int, n_models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    n = batch.num_rows
    bins = np.frombuffer(b"".join(column("bins").to_pylist()), np.uint8).reshape(n, n_features)
    y = column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    scores = column("scores").flatten().to_numpy(zero_copy_only=False).reshape(n, n_models)
    return column("session_idx").to_numpy(), column("key").to_numpy(), bins, y, scores


def _mine(plan: Plan, m: int, session: np.ndarray, y: np.ndarray) -> np.ndarray:
    first, last, _ = plan.spans[m]
    return np.flatnonzero((session >= first) & (session <= last) & np.isfinite(y[:, plan.together[m]]).all(axis=1))


def _sums(plan: Plan, asked: dict[int, list[int]], level: int):
    """Residuals and counts of the asked nodes of each model, over the rows of a task."""
    s, p, width = plan.settings, plan.n_features, plan.settings.max_bin + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            session, key, bins, y, scores = _of(batch, p, len(plan.spans))
            for m, nodes in asked.items():
                trees = plan.trees[m]
                k = len(trees.feature) - 1
                rows = _mine(plan, m, session, y)
                rows = rows[bagged(key[rows], k, s)]
                if not len(rows):
                    continue
                b = bins[rows]
                slot = np.full(2 << s.depth, -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[leaves(trees, b, k, level)]
                inside = at >= 0
                rows, b, at = rows[inside], b[inside], at[inside]
                residual = y[rows, plan.spans[m][2]] - trees.base - scores[rows, m]
                for t in range(plan.written, k):
                    residual -= trees.value[t][leaves(trees, b, t, s.depth)]
                held = total.setdefault(m, np.zeros((len(nodes), p, width, 2)))
                for f in range(p):
                    cell = at * width + b[:, f]
                    held[:, f, :, 0] += np.bincount(cell, weights=residual, minlength=len(nodes) * width).reshape(-1, width)
                    held[:, f, :, 1] += np.bincount(cell, minlength=len(nodes) * width).reshape(-1, width)
        found = [(m, node, sums[i].tobytes()) for m, sums in total.items() for i, node in enumerate(asked[m])]
        for a in range(0, len(found), 256):
            ms, nodes, raw = zip(*found[a : a + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ms, pa.int32()), pa.array(nodes, pa.int32()), pa.array(raw, pa.binary())], names=["m", "node", "sums"])

    return of


_LEVEL = "m int, node int, sums binary, gain double, feature int, bin int, missing_left boolean, n_left double, g_left double, n double, g double"


def _met(plan: Plan, allowed: dict[int, np.ndarray]):
    """Sums of tasks (part 1) and of parents (part 0), sorted by (m, pair): the sums of both children and their best splits."""
    shape = (plan.n_features, plan.settings.max_bin + 1, 2)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parent, small, node = None, None, None, 0
        out: list[tuple] = []

        def closed() -> None:
            if small is None:  # no row of this child anywhere
                return
            m = now[0]
            pair = [(node, small)] if parent is None else [(node, small), (node ^ 1, parent - small)]
            for child, sums in pair:
                gain, f, b, missing, n_left, g_left = best_split(sums, allowed[m], plan.settings)
                g, n = sums[0].sum(axis=0)
                out.append((m, child, sums.tobytes(), gain, f, b, missing, n_left, g_left, float(n), float(g)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _LEVEL.split(", ")])

        for batch in batches:
            for m, pair, part, child, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (m, pair) != now:
                    closed()
                    if len(out) >= 64:
                        yield batch_of(out)
                        out = []
                    now, parent, small = (m, pair), None, None
                sums = np.frombuffer(raw).reshape(shape)
                if part == 0:
                    parent = sums
                else:
                    small, node = sums if small is None else small + sums, child
        closed()
        if out:
            yield batch_of(out)

    return of


def _scored(plan: Plan):
    """The rows with the trees grown since the last write in their scores."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                session, _, bins, y, scores = _of(batch, plan.n_features, len(plan.spans))
                scores = scores.copy()
                for m, trees in plan.trees.items():
                    rows = _mine(plan, m, session, y)
                    scores[rows, m] += predict(trees, bins[rows], plan.settings.depth, plan.written)
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * scores.shape[1]
                batch = batch.set_column(batch.schema.get_field_index("scores"), "scores", pa.ListArray.from_arrays(offsets, pa.array(scores.ravel())))
            yield batch

    return of


def _started(plan: Plan):
    """m, n, total of the targets of each model's rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(plan.spans)), np.zeros(len(plan.spans))
        for batch in batches:
            if batch.num_rows:
                session, _, _, y, _ = _of(batch, plan.n_features, len(plan.spans))
                for m in range(len(plan.spans)):
                    mine = y[_mine(plan, m, session, y), plan.spans[m][2]]
                    n[m] += len(mine)
                    total[m] += mine.sum()
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(n[have]), pa.array(total[have])], names=["m", "n", "total"])

    return of


def _written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), path


def _dropped(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bin_rows(rows: DataFrame, features: list[str], targets: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """session_idx, key, bins, y: the shared dataset (targets that are missing are NaN)."""
    session = F.col("session_idx").cast("int")
    sent = rows.select(session.alias("session_idx"), F.xxhash64(session, "ticker").alias("key"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.array(*[F.coalesce(F.col(t).cast("double"), F.lit(float("nan"))) for t in targets]).alias("y"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(features))
            bins = binned(x, cuts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(3)], names=["session_idx", "key", "bins", "y"])

    return sent.mapInArrow(of, "session_idx int, key long, bins binary, y array<double>")


def grow(data: DataFrame, n_features: int, models: list[tuple], spans: list[tuple[int, int, int]], together: list[tuple[int, ...]], s: Settings, least: int) -> dict[int, Trees]:
    """The trees of some models over a binned dataset, all levels in step; models without ``least`` rows have none.

    models: (retrain, h, target), which seeds the choice of features; spans, together: as in Plan.
    """
    spark = data.sparkSession
    plan = Plan(s, n_features, spans, together)
    state, path = _written(data.withColumn("scores", F.array_repeat(F.lit(0.0), len(spans))), "boosting-rows")
    begun = state.mapInArrow(_started(plan), "m int, n double, total double").groupBy("m").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter(F.col("n") >= least).collect()  # a row a model
    plan.trees = {r["m"]: Trees.none(r["total"] / r["n"], s.depth) for r in begun}
    shuffled = min(_SHUFFLED, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for round_ in range(s.num_boost_round if plan.trees else 0):
        allowed = {m: allowed_features(n_features, round_, models[m], s) for m in plan.trees}
        for trees in plan.trees.values():
            n = 2 << s.depth
            trees.add(Trees(0.0, np.full((1, n), -1, np.int16), np.zeros((1, n), np.uint8), np.zeros((1, n), bool), np.zeros((1, n))))
        asked, grown, before, old = {m: [1] for m in plan.trees}, dict.fromkeys(plan.trees, 1), None, []
        for level in range(s.depth):
            rows = state.mapInArrow(_sums(plan, asked, level), "m int, node int, sums binary")
            met = rows.select("m", F.expr("node div 2").alias("pair"), F.lit(1).alias("part"), "node", "sums")
            if before is not None:  # the parents of what is asked
                wanted = spark.createDataFrame([(m, c // 2) for m, nodes in asked.items() for c in nodes], "m int, node int")
                parents = before.select("m", "node", "sums").join(F.broadcast(wanted), ["m", "node"])
                met = met.unionByName(parents.select("m", F.col("node").cast("long").alias("pair"), F.lit(0).alias("part"), "node", "sums"))
            dealt = met.repartition(shuffled, "m", "pair").sortWithinPartitions("m", "pair", "part")
            before, where = _written(dealt.mapInArrow(_met(plan, allowed), _LEVEL), "boosting-level")
            old.append(where)
            splits: dict[int, dict[int, tuple]] = {}
            for r in before.drop("sums").collect():  # a row a node
                splits.setdefault(r["m"], {})[r["node"]] = (r["gain"], r["feature"], r["bin"], r["missing_left"], r["n_left"], r["g_left"], r["n"], r["g"])
            asked = {}
            for m, nodes in splits.items():
                made, grown[m] = split_level(plan.trees[m], nodes, grown[m], s)
                if made and level + 1 < s.depth:
                    asked[m] = [small for small, _ in made]
            if not asked:
                break
        for where in old:
            _dropped(spark, where)
        if (round_ + 1) % _KEEP == 0 and round_ + 1 < s.num_boost_round:
            scored, new = _written(state.mapInArrow(_scored(plan), state.schema), "boosting-rows")
            _dropped(spark, path)
            state, path = scored, new
            plan.written = round_ + 1
    _dropped(spark, path)
    return plan.trees


def groups_of_models(n: int, n_features: int, s: Settings) -> list[range]:
    """Consecutive models whose histograms fit into a task."""
    each = n_features * (s.max_bin + 1) * 16 * max(1, 1 << max(s.depth - 2, 0))
    size = max(1, _HISTOGRAMS // each)
    return [range(a, min(a + size, n)) for a in range(0, n, size)]
