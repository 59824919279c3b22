"""Kinds of models by name: pyspark.ml estimators that fit all spans of a walk-forward, and models that are stored and read back.

An estimator gets a panel (session_idx, ticker, features, targets and boolean columns that say which rows train and
which are predicted) and the spans (retrain, h, train_start, train_end inclusive, until exclusive or null).  Its model
predicts each row from the retrain session before it: retrain, h, session_idx, ticker, target, pred.

``make(spec)`` builds an estimator from a model entry of the settings; ``kind`` adds a kind to the registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions.settings import SettingsError
from loomspan.operators import boosting as B
from loomspan.operators import models as M

KINDS: dict[str, Callable[[dict, dict], Estimator]] = {}
_PREDICTED = "retrain int, h int, session_idx int, ticker string, target string, pred double"


def kind(name: str):
    """Register a function (spec, defaults) -> estimator as a kind of model."""

    def put(f: Callable[[dict, dict], Estimator]):
        KINDS[name] = f
        return f

    return put


def make(spec: dict, defaults: dict | None = None) -> Estimator:
    """The estimator of a model entry {name, kind, ...}; defaults: settings of all entries of a kind."""
    if spec.get("kind") not in KINDS:
        raise SettingsError(f"unknown model kind {spec.get('kind')}; known are {', '.join(sorted(KINDS))}")
    return KINDS[spec["kind"]](spec, (defaults or {}).get(spec["kind"], {}))


class _Spans(Params):
    """What all kinds share; everything is JSON, so it is stored with a model."""

    features = Param(Params._dummy(), "features", "columns that a fit reads", TypeConverters.toListString)
    targets = Param(Params._dummy(), "targets", "[h, target columns] of each horizon", TypeConverters.identity)
    spans = Param(Params._dummy(), "spans", "(retrain, h, train_start, train_end, until) of each fit", TypeConverters.identity)
    least = Param(Params._dummy(), "least", "rows that a fit needs", TypeConverters.toInt)
    trains = Param(Params._dummy(), "trains", "boolean column: rows that train", TypeConverters.toString)
    asked = Param(Params._dummy(), "asked", "boolean column: rows that are predicted", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(least=50, trains="tradable", asked="tradable")

    def by_horizon(self) -> dict[int, list[str]]:
        return {int(h): list(names) for h, names in self.getOrDefault(self.targets)}

    def fits(self) -> list[tuple]:
        return [tuple(s) for s in self.getOrDefault(self.spans)]

    def over(self, *, spans: list[tuple], features: list[str], targets: dict[int, list[str]], **more):
        """The same estimator for these spans."""
        known = {"spans": [list(s) for s in spans], "features": list(features), "targets": [[int(h), list(t)] for h, t in sorted(targets.items())], **more}
        return self.copy({self.getParam(k): v for k, v in known.items()})


class _Stored(MLWriter):
    def __init__(self, model: _SpanModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name, frame in self.model.frames().items():
            frame.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(**{n: self.sparkSession.read.parquet(f"{path}/{n}") for n in self.cls.NAMES})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _SpanModel(Model, _Spans, MLWritable, MLReadable):
    NAMES: tuple[str, ...] = ()

    def frames(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in self.NAMES}

    def write(self) -> MLWriter:
        return _Stored(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _asked(self, rows: DataFrame) -> DataFrame:
        """The rows to predict with the retrain and horizon that do it; a row for each session and horizon is broadcast."""
        last = rows.agg(F.max("session_idx")).first()[0]
        when = [(h, s, retrain) for retrain, h, _, _, until in self.fits() for s in range(retrain, (last if until is None else until - 1) + 1)] if last is not None else []
        placed = rows.sparkSession.createDataFrame(when, "h int, session_idx int, retrain int")
        return rows.filter(F.col(self.getOrDefault(self.asked))).withColumn("session_idx", F.col("session_idx").cast("int")).join(F.broadcast(placed), "session_idx")


# -- ridge -----------------------------------------------------------------------------------------------------
class RidgeSpans(Estimator, _Spans, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge of each span from sufficient statistics (operators/models.py)."""

    alpha = Param(Params._dummy(), "alpha", "penalty a row on standardised columns", TypeConverters.toFloat)

    def __init__(self, alpha: float = 1.0) -> None:
        super().__init__()
        self._setDefault(alpha=1.0)
        self._set(alpha=alpha)

    def _fit(self, dataset: DataFrame) -> RidgeSpansModel:
        rows = dataset.withColumn("tradable", F.col(self.getOrDefault(self.trains)))
        spans = [(r, h, a, b + 1) for r, h, a, b, _ in self.fits()]
        weights = M.coefficients(rows, spans, self.getOrDefault(self.features), self.by_horizon(), self.getOrDefault(self.alpha), self.getOrDefault(self.least))
        stored, _ = B._written(weights, "ridge-weights")
        return self._copyValues(RidgeSpansModel(stored))


class RidgeSpansModel(_SpanModel):
    NAMES = ("weights",)
    alpha = RidgeSpans.alpha

    def __init__(self, weights: DataFrame) -> None:
        super().__init__()
        self.weights = weights

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = self.getOrDefault(self.features)
        placed = self._asked(dataset).select("retrain", "h", "session_idx", "ticker", F.array(*[F.col(f).cast("double") for f in features]).alias("_x")).join(self.weights, ["retrain", "h"])
        off = F.zip_with("_x", "centre", lambda x, c: F.coalesce(x - c, F.lit(0.0)))
        pred = F.col("base") + F.aggregate(F.zip_with(off, F.col("weights"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return placed.select("retrain", "h", "session_idx", "ticker", "target", pred.alias("pred"))


@kind("ridge")
def _ridge(spec: dict, defaults: dict) -> Estimator:
    return RidgeSpans(float(spec.get("alpha", defaults.get("alpha", 1.0))))


# -- boosted trees -----------------------------------------------------------------------------------------------
_TREES = "retrain int, h int, target string, base double, depth int, feature array<int>, bin array<int>, missing_left array<boolean>, value array<double>"


class BoostedSpans(Estimator, _Spans, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees of each (span, target), grown in step over one binned dataset (operators/boosting.py)."""

    settings = Param(Params._dummy(), "settings", "num_leaves, learning_rate, num_boost_round, ...", TypeConverters.identity)

    def __init__(self, settings: dict | None = None) -> None:
        super().__init__()
        B.Settings(**(settings or {}))  # unknown names and bad values are refused here
        self._set(settings=dict(settings or {}))

    def _fit(self, dataset: DataFrame) -> BoostedSpansModel:
        spark, s, features = dataset.sparkSession, B.Settings(**self.getOrDefault(self.settings)), self.getOrDefault(self.features)
        by_horizon = self.by_horizon()
        names = sorted({t for ts in by_horizon.values() for t in ts})
        train = dataset.filter(F.col(self.getOrDefault(self.trains)))
        spans = self.fits()
        first_end = min((b for _, _, _, b, _ in spans), default=-1)
        cuts = B.quantile_cuts(train.filter(F.col("session_idx") <= first_end), features, s.max_bin)
        data, path = B._written(B.bin_rows(train, features, names, cuts), "boosting-bins")
        models = [(r, h, t) for r, h, _, _, _ in spans for t in by_horizon.get(h, [])]
        places = [(a, b, names.index(t)) for _, h, a, b, _ in spans for t in by_horizon.get(h, [])]
        together = [tuple(names.index(t) for t in by_horizon[h]) for _, h, _ in models]
        parts = []
        for group in B.groups_of_models(len(models), len(features), s):
            trees = B.grow(data, len(features), [models[i] for i in group], [places[i] for i in group], [together[i] for i in group], s, self.getOrDefault(self.least))
            rows = [(*models[group[m]], t.base, s.depth, *(getattr(t, n).ravel().tolist() for n in ("feature", "bin", "missing_left", "value"))) for m, t in trees.items()]
            parts.append(B._written(spark.createDataFrame(rows, _TREES).repartition(8), "boosting-trees")[0])
        B._dropped(spark, path)
        stored = parts[0] if parts else spark.createDataFrame([], _TREES)
        for p in parts[1:]:
            stored = stored.unionByName(p)
        kept = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cuts)], "place int, cuts array<double>")
        return self._copyValues(BoostedSpansModel(stored, kept))


class BoostedSpansModel(_SpanModel):
    NAMES = ("trees", "cuts")
    settings = BoostedSpans.settings
    #: Bytes of trees that a task may hold; more fits than that are predicted one group after another.
    HELD = 1 << 26

    def __init__(self, trees: DataFrame, cuts: DataFrame) -> None:
        super().__init__()
        self.trees, self.cuts = trees, cuts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Each task gets the trees of some retrains by broadcast; how many is reckoned from the settings."""
        s = B.Settings(**self.getOrDefault(self.settings))
        features = self.getOrDefault(self.features)
        by_horizon = self.by_horizon()
        each = max(1, s.num_boost_round * (2 << s.depth) * 12)
        fits = sorted({(r, h) for r, h, _, _, _ in self.fits()})
        many = max(1, self.HELD // (each * max((len(t) for t in by_horizon.values()), default=1)))
        asked = self._asked(dataset).select("retrain", "h", "session_idx", "ticker", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
        out = dataset.sparkSession.createDataFrame([], _PREDICTED)
        for a in range(0, len(fits), many):
            mine = dataset.sparkSession.createDataFrame(fits[a : a + many], "retrain int, h int")
            rows = asked.join(F.broadcast(mine), ["retrain", "h"])
            out = out.unionByName(rows.mapInArrow(self._predicted(mine, s), _PREDICTED))
        return out

    def _predicted(self, fits: DataFrame, s: B.Settings):
        spark = fits.sparkSession
        cuts = [np.array(r["cuts"]) for r in self.cuts.orderBy("place").collect()]
        trees: dict[tuple[int, int], list[tuple[str, B.Trees]]] = {}
        n = 2 << s.depth
        for r in self.trees.join(F.broadcast(fits), ["retrain", "h"]).collect():  # at most HELD bytes
            grid = lambda c, t, r=r: np.array(r[c], dtype=t).reshape(-1, n)
            trees.setdefault((r["retrain"], r["h"]), []).append((r["target"], B.Trees(r["base"], grid("feature", np.int16), grid("bin", np.uint8), grid("missing_left", bool), grid("value", float))))
        held = spark.sparkContext.broadcast((cuts, trees))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, trees = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = B.binned(batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1), cuts)
                fit = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
                for retrain, h in np.unique(fit, axis=0).tolist():
                    at = np.flatnonzero((fit[:, 0] == retrain) & (fit[:, 1] == h))
                    rows = batch.take(pa.array(at))
                    for target, t in trees.get((retrain, h), []):
                        pred = t.base + B.predict(t, bins[at], s.depth)
                        yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array([target] * len(at)), pa.array(pred)], names=["retrain", "h", "session_idx", "ticker", "target", "pred"])

        return of


@kind("lightgbm")
@kind("boosted")
def _boosted(spec: dict, defaults: dict) -> Estimator:
    return BoostedSpans({**defaults, **(spec.get("params") or {})})


# -- walk-forward ------------------------------------------------------------------------------------------------
def spans_of(fits: DataFrame) -> list[tuple]:
    """(retrain, h, train_start, train_end, until) of a schedule of fits, a row for each; until: the next retrain of the horizon."""
    until = F.lead("retrain").over(Window.partitionBy("h").orderBy("retrain"))
    return [tuple(r) for r in fits.select("retrain", "h", "train_start", "train_end", until.alias("until")).orderBy("h", "retrain").collect()]


def walk_forward(rows: DataFrame, fits: DataFrame, features: list[str], targets: dict[int, list[str]], spec: dict, least: int = 50, trains: str = "tradable", asked: str = "tradable", store: str | None = None) -> DataFrame:
    """retrain, h, session_idx, ticker, target, pred of a model entry; with ``store`` the fitted model is written there."""
    model = make(spec).over(spans=spans_of(fits), features=features, targets=targets, least=least, trains=trains, asked=asked).fit(rows)
    if store:
        model.write().overwrite().save(store)
    return model.transform(rows)


def stored(spark: SparkSession, spec: dict, path: str) -> _SpanModel:
    """The fitted model of an entry that was stored at a path."""
    cls = {RidgeSpans: RidgeSpansModel, BoostedSpans: BoostedSpansModel}[type(make(spec))]
    return cls.load(path)
