"""Commands of a run over a snapshot: ``python -m loomspan.cli COMMAND --base SETTINGS --data SNAPSHOT --runs RUNS ...``

snapshot  write the tables of a snapshot from market files
features  build the features of the panel, or find them by their key
labels    build the labels, or find them
train     fit every enabled model x window x horizon that has no predictions yet
groups    fit the groups of a run and write their scores as predictions of their members
all       features, labels, train
holdout   open the holdout for the trials that an unlock names, and fit their models on all sessions; once for a run

Backtest, environment and book have no command: their operators are called from queries (plans/run_queries.py).
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import catalogue, settings_relations
from loomspan.functions.settings import SettingsError
from loomspan.functions.shipping import ship
from loomspan.operators import controls as C
from loomspan.operators import holdout as H
from loomspan.operators import ingest as I
from loomspan.operators import learners as L
from loomspan.operators import orchestrator as O
from loomspan.operators import panel_ops as P
from loomspan.operators import runs as R
from loomspan.operators import stage_outputs as SO
from loomspan.operators import stages as G
from loomspan.plans import algebra as A
from loomspan.sources import panel_store as PS
from loomspan.sources import snapshot as X
from loomspan.sources.shared_files import Files

KEYS = ("session_idx", "date", "ticker")
#: Families that need no series from outside the bars and no state of their own.
FAMILIES = ("momentum", "volatility", "drawdown", "trend", "candles", "gaps", "compression", "volume", "relative")
GROUP_WINDOWS = {"expanding": None, "rolling_5y": 1260}
CASH = "SHY"


@dataclass
class Command:
    """What the commands share: settings, places and the mode of the data."""

    spark: SparkSession
    settings: dict
    data: str
    runs: str
    mode: str = "dev"
    opened: H.Holdout | None = None
    families: tuple[str, ...] = FAMILIES
    rebuild: bool = False
    workers: int = 3

    @property
    def fence(self) -> str:
        return str(self.settings["data"]["fence_date"])

    @property
    def derived(self) -> str:
        return f"{self.data}/derived_{self.mode}"

    def panel(self) -> DataFrame:
        """The panel as a bucketed table, made once for its data."""
        key = R.fingerprint(self.spark, *(f"{self.data}/{p}/bars.parquet" for p in (("dev",) if self.mode == "dev" else ("dev", "holdout"))))
        name = f"panel_{self.mode}_{key}"
        if self.spark.catalog.tableExists(name):
            return PS.stored(self.spark, name)
        unlock = self.opened.unlock if self.opened else None
        tables = PS.load(self.spark, self.data, self.mode, self.fence, unlock, self.runs)
        return PS.store(tables.panel, name, f"{self.derived}/{name}")

    def tickers(self) -> DataFrame:
        return self.spark.read.csv(f"{self.data}/tickers.csv", header=True)

    def roles(self) -> dict[str, str]:
        return {r["ticker"]: r["ticker"] for r in self.tickers().select("ticker").collect()}  # the universe

    def _key(self, section: str, *modules) -> str:
        data = R.fingerprint(self.spark, f"{self.data}/dev/bars.parquet", *([f"{self.data}/holdout/bars.parquet"] if self.mode == "full" else []))
        return R.cache_key({section: self.settings.get(section), "families": self.families}, R.code_hash(*(Path(m.__file__) for m in modules)), data)

    def feature_names(self) -> list[str]:
        return sorted(n for f in self.families for n in catalogue.family(catalogue.FAMILIES[f], self.roles()))

    def features(self) -> DataFrame:
        """session_idx, date, ticker, tradable and all features, as ranks of the session less a half; missing: 0."""

        def make() -> DataFrame:
            out = self.panel().select(*KEYS, "tradable")
            for name in self.families:
                found = catalogue.family(catalogue.FAMILIES[name], self.roles())
                part = A.evaluate(self.panel(), {n: A.first_of(A.rank(e) - 0.5, 0.0) for n, e in found.items()}, keep=("session_idx", "ticker"))
                out = out.join(part, ["session_idx", "ticker"])
            return out

        return R.cached(self.spark, self.derived, "features", self._key("context", catalogue, A), make, self.rebuild)[0]

    def labels(self) -> DataFrame:
        """session_idx, ticker, h and a column for each variant, a folder for each horizon."""
        lab = self.settings["labels"]

        def one(h: int) -> DataFrame:
            outputs = {n.removesuffix(f"_h{h}"): e for n, e in P.labels(h, None, lab["min_vol_window"]).items()}
            for v in lab["variants"]:
                if v.startswith("payoff_l"):
                    outputs[v] = P.labels(h, float(v[8:]), lab["min_vol_window"])[f"payoff_h{h}"]
            return A.evaluate(self.panel(), {v: outputs[v] for v in lab["variants"]}, keep=("session_idx", "ticker")).withColumn("h", F.lit(h))

        def make() -> DataFrame:
            parts = [one(h) for h in lab["horizons"]]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out

        return R.cached(self.spark, self.derived, "labels", self._key("labels", P, A), make, self.rebuild, ("h",))[0]

    def sessions(self) -> DataFrame:
        return self.panel().select("session_idx", "date").distinct()

    def spans(self, window: str, h: int, first: int) -> DataFrame:
        wf = self.settings["walkforward"]
        back = P.reach(h, self.settings["labels"]["min_vol_window"]) + wf["purge_extra_sessions"]
        schedule = I.retrain_schedule(self.sessions(), 0, wf["retrain_every_months"])
        return I.fits(schedule, (h,), wf["window_sessions"].get(window), first, lambda _: back)

    def train(self, run: R.Run, least: int = settings_relations.LEAST_ROWS) -> list[O.Outcome]:
        """Every enabled model x window x horizon that has no predictions yet; models and logs of fits stay beside them."""
        specs = {m["name"]: m for m in settings_relations.enabled(self.settings["models"])}
        features, labels, names = self.features(), self.labels(), self.feature_names()
        first = O.first_usable(self.panel())
        if first is None:
            raise SettingsError("no ticker is ever tradable in this snapshot")
        jobs = [O.Job(m, w, h) for m in specs for w in self.settings["walkforward"]["windows"] for h in self.settings["labels"]["horizons"]]

        def work(job: O.Job) -> DataFrame:
            rows = features.join(labels.filter(F.col("h") == job.h).drop("h"), ["session_idx", "ticker"])
            spans = self.spans(job.window, job.h, first)
            place = f"model={job.model}/window={job.window}/h={job.h}"
            O.fit_log(spans, rows, self.sessions()).write.mode("overwrite").parquet(f"{run.folder}/fits/{place}")
            return L.walk_forward(rows, spans, names, {job.h: list(self.settings["labels"]["variants"])}, specs[job.model], least=least, store=f"{run.folder}/models/{place}").drop("h")

        asked = self.spark.createDataFrame([(w, h) for w in self.settings["walkforward"]["windows"] for h in self.settings["labels"]["horizons"]], "window string, h int")
        made = [self.spans(w, h, first).withColumn("window", F.lit(w)) for w, h in asked.collect()]
        every = made[0]
        for s in made[1:]:
            every = every.unionByName(s)
        for said in O.late_bins(O.first_full_bins(every, asked), self.sessions(), str(self.settings["evaluation"]["common_start"])):
            print(f"warning: {said}")
        return O.check(O.run(self.spark, jobs, work, run.folder, self.workers, lambda job: specs[job.model]["kind"] != "ridge"))

    def groups(self, run: R.Run, least: int = settings_relations.LEAST_ROWS, first_end: int = 300) -> str:
        """Groups of the universe: their mean features, rank labels, fits, and scores as predictions of their members."""
        members = C.group_map(self.tickers())
        panel = self.panel().drop("asset_group").join(F.broadcast(members.select("ticker", F.col("group").alias("asset_group"))), "ticker").filter("asset_group is not null")
        alive = A.group_sum(A.flag(A.TRADABLE)) > 0
        r = A.group_mean(P.next_open_return())
        horizons = tuple(self.settings["labels"]["horizons"])
        features = {n: A.group_mean(e) for f in self.families for n, e in catalogue.family(catalogue.FAMILIES[f], self.roles()).items()}
        outputs = features | {f"label_h{h}": G.group_label(r, alive, h, P.average_pct) for h in horizons} | {"_alive": A.flag(alive)}
        wide = A.evaluate(panel, outputs, keep=("session_idx", "ticker")).join(panel.select("session_idx", "ticker", "asset_group"), ["session_idx", "ticker"])
        rows = wide.groupBy("session_idx", "asset_group").agg(*[F.max(c).alias(c) for c in outputs]).withColumnRenamed("asset_group", "ticker").withColumn("tradable", F.col("_alive") > 0)
        rows = R.cached(self.spark, self.derived, "groups", self._key("labels", catalogue, A, G), lambda: rows, self.rebuild)[0]
        purge = self.settings["groups"]["purge_extra_sessions"]
        schedule = I.retrain_schedule(self.sessions(), 0, 1)
        parts = []
        for spec in settings_relations.enabled(self.settings["models"]):
            for window, size in GROUP_WINDOWS.items():
                spans = I.fits(schedule, horizons, size, 0, lambda h: h + max(h, P.MIN_VOL_WINDOW) + purge, history=first_end + 1)
                found = L.walk_forward(rows, spans.filter(F.col("train_end") >= first_end), sorted(features), {h: [f"label_h{h}"] for h in horizons}, spec, least=least)
                parts.append(found.select(F.lit(spec["name"]).alias("model"), F.lit(window).alias("window"), "h", "session_idx", F.col("ticker").alias("group"), "pred"))
        preds = parts[0]
        for p in parts[1:]:
            preds = preds.unionByName(p)
        ok = self.panel().select("session_idx", "ticker", (F.col("tradable") & (F.col("ticker") != CASH)).alias("eligible"))
        variants = list(self.settings["labels"]["variants"])
        return SO.groups(f"{run.folder}/groups", members, rows, preds, ok, variants[0], variants, self.settings, run.record()["settings"])


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="loomspan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("command", choices=["snapshot", "features", "labels", "train", "groups", "all", "holdout"])
    ap.add_argument("--base", required=True, help="YAML file of all settings")
    ap.add_argument("--overlay", action="append", default=[], help="YAML file merged over the base (repeatable)")
    ap.add_argument("--set", dest="sets", action="append", default=[], help="key.path=value, last (repeatable)")
    ap.add_argument("--data", required=True, help="folder of the snapshot")
    ap.add_argument("--runs", required=True, help="folder of all runs")
    ap.add_argument("--run-id", help="name of the run; a known one is gone on with")
    ap.add_argument("--workers", type=int, help="fits at a time (compute.workers)")
    ap.add_argument("--rebuild", action="store_true", help="build features and labels anew")
    ap.add_argument("--families", nargs="+", default=list(FAMILIES), choices=list(FAMILIES), help="families of features")
    ap.add_argument("--least-rows", type=int, default=settings_relations.LEAST_ROWS, help="rows that a fit needs")
    ap.add_argument("--source", help="snapshot: folder of the market files")
    ap.add_argument("--indices", help="snapshot: folder of the index files")
    ap.add_argument("--universe", help="snapshot: table of the stock universe")
    ap.add_argument("--tickers", help="snapshot: CSV of the universe's tickers")
    return ap.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> R.Run | None:
    """Run one command; returns the run it made or went on with."""
    a = _arguments(argv)
    settings = settings_relations.load_files(a.base, a.overlay, a.sets)
    spark = spark or SparkSession.builder.appName(f"loomspan {a.command}").getOrCreate()
    ship(spark)
    command = Command(spark, settings, a.data, a.runs, families=tuple(a.families), rebuild=a.rebuild, workers=a.workers or settings["compute"]["workers"])
    if a.command == "snapshot":
        lacking = [n for n in ("source", "indices", "universe", "tickers") if getattr(a, n) is None]
        if lacking:
            raise SettingsError(f"snapshot needs --{', --'.join(lacking)}")
        X.build(spark, a.source, a.data, spark.read.csv(a.tickers, header=True), command.fence, a.indices, a.universe)
        return None
    if a.command in ("features", "labels"):
        print(f"{a.command}: {getattr(command, a.command)().count()} rows")
        return None
    if a.command == "holdout":
        return _holdout(command, a)
    run = R.Run.begin(spark, a.runs, settings, Path(__file__).resolve().parent, a.run_id, {"overlays": list(map(str, a.overlay)), "sets": a.sets})
    if a.command in ("train", "all"):
        command.train(run, a.least_rows)
    if a.command == "groups":
        command.groups(run, a.least_rows)
    print(f"run {run.run_id}")
    return run


def _holdout(command: Command, a: argparse.Namespace) -> R.Run:
    """The run's own frozen settings decide, not today's; the base only lays them out."""
    unlock = H.read_unlock_file(command.spark, f"{a.data}/{command.settings['paths']['unlock_file']}")
    known = X.read_unlock(unlock, lambda run: Files(command.spark).exists(f"{a.runs}/{run}/run.json"))
    frozen = R.Run(command.spark, f"{a.runs}/{known['run_id']}", str(known["run_id"])).settings(command.settings)
    command.opened = H.open_holdout(command.spark, a.runs, unlock, frozen)
    command.settings, command.mode = command.opened.settings, "full"
    run = R.Run.begin(command.spark, a.runs, command.settings, Path(__file__).resolve().parent, f"holdout_{known['run_id']}")
    command.train(run, a.least_rows)
    return run


if __name__ == "__main__":
    main()
