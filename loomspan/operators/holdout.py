"""The holdout: sealed until an unlock names trials of a run that exists, opened once for each run.

Order matters: the unlock and its run are checked, the chosen trials are looked up, the result folder is claimed by
an exclusive create, and only then may a row of the holdout be read.
"""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import grid as G
from loomspan.operators.ingest import FenceError
from loomspan.sources import snapshot as X
from loomspan.sources.shared_files import Files

LOCK = "UNLOCK.yaml"


@dataclass
class Holdout:
    """An opened holdout: where its results go, the trials it is for, and the settings that make only those."""

    spark: SparkSession
    runs: str
    folder: str
    unlock: dict
    chosen: DataFrame
    settings: dict

    def table(self, snapshot: str, name: str, fence: str) -> DataFrame:
        """A table of the snapshot before and from the fence."""
        return X.read(self.spark, snapshot, name, "full", fence, self.unlock, self.runs)

    def confirmed(self, trials: DataFrame) -> DataFrame:
        """Trials of the holdout at the choices of the chosen ones, under their ids."""
        return G.confirm(trials, self.chosen)

    def save(self, trials: DataFrame) -> str:
        """Write the confirmed trials; a second result of the same run is an error."""
        path = f"{self.folder}/holdout_trials"
        self.confirmed(trials).write.mode("error").parquet(path)
        return path


def read_unlock_file(spark: SparkSession, path: str) -> dict:
    files = Files(spark)
    return (yaml.safe_load(files.text(path)) or {}) if files.exists(path) else {}


def chosen_trials(trials: DataFrame, ids: list) -> DataFrame:
    """The trials that an unlock names; their number is that of its ids."""
    named = trials.sparkSession.createDataFrame([(str(i),) for i in dict.fromkeys(ids)], "trial_id string")
    return trials.join(F.broadcast(named), "trial_id", "left_semi")


def open_holdout(spark: SparkSession, runs: str, unlock: dict, settings: dict) -> Holdout:
    """Open the holdout of the run that the unlock names; settings: those frozen with the run."""
    files = Files(spark)
    known = X.read_unlock(unlock, lambda run: files.exists(f"{runs}/{run}/trials"))
    chosen = chosen_trials(spark.read.parquet(f"{runs}/{known['run_id']}/trials"), known["config_ids"])
    named = chosen.select("model", "window").distinct().collect()  # as many as the unlock has ids at most
    if not named:
        raise FenceError(f"the unlock names no trial of run {known['run_id']}")
    models, windows = {r["model"] for r in named}, sorted({r["window"] for r in named})
    only = settings | {"models": [m for m in settings.get("models", []) if m["name"] in models], "walkforward": settings.get("walkforward", {}) | {"windows": windows}}
    folder = f"{runs}/holdout_{known['run_id']}"
    if not files.create(f"{folder}/{LOCK}", yaml.safe_dump({k: str(v) if k == "date" else v for k, v in known.items()}, sort_keys=False)):
        raise FenceError(f"{folder} is there: the holdout of a run is opened once")
    files.create(f"{folder}/settings.yaml", yaml.safe_dump(only, sort_keys=False))
    return Holdout(spark, runs, folder, known, chosen, only)
