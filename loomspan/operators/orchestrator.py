"""Many fits as Spark jobs side by side: resumed by what is there, one failure kept from the others.

Each (model, window, h) is a job with a folder of its own, so jobs commit apart; a folder counts once Spark has written its
_SUCCESS.  Jobs run in threads that carry their own local properties and scheduler pool (with spark.scheduler.mode FAIR
a small fit is not held up by a large one).  What a job did is observed while its rows are written, not counted again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.sources.shared_files import Files

WARMUP = 63  # earlier predictions that a time-series bin ranks against


@dataclass(frozen=True, order=True)
class Job:
    model: str
    window: str
    h: int

    def place(self, folder: str) -> str:
        return f"{folder}/preds/model={self.model}/window={self.window}/h={self.h}"


@dataclass
class Outcome:
    job: Job
    state: str  # done, resumed (was there), failed
    seconds: float = 0.0
    rows: int = 0
    first: int | None = None
    last: int | None = None
    error: str = field(default="", repr=False)


class RunFailed(RuntimeError):
    """Some jobs failed; the others are done and stay."""


def run(spark: SparkSession, jobs: list[Job], work: Callable[[Job], DataFrame], folder: str, workers: int = 3, slow: Callable[[Job], bool] = lambda job: False, say: Callable[[str], None] = print) -> list[Outcome]:
    """Do all jobs whose predictions are not there yet, some at a time, slow ones first; returns an outcome for each.

    work: from a job to its predictions (session_idx, ticker, pred, ...).  A failed job leaves no _SUCCESS, so the next
    run does it again, and only it.
    """
    files = Files(spark)

    def one(job: Job) -> Outcome:
        began = time.time()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{job.model}-{job.window}")
        spark.sparkContext.setJobDescription(f"fit {job.model} {job.window} h{job.h}")
        try:
            seen = Observation(f"{job.model}-{job.window}-{job.h}-{uuid.uuid4().hex}")
            rows = work(job).observe(seen, F.count(F.lit(1)).alias("rows"), F.min("session_idx").alias("first"), F.max("session_idx").alias("last"))
            rows.write.mode("overwrite").parquet(job.place(folder))
            return Outcome(job, "done", time.time() - began, **seen.get)
        except Exception as error:  # noqa: BLE001 (told in the outcome; the other jobs go on)
            return Outcome(job, "failed", time.time() - began, error=f"{type(error).__name__}: {error}"[:2000])
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    there = {job for job in jobs if files.exists(f"{job.place(folder)}/_SUCCESS")}
    outcomes = [Outcome(job, "resumed") for job in jobs if job in there]
    for o in outcomes:
        say(f"resume: {o.job} has its predictions")
    left = sorted((job for job in jobs if job not in there), key=lambda job: not slow(job))
    with ThreadPoolExecutor(max_workers=workers) as pool:
        # each job gets its own copy of the caller's local properties and tags
        for done in as_completed([pool.submit(inheritable_thread_target(spark)(one), job) for job in left]):
            outcomes.append(done.result())
            say(f"{outcomes[-1].state}: {outcomes[-1].job}, {outcomes[-1].rows} rows in {outcomes[-1].seconds:.1f} s")
    return sorted(outcomes, key=lambda o: o.job)


def check(outcomes: list[Outcome]) -> list[Outcome]:
    """The outcomes, or RunFailed with every failure."""
    failed = [o for o in outcomes if o.state == "failed"]
    if failed:
        raise RunFailed("; ".join(f"{o.job}: {o.error}" for o in failed))
    return outcomes


def predictions(spark: SparkSession, folder: str, jobs: list[Job]) -> DataFrame:
    """The predictions of jobs that are done; reading by model, window and h prunes to their folders."""
    files = Files(spark)
    places = [p for p in (job.place(folder) for job in jobs) if files.exists(f"{p}/_SUCCESS")]
    return spark.read.option("basePath", f"{folder}/preds").parquet(*places)


def fit_log(fits: DataFrame, rows: DataFrame, sessions: DataFrame, trains: str = "tradable") -> DataFrame:
    """h, retrain, train_start, train_end as dates and the rows of each span: the difference of two running counts by session."""
    counts = sessions.select("session_idx", "date").join(rows.filter(F.col(trains)).groupBy("session_idx").agg(F.count(F.lit(1)).alias("n")), "session_idx", "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1)).orderBy("session_idx"))  # a row for each session
    known = counts.select("session_idx", "date", upto.alias("upto"), (upto - F.coalesce("n", F.lit(0))).alias("before"))
    at = lambda name, *more: known.select(F.col("session_idx").alias(name), F.col("date").alias(f"{name}_date"), *more)
    joined = fits.join(at("train_start", "before"), "train_start").join(at("train_end", "upto"), "train_end").join(at("retrain"), "retrain")
    return joined.select("h", *[F.col(f"{c}_date").alias(c) for c in ("retrain", "train_start", "train_end")], (F.col("upto") - F.col("before")).alias("rows"))


def first_usable(panel: DataFrame, flag: str = "tradable") -> int | None:
    """The first session that has a row with the flag."""
    return panel.agg(F.min(F.when(F.col(flag), F.col("session_idx")))).first()[0]


def first_full_bins(fits: DataFrame, asked: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """window, h, session_idx: where the first full time-series bin is; null where there is no fit.

    fits: window, h, retrain; asked: every (window, h).  The first prediction is at the first retrain that has a span.
    """
    first = fits.groupBy("window", "h").agg((F.min("retrain") + warmup).alias("session_idx"))
    return asked.select("window", "h").distinct().join(first, ["window", "h"], "left")


def late_bins(bins: DataFrame, sessions: DataFrame, start: str) -> list[str]:
    """A warning for each (window, h) whose first full bin comes after the first session of the evaluation."""
    begins = sessions.agg(F.count_if(F.col("date") < F.lit(start).cast("date"))).first()[0]
    late = bins.filter(F.col("session_idx").isNull() | (F.col("session_idx") > begins)).join(sessions.select("session_idx", "date"), "session_idx", "left")
    rows = late.orderBy("window", "h").collect()  # a row for each window and horizon
    return [f"window {r['window']}, horizon {r['h']}: the first full bin is {'on ' + str(r['date']) if r['date'] else 'never'}, after the start of the evaluation on {start}" for r in rows]


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], texts: dict[str, str] | None = None) -> str:
    """All outputs of a stage under one commit: written beside the folder, then moved to it by one rename.

    A stage that is killed leaves nothing at its folder; what an earlier run of the stage left there is replaced whole.
    """
    files = Files(spark)
    beside = f"{folder}.making-{uuid.uuid4().hex}"
    try:
        for name, table in tables.items():
            table.write.parquet(f"{beside}/{name}")
        for name, text in (texts or {}).items():
            files.create(f"{beside}/{name}", text)
    except BaseException:
        files.delete(beside)
        raise
    before = f"{folder}.before-{uuid.uuid4().hex}"
    had = files.exists(folder)
    if had:
        files.move(folder, before)
    files.move(beside, folder)
    if had:
        files.delete(before)
    return folder
