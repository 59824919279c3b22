"""Evaluation of many trials: return measures, information coefficients, deflated Sharpe and backtest overfitting.

Trials are a long table (trial, session_idx, net).  Everything that is a sum is an ordinary aggregate; only the two
multiple-testing statistics, which work on a handful of numbers for each trial, run in Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252
EULER = 0.5772156649015329


def _log_growth() -> Column:
    """Sum of log(1 + r); missing once the book is worth nothing."""
    return F.when(F.min("net") > -1, F.sum(F.when(F.col("net") > -1, F.log1p("net"))))


def summary(trials: DataFrame) -> DataFrame:
    """n, sharpe, cagr, vol, hit_rate, skew (biased) and kurt (raw) of each trial."""
    sd = F.stddev_samp("net")
    return trials.groupBy("trial").agg(
        F.count("net").alias("n"),
        F.when(sd > 1e-12, F.avg("net") / sd * math.sqrt(YEAR)).alias("sharpe"),
        F.coalesce(F.exp(_log_growth() * YEAR / F.count("net")) - 1, F.lit(-1.0)).alias("cagr"),
        (sd * math.sqrt(YEAR)).alias("vol"),
        F.try_divide(F.count_if(F.col("net") > 0).cast("double"), F.count_if(F.col("net") != 0)).alias("hit_rate"),
        F.skewness("net").alias("skew"),
        (F.kurtosis("net") + 3).alias("kurt"),
    )


def equity(trials: DataFrame) -> DataFrame:
    """trial, session_idx, equity, drawdown from the running peak (which starts at the first equity)."""
    so_far = Window.partitionBy("trial").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0)
    # the running product of 1 + net: its size by logarithms, its sign by the number of losses beyond everything, 0 for good after one of 100%
    grown = 1 + F.coalesce("net", F.lit(0.0))
    size = F.exp(F.sum(F.when(grown != 0, F.ln(F.abs(grown)))).over(so_far))
    sign = 1 - 2 * (F.count_if(grown < 0).over(so_far) % 2)
    eq = trials.withColumn("equity", F.when(F.count_if(grown == 0).over(so_far) > 0, 0.0).otherwise(size * sign))
    return eq.select("trial", "session_idx", "equity", (F.try_divide("equity", F.max("equity").over(so_far)) - 1).alias("drawdown"))


def max_drawdown(trials: DataFrame) -> DataFrame:
    return equity(trials).groupBy("trial").agg(F.min("drawdown").alias("max_drawdown"))


def block_sharpes(trials: DataFrame, block: int = YEAR) -> DataFrame:
    """trial, blocks, and the median and lowest Sharpe over blocks of sessions."""
    sd = F.stddev_samp("net")
    by = trials.groupBy("trial", F.floor(F.col("session_idx") / block).alias("block")).agg(F.when(sd > 1e-12, F.avg("net") / sd * math.sqrt(YEAR)).alias("s"))
    return by.groupBy("trial").agg(F.count("s").alias("blocks"), F.median("s").alias("median_sharpe"), F.min("s").alias("min_sharpe"))


def slice_moments(trials: DataFrame, slices: int = 16) -> DataFrame:
    """trial, slice, s1, s2, n over equal runs of sessions; missing counts as 0."""
    spans = trials.agg(F.min("session_idx").alias("_lo"), (F.max("session_idx") - F.min("session_idx") + 1).alias("_n"))
    placed = trials.crossJoin(F.broadcast(spans))  # one row
    part = F.expr(f"({slices} * (session_idx - _lo + 1) - 1) div _n").cast("int")
    r = F.coalesce("net", F.lit(0.0))
    return placed.groupBy("trial", part.alias("slice")).agg(F.sum(r).alias("s1"), F.sum(r * r).alias("s2"), F.count(F.lit(1)).alias("n"))


@lru_cache(maxsize=64)  # all rows of a table ask for the same one
def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """Sharpe that the best of n trials without skill is expected to have."""
    if n_trials < 2:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float) -> float:
    """Probability that the (per-session) Sharpe exceeds the benchmark, given its higher moments."""
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    if n < 2 or spread <= 0:
        return float("nan")
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def add_deflated_sharpe(measures: DataFrame, n_trials: int | None = None) -> DataFrame:
    """The summary with dsr: deflated by the number and spread of all trials."""
    daily = F.col("sharpe") / math.sqrt(YEAR)
    totals = measures.agg(F.count("sharpe").alias("_trials"), F.coalesce(F.var_samp(daily), F.lit(0.0)).alias("_var"))
    joined = measures.crossJoin(F.broadcast(totals))  # one row

    @F.pandas_udf("double")
    def dsr(sr: pd.Series, n: pd.Series, skew: pd.Series, kurt: pd.Series, trials: pd.Series, var: pd.Series) -> pd.Series:
        out = [
            deflated_sharpe(a, int(b), c, d, expected_max_sharpe(n_trials or int(e), f)) if a == a else float("nan")
            for a, b, c, d, e, f in zip(sr / math.sqrt(YEAR), n, skew, kurt, trials, var, strict=True)
        ]
        return pd.Series(out)

    return joined.withColumn("dsr", F.nanvl(dsr("sharpe", "n", "skew", "kurt", "_trials", "_var"), F.lit(None).cast("double"))).drop("_trials", "_var")


_BLOCK = 512  # splits that are worked at once
_FIRST = "split int, inside double, trial string, outside double"


def _split_masks(k: int) -> np.ndarray:
    """(splits, k): 1 for the slices in sample, for every choice of half of them."""
    chosen = np.array(list(combinations(range(k), k // 2)))
    inside = np.zeros((len(chosen), k))
    np.put_along_axis(inside, chosen, 1.0, axis=1)
    return inside


def _mask_sharpe(mask: np.ndarray, n: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """(splits, trials): Sharpe over the slices of each mask, from moments (trials, slices)."""
    m = (mask @ n)[:, None]
    mean = mask @ s1.T / m
    var = (mask @ s2.T - m * mean**2) / (m - 1)
    return np.divide(mean, np.sqrt(np.maximum(var, 0)), out=np.full(mean.shape, -np.inf), where=var > 1e-24)


def overfitting(moments: DataFrame) -> DataFrame:
    """pbo, n_splits: share of symmetric splits in which the best trial in sample ranks in the lower half out of sample.

    Trials stay dealt out: one pass finds the best trial of each split within some trials, an aggregate the best of
    all (ties: the first by name); a second pass counts the trials below it out of sample.  What goes to every task is
    a row for each split and the lengths of the slices, both of fixed size.
    """
    packed = F.sort_array(F.collect_list(F.struct("slice", "s1", "s2")))
    rows = moments.groupBy("trial").agg(packed.alias("_m")).select("trial", F.col("_m.s1").alias("s1"), F.col("_m.s2").alias("s2"))
    lengths = {r["slice"]: r["n"] for r in moments.groupBy("slice").agg(F.max("n").alias("n")).collect()}  # a row for each slice
    n = np.array([lengths[k] for k in sorted(lengths)], dtype=float)
    k = len(n)

    def blocks(batch: pd.DataFrame):
        masks = _split_masks(k)
        s1, s2 = np.stack(batch["s1"]).astype(float), np.stack(batch["s2"]).astype(float)
        for a in range(0, len(masks), _BLOCK):
            part = masks[a : a + _BLOCK]
            yield a, part, s1, s2

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("trial")
            names = batch["trial"].to_numpy()
            for a, part, s1, s2 in blocks(batch):
                inside = _mask_sharpe(part, n, s1, s2)
                at = inside.argmax(axis=1)
                each = np.arange(len(part))
                yield pd.DataFrame({"split": a + each, "inside": inside[each, at], "trial": names[at], "outside": _mask_sharpe(1 - part, n, s1, s2)[each, at]})

    found = rows.mapInPandas(best, _FIRST).groupBy("split").agg(F.min_by(F.col("outside"), F.struct(-F.col("inside"), "trial")).alias("mine"))
    mine = np.array([r["mine"] for r in found.orderBy("split").collect()])  # a number for each split

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, part, s1, s2 in blocks(batch):
                outside, own = _mask_sharpe(1 - part, n, s1, s2), mine[a : a + _BLOCK, None]
                yield pd.DataFrame({"split": a + np.arange(len(part)), "trials": len(batch), "rank": (outside < own).sum(axis=1) + 0.5 * (outside == own).sum(axis=1)})

    ranks = rows.mapInPandas(below, "split int, trials long, rank double").groupBy("split").agg(F.sum("trials").alias("trials"), F.sum("rank").alias("rank"))
    low = (F.col("rank") + 0.5) / (F.col("trials") + 1) <= 0.5
    return ranks.agg(F.avg(low.cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_splits"))


def dated_sharpes(trials: DataFrame, blocks: tuple[tuple[str, str], ...]) -> DataFrame:
    """trial, block, sharpe over the sessions of each block of dates (first, last), both included; trials have a date."""
    named = trials.sparkSession.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(blocks)], "block int, _from string, _to string")
    on = (F.col("date") >= F.col("_from").cast("date")) & (F.col("date") <= F.col("_to").cast("date"))
    sd = F.stddev_samp("net")
    return trials.join(F.broadcast(named), on).groupBy("trial", "block").agg(F.when(sd > 1e-12, F.avg("net") / sd * math.sqrt(YEAR)).alias("sharpe"))


def daily_ic(ranked: DataFrame, least: int = 5) -> DataFrame:
    """session_idx, ic, n: correlation of the rank columns a and b in sessions with enough complete pairs."""
    both = ranked.filter("a is not null and b is not null")
    n, sa, sb = F.count(F.lit(1)), F.stddev_samp("a"), F.stddev_samp("b")
    return both.groupBy("session_idx").agg(F.when((sa > 1e-12) & (sb > 1e-12), F.covar_samp("a", "b") / (sa * sb)).alias("ic"), n.alias("n")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ics: DataFrame, horizon: int, least: int = 20) -> DataFrame:
    """sessions, mean_ic, t_ic with overlap-adjusted observations."""
    n, sd = F.count("ic"), F.stddev_samp("ic")
    return ics.agg(n.alias("sessions"), F.when(n >= least, F.avg("ic")).alias("mean_ic"), F.when((n >= least) & (sd > 1e-12), F.avg("ic") / sd * F.sqrt(n / horizon)).alias("t_ic"))


def medians(trials: DataFrame, measure: str, *choices: str) -> DataFrame:
    """Median and count by each single choice, all choices in one pass (grouping sets)."""
    sets = [[c] for c in choices]
    rows = trials.select(F.explode(F.array(*[F.struct(F.lit(s[0]).alias("choice"), F.col(s[0]).cast("string").alias("value")) for s in sets])).alias("_g"), measure)
    return rows.groupBy("_g.choice", "_g.value").agg(F.median(measure).alias("median"), F.count(F.lit(1)).alias("n"))


def percentiles(controls: DataFrame, measure: str, *by: str) -> DataFrame:
    p = F.percentile(measure, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return controls.groupBy(*by).agg(p.alias("_p")).select(*by, F.col("_p")[0].alias("p05"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p95"))




def _measured(forecasts: DataFrame, first: int, stop: int) -> Column:
    return F.col("p").isNotNull() & F.col("y").isNotNull() & (F.col("session_idx") >= first) & (F.col("session_idx") < stop)


def spearman(forecasts: DataFrame, horizon: int, first: int = 0, stop: int = 1 << 30, least: int = 100) -> DataFrame:
    """key, n, spearman, t: rank correlation of p and y over [first, stop), ties at their mean rank; t with n / horizon."""
    rows = forecasts.filter(_measured(forecasts, first, stop))
    rank = lambda c: F.rank().over(Window.partitionBy("key").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("key", c)) - 1) / 2
    ranked = rows.select("key", rank("p").alias("a"), rank("y").alias("b"))
    n, sa, sb = F.count(F.lit(1)), F.stddev_samp("a"), F.stddev_samp("b")
    c = F.when((n >= least) & (sa > 0) & (sb > 0), F.covar_samp("a", "b") / (sa * sb))
    return ranked.groupBy("key").agg(n.alias("n"), c.alias("spearman")).withColumn("t", F.col("spearman") * F.sqrt(F.col("n") / horizon))


def known_mean(forecasts: DataFrame, reach: int, min_sessions: int, base: str = "base") -> DataFrame:
    """The rows with the mean of their key's labels y that are known by then; missing for fewer than min_sessions."""
    known = Window.partitionBy("key").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, -(reach + 1))
    return forecasts.withColumn(base, F.when(F.count("y").over(known) >= min_sessions, F.avg("y").over(known)))


def oos_r2(forecasts: DataFrame, reach: int, min_sessions: int, first: int = 0, stop: int = 1 << 30, least: int = 100) -> DataFrame:
    """key, n, oos_r2: 1 - SSE(p) / SSE(mean of the labels known by then); a row for each key and session."""
    rows = known_mean(forecasts, reach, min_sessions, "_base").filter(_measured(forecasts, first, stop) & F.col("_base").isNotNull())
    miss, plain = F.sum((F.col("y") - F.col("p")) ** 2), F.sum((F.col("y") - F.col("_base")) ** 2)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, 1 - F.try_divide(miss, plain)).alias("oos_r2"))
