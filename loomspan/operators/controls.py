"""Fixed benchmarks, random control books, asset groups and the controls of a book.

Random draws are seeded NumPy draws; they follow the reference's distributions, not its generator's sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import panel_ops as P
from loomspan.operators import simulation as S
from loomspan.operators.stages import CASH_LIKE
from loomspan.plans import algebra as A

TOP_FRACTION = 0.10
RANDOM_FRACTIONS, RANDOM_REBALANCE, RANDOM_DRAWS, RANDOM_SEED = (0.10, 0.20, 0.30), (1, 5, 10, 21, 63), 500, 20261005
STALE_LAG, STRESS_BLOCK = 126, 21
_DRAWS_A_TASK = 100

#: name: sessions between rebalances, "monthly" or "once"
REBALANCE = {"ew_monthly": "monthly", "mom_12_1": 21, "mom_6_3": 63, "spy": "once", "spy_ief_60_40": "monthly", "inverse_vol_63": "monthly", "trend_200d": 1}

EQUITY_SPLIT = {
    "broad": ("broad_us_equity", "growth_mega_cap", "small_cap", "mid_cap", "value", "growth", "equal_weight"),
    "sector": ("sector",), "industry": ("industry",), "factor": ("factor",),
}


def benchmark_targets(panel: DataFrame, roles: dict[str, str], first: int, top: float = TOP_FRACTION) -> DataFrame:
    """trial, session_idx, ticker, target, r_next, rebalance of the seven fixed benchmarks; panel rows are dense."""
    close = A.col("close")
    best = lambda score: P.equal_weight(P.top_fraction(score, top) > 0.5)
    vol = A.std(close / A.lag(close, 1) - 1, 63)
    inverse = A.where(A.TRADABLE & (vol > 0), 1.0 / vol, 0.0)
    outputs = {
        "ew_monthly": P.equal_weight(A.TRADABLE), "mom_12_1": best(A.lag(close, 21) / A.lag(close, 252) - 1), "mom_6_3": best(close / A.lag(close, 126) - 1),
        "inverse_vol_63": inverse / A.hi2(A.cross_sum(inverse), 1e-12), "_above": A.where(close > A.mean(close, 200), 1.0, 0.0), "r_next": P.next_open_return(),
    }
    on = lambda role, w: F.when(F.col("ticker") == roles[role], w).otherwise(0.0)
    held = A.evaluate(panel, outputs, keep=("session_idx", "date", "ticker"))
    held = held.withColumns({"spy": on("SPY", F.lit(1.0)), "spy_ief_60_40": on("SPY", F.lit(0.6)) + on("IEF", F.lit(0.4)), "trend_200d": on("SPY", F.col("_above"))})
    every = clocks(held.select("session_idx", "date").distinct(), first, {f"on_{n}": r for n, r in REBALANCE.items()}).drop("date")  # a row for each session
    long = held.unpivot(["session_idx", "ticker", "r_next"], list(REBALANCE), "trial", "target").join(F.broadcast(every), "session_idx")
    rebalance = F.coalesce(*[F.when(F.col("trial") == n, F.col(f"on_{n}")) for n in REBALANCE])
    return long.withColumn("rebalance", rebalance).drop(*[f"on_{n}" for n in REBALANCE])


def clocks(sessions: DataFrame, first: int, rules: dict[str, int | str]) -> DataFrame:
    """The sessions (session_idx, date) with a flag for each rule: every N sessions, "monthly" (first of a month) or "once", from ``first`` on."""
    month = F.trunc("date", "month")
    before = F.lag(month).over(Window.partitionBy(F.lit(1)).orderBy("session_idx"))  # a row for each session
    s = F.col("session_idx")
    kinds = {"monthly": (s >= first) & (before.isNull() | (before != month)), "once": s == first}
    return sessions.withColumns({n: kinds[r] if isinstance(r, str) else S.rebalance_every(first, r) for n, r in rules.items()})


def random_target(score: np.ndarray, tradable: np.ndarray, fraction: float) -> np.ndarray:
    """Equal weights (draws, tickers) over the top fraction of the tradable ones of a session, one at least."""
    n = int(tradable.sum())
    k = max(1, int(np.ceil(fraction * n)))
    out = np.zeros(score.shape)
    if n:
        order = np.argsort(-np.where(tradable, score, -np.inf), axis=1)[:, :k]
        np.put_along_axis(out, order, 1.0 / k, axis=1)
    return out


def fold_random(tradable: np.ndarray, r: np.ndarray, cash_rate: np.ndarray, fraction: float, every: int, first: int, draws: int, seed: tuple[int, ...]):
    """(gross, turnover), draws x sessions, of random books: fold_banded without a band, all draws at once."""
    rng = np.random.default_rng(seed)
    r, cash_rate = np.nan_to_num(r), np.nan_to_num(cash_rate)
    gross, turnover = np.zeros((draws, len(r))), np.zeros((draws, len(r)))
    w, cash, live = np.zeros((draws, r.shape[1])), np.ones(draws), False
    for t in range(len(r)):
        if t >= first and (t - first) % max(1, every) == 0:
            goal = random_target(rng.random(w.shape), tradable[t], fraction)
            turnover[:, t] = np.abs(goal - w).sum(axis=1)
            w, cash, live = goal, 1.0 - goal.sum(axis=1), True
        if live:
            gross[:, t] = w @ r[t] + cash * cash_rate[t]
            worth = 1 + gross[:, t]
            worth = np.where(worth > 1e-9, worth, 1.0)
            w, cash = w * (1 + r[t]) / worth[:, None], cash * (1 + cash_rate[t]) / worth
    return gross, turnover


def random_books(panel: DataFrame, first: int, cost: float = 0.0, draws: int = RANDOM_DRAWS, fractions=RANDOM_FRACTIONS, rebalance=RANDOM_REBALANCE) -> DataFrame:
    """trial, draw, session_idx, net from (session_idx, ticker, tradable, r_next, cash_next), dense.

    The panel as matrices (sessions x tickers, not facts) is broadcast; some draws of a trial are a task.
    """
    spark = panel.sparkSession
    rows = panel.select("session_idx", "ticker", "tradable", "r_next", "cash_next").toPandas()
    wide = rows.pivot(index="session_idx", columns="ticker")
    shared = spark.sparkContext.broadcast((wide["tradable"].to_numpy(dtype=bool), wide["r_next"].to_numpy(dtype=float), wide["cash_next"].to_numpy(dtype=float)[:, 0], wide.index.to_numpy()))
    jobs = [(i, f, e, a, min(_DRAWS_A_TASK, draws - a)) for i, (f, e) in enumerate((f, e) for f in fractions for e in rebalance) for a in range(0, draws, _DRAWS_A_TASK)]

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tradable, r, cash, at = shared.value
        for batch in batches:
            for i, f, e, a, n in batch[["i", "f", "e", "a", "n"]].itertuples(index=False):
                gross, turnover = fold_random(tradable, r, cash, f, int(e), first, int(n), (RANDOM_SEED, int(i), int(a)))
                yield pd.DataFrame({"trial": f"random_f{f:.2f}_n{int(e)}", "draw": np.repeat(np.arange(a, a + n), len(at)), "session_idx": np.tile(at, int(n)), "net": (gross - cost * turnover).ravel()})

    dealt = spark.createDataFrame(jobs, "i int, f double, e int, a int, n int").repartition(len(jobs), "i", "a")
    return dealt.mapInPandas(some, "trial string, draw int, session_idx int, net double")


def group_map(tickers: DataFrame) -> DataFrame:
    """ticker, group (null: cash, in no group), group_idx (by name, -1: none) from (ticker, block_name, role).

    Equities are split by role; a role without a split raises an error.
    """
    split = F.coalesce(*[F.when(F.col("role").isin(*roles), F.lit(f"eq_{n}")) for n, roles in EQUITY_SPLIT.items()])
    unknown = F.raise_error(F.concat(F.lit("EQUITY_SPLIT does not name the role "), F.coalesce("role", F.lit("null")), F.lit(" of "), "ticker"))
    group = F.when(F.col("ticker").isin(*CASH_LIKE), None).when(F.col("block_name") == "equity", F.coalesce(split, unknown.cast("string"))).otherwise(F.col("block_name"))
    grouped = tickers.select("ticker", group.alias("group"))
    rank = F.when(F.col("group").isNull(), -1).otherwise(F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(F.col("group").asc_nulls_last())) - 1)  # a row for each ticker
    return grouped.withColumn("group_idx", rank.cast("int"))


def shuffles(scores: DataFrame, draws: int | list[int]) -> DataFrame:
    """draw, session_idx, ticker, score: the present scores of each session dealt out anew among the tickers that have one, for every draw."""
    wanted = list(range(draws)) if isinstance(draws, int) else draws
    each = scores.select("session_idx", "ticker", "score", F.explode(F.array(*[F.lit(d) for d in wanted])).alias("draw"))
    by = Window.partitionBy("draw", "session_idx", F.col("score").isNull())
    at = F.row_number().over(by.orderBy("ticker"))
    to = F.row_number().over(by.orderBy(F.xxhash64(F.lit(RANDOM_SEED), "draw", "session_idx", "ticker")))
    placed = each.select("*", at.alias("_at"), to.alias("_to"))
    given = placed.filter("score is not null").select("draw", "session_idx", F.col("_to").alias("_at"), F.col("score").alias("_given"))
    joined = placed.join(given, ["draw", "session_idx", "_at"], "left")
    return joined.select("draw", "session_idx", "ticker", F.when(F.col("score").isNotNull(), F.col("_given")).alias("score"))


def shuffled(scores: DataFrame, draw: int) -> DataFrame:
    """One draw of shuffles: (session_idx, ticker, score)."""
    return shuffles(scores, [draw]).drop("draw")


def stale(scores: DataFrame, lag: int = STALE_LAG) -> DataFrame:
    """The scores of ``lag`` sessions before; scores are dense."""
    return scores.withColumn("score", F.lag("score", lag).over(Window.partitionBy("ticker").orderBy("session_idx")))


def random_stress(stress: DataFrame, draw: int, block: int = STRESS_BLOCK) -> DataFrame:
    """A random mask with the same expected share of stress, constant over blocks: (session_idx, stress)."""
    share = stress.agg(F.avg(F.col("stress").cast("double")).alias("_share"))
    # 53 bits of the hash as a number from 0 to 1
    u = F.shiftrightunsigned(F.xxhash64(F.lit(RANDOM_SEED), F.lit(draw), F.expr(f"session_idx div {block}")), 11) / float(1 << 53)
    return stress.crossJoin(F.broadcast(share)).select("session_idx", (u < F.col("_share")).cast("double").alias("stress"))
