"""Portfolio simulators: folds over sessions whose state is the drifted book.

A trial is one group; its targets are laid out as sessions x tickers and the fold runs once over the sessions with
NumPy over the tickers.  Trials are independent, so they spread over the cluster; a trial's size is its sessions
times its tickers, whatever the number of trials.

Weights decided at a session fill at the next open and earn the return after it.  Missing targets, returns and cash
rates count as zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEAST_VALUE = 1e-9


def _drift(w: np.ndarray, cash: float, r: np.ndarray, rate: float) -> tuple[np.ndarray, float, float]:
    earned = float(w @ r) + cash * rate
    w, cash = w * (1 + r), cash * (1 + rate)
    worth = 1 + earned
    return (w / worth, cash / worth, earned) if worth > _LEAST_VALUE else (w, cash, earned)


def fold_banded(target: np.ndarray, rebalance: np.ndarray, r: np.ndarray, cash_rate: np.ndarray, band: float, use_cash: bool, largest: float = 1.0):
    """(gross, turnover): inside the no-trade band a held position stays; a book above ``largest`` is scaled down."""
    target, r, cash_rate = np.nan_to_num(target), np.nan_to_num(r), np.nan_to_num(cash_rate)
    gross, turnover = np.zeros(len(target)), np.zeros(len(target))
    w, cash, live = np.zeros(target.shape[1]), 1.0 if use_cash else 0.0, False
    for t in range(len(target)):
        if rebalance[t]:
            goal = target[t]
            trade = (np.abs(goal - w) >= band) | (goal == 0) | (w == 0)
            after = np.where(trade, goal, w)
            turnover[t] = np.abs(after - w).sum()
            size = after.sum()
            if use_cash and size > largest:
                scaled = after / size * largest
                turnover[t] += np.abs(after - scaled).sum()
                after, size = scaled, largest
            w, live = after, True
            cash = 1.0 - size if use_cash else cash
        if live:
            w, cash, gross[t] = _drift(w, cash, r[t], cash_rate[t])
    return gross, turnover


def fold_levered(target: np.ndarray, rebalance: np.ndarray, r: np.ndarray, cash_rate: np.ndarray, spread: float):
    """(gross, turnover): weights may sum above 1; cash below 0 is a loan that pays the spread on top."""
    target, r, cash_rate = np.nan_to_num(target), np.nan_to_num(r), np.nan_to_num(cash_rate)
    gross, turnover = np.zeros(len(target)), np.zeros(len(target))
    w, cash, live = np.zeros(target.shape[1]), 1.0, False
    for t in range(len(target)):
        if rebalance[t]:
            turnover[t] = np.abs(target[t] - w).sum()
            w, cash, live = target[t].copy(), 1.0 - target[t].sum(), True
        if live:
            w, cash, gross[t] = _drift(w, cash, r[t], cash_rate[t] + (spread if cash < 0 else 0.0))
    return gross, turnover


def simulate(targets: DataFrame, band: float = 0.0, use_cash: bool = True, levered: bool = False, spread: float = 0.0, cost: float = 0.0) -> DataFrame:
    """trial, session_idx, gross, turnover, net from (trial, session_idx, ticker, target, r_next, rebalance, cash_next)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["session_idx", "ticker"])
        goal = rows.pivot(index="session_idx", columns="ticker", values="target")
        r = rows.pivot(index="session_idx", columns="ticker", values="r_next").to_numpy(dtype=float)
        by = rows.groupby("session_idx")
        mask, cash = by["rebalance"].first().to_numpy(dtype=bool), by["cash_next"].first().to_numpy(dtype=float)
        if levered:
            gross, turnover = fold_levered(goal.to_numpy(dtype=float), mask, r, cash, spread)
        else:
            gross, turnover = fold_banded(goal.to_numpy(dtype=float), mask, r, cash, band, use_cash)
        return pd.DataFrame({"trial": rows["trial"].iloc[0], "session_idx": goal.index, "gross": gross, "turnover": turnover, "net": gross - cost * turnover})

    return targets.groupBy("trial").applyInPandas(one, "trial string, session_idx int, gross double, turnover double, net double")


def rebalance_every(first: int, every: int):
    return (F.col("session_idx") >= first) & ((F.col("session_idx") - first) % max(1, every) == 0)
