"""The trial grid: every prediction series x portfolio rule x rebalance interval x offset x no-trade band, simulated and measured.

A prediction series (model, window, label variant, horizon) is a group of sessions x tickers; all its trials run in one
task over that one matrix, so the grid costs one shuffle of the predictions and never writes out trials x sessions x
tickers.  Series are independent and of one size whatever their number.  A trial leaves as one row: its keys, its
measures, its net returns and its moments by slice, which are all that the multiple-testing statistics need.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import evaluation as E
from loomspan.operators import panel_ops as P
from loomspan.operators.simulation import _LEAST_VALUE

# fixed values of the grid
REBALANCE_EVERY = (1, 5, 10, 21, "horizon")
OFFSETS = (0,)
BANDS = (0.0, 0.02)
COST_BPS = 5
STRESS_BPS = (10, 20)
WARMUP = 63
SLICES = 16

KEYS = ("model", "window", "variant", "h")
CHOICE = (*KEYS, "rule", "rebalance_every", "no_trade_band")
MEASURES = (
    "n", "sharpe", "cagr", "vol", "max_drawdown", "turnover_year", "hit_rate", "median_block_sharpe", "min_block_sharpe", "skew", "kurt",
    *(f"{m}_cost{b}" for b in STRESS_BPS for m in ("sharpe", "cagr")), "info_ratio_vs_ew", "excess_cagr_vs_ew", "avg_gross_exposure",
)


def rebalance_choices(h: int, every=REBALANCE_EVERY) -> list[int]:
    """The distinct intervals of a target of horizon h, in the order given."""
    return list(dict.fromkeys(h if n == "horizon" else int(n) for n in every))


# -- weights of the rules, (sessions, tickers) ----------------------------------------------------------------------
def ordinal(pred: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Position among the session's present values, 0 to 1; ties in ticker order, missing for fewer than two."""
    known = ok & np.isfinite(pred)
    place = np.argsort(np.argsort(np.where(known, pred, np.inf), axis=1, kind="stable"), axis=1)
    n = known.sum(axis=1, keepdims=True)
    return np.where(known & (n > 1), place / np.maximum(n - 1, 1), np.nan)


def mid_rank(x: np.ndarray) -> np.ndarray:
    """Mean rank from 1 among the present values of each row."""
    below = (x[:, None, :] < x[:, :, None]).sum(axis=2)
    equal = (x[:, None, :] == x[:, :, None]).sum(axis=2)
    return np.where(np.isnan(x), np.nan, below + (equal + 1) / 2)


def past_share(x: np.ndarray, window: int = WARMUP) -> np.ndarray:
    """Mid-rank share of each value among the window sessions before, all of which must be present."""
    out = np.full(x.shape, np.nan)
    if len(x) > window:
        frames = np.lib.stride_tricks.sliding_window_view(x, window, axis=0)[:-1]
        now = x[window:, :, None]
        share = ((frames < now).sum(axis=2) + 0.5 * (frames == now).sum(axis=2)) / window
        out[window:] = np.where(np.isnan(frames).any(axis=2) | np.isnan(now[:, :, 0]), np.nan, share)
    return out


def bins(share: np.ndarray, n: int = P.N_BINS) -> np.ndarray:
    return np.clip(np.floor(share * n) + 1, 1, n)


def even(chosen: np.ndarray) -> np.ndarray:
    return chosen / np.maximum(chosen.sum(axis=1, keepdims=True), 1)


def capped(score: np.ndarray, groups: np.ndarray, max_weight: float = 0.15, max_group: float = 0.40) -> np.ndarray:
    """Weights by score above the middle, capped per ticker, then per group; both caps only lower, so once is enough."""
    raw = np.maximum(np.nan_to_num(score - 0.5), 0)
    w = np.minimum(raw / np.maximum(raw.sum(axis=1, keepdims=True), 1e-12), max_weight)
    for g in np.unique(groups):
        held = w[:, groups == g].sum(axis=1, keepdims=True)
        w[:, groups == g] *= np.where(held > max_group, max_group / np.where(held > 0, held, 1), 1)
    return w


def rule_weights(pred: np.ndarray, tradable: np.ndarray, groups: np.ndarray) -> dict[str, tuple[np.ndarray, bool]]:
    """label: (weights, whether what is not invested is cash) of all variants of the rules."""
    pct = ordinal(pred, tradable)
    cs, ts = bins(pct), bins(past_share(np.where(np.isfinite(pred), np.round(pred, 10), np.nan)))
    slots = np.maximum(np.ceil(tradable.sum(axis=1, keepdims=True) * 0.1), 1)
    out = {f"top_bins_equal_top_bins{k}": (even(cs >= P.N_BINS - k + 1), True) for k in (1, 2, 3)}
    out["score_capped_max_weight0.15_max_block0.4"] = (capped(pct, groups), True)
    for a in (7, 8, 9):
        for b in (0, 6):
            passes = (ts >= a) & tradable & (cs >= b if b else True)
            out[f"ts_gate_cash_ts_min{a}_cs_min{b}"] = (passes / np.maximum(slots, passes.sum(axis=1, keepdims=True)), True)
    out["long_short_top_bins1"] = (even(cs >= P.N_BINS) - even(cs <= 1), False)
    return {label: (np.where(tradable, w, 0.0), cash) for label, (w, cash) in out.items()}


def rule_family(label: str) -> str:
    return next(f for f in ("top_bins_equal", "score_capped", "ts_gate_cash", "long_short") if label.startswith(f))


# -- simulation of all trials of a rule at once ---------------------------------------------------------------------
def fold_trials(target: np.ndarray, rebalance: np.ndarray, band: np.ndarray, r: np.ndarray, cash_rate: np.ndarray, use_cash: bool, largest: float = 1.0):
    """(gross, turnover), trials x sessions: simulation.fold_banded for many clocks (trials, sessions) and bands at once."""
    target, r, cash_rate = np.nan_to_num(target), np.nan_to_num(r), np.nan_to_num(cash_rate)
    k, n = rebalance.shape
    gross, turnover = np.zeros((k, n)), np.zeros((k, n))
    w, cash, live = np.zeros((k, target.shape[1])), np.full(k, 1.0 if use_cash else 0.0), np.zeros(k, dtype=bool)
    for t in range(n):
        at = np.flatnonzero(rebalance[:, t])
        if len(at):
            old, goal = w[at], target[t][None, :]
            new = np.where((np.abs(goal - old) >= band[at, None]) | (goal == 0) | (old == 0), goal, old)
            turnover[at, t] = np.abs(new - old).sum(axis=1)
            if use_cash:
                size = new.sum(axis=1)
                shrink = np.where(size > largest, largest / np.where(size > 0, size, 1), 1.0)
                turnover[at, t] += np.abs(new * (1 - shrink[:, None])).sum(axis=1)
                new = new * shrink[:, None]
                cash[at] = 1.0 - new.sum(axis=1)
            w[at], live[at] = new, True
        earned = np.where(live, w @ r[t] + cash * cash_rate[t], 0.0)
        gross[:, t] = earned
        worth = 1 + earned
        worth = np.where(worth > _LEAST_VALUE, worth, np.inf)
        kept = live & np.isfinite(worth)
        w[kept] = w[kept] * (1 + r[t]) / worth[kept, None]
        cash[kept] = cash[kept] * (1 + cash_rate[t]) / worth[kept]
    return gross, turnover


# -- measures of return rows (trials, sessions) -----------------------------------------------------------------------
def sharpe(x: np.ndarray) -> np.ndarray:
    """Yearly Sharpe of each row; missing for a row that does not move."""
    if x.shape[1] < 2:
        return np.full(len(x), np.nan)
    sd = x.std(axis=1, ddof=1)
    return np.where(sd > 1e-12, x.mean(axis=1) / np.where(sd > 1e-12, sd, 1) * math.sqrt(E.YEAR), np.nan)


def cagr(x: np.ndarray) -> np.ndarray:
    alive = (x > -1).all(axis=1)
    return np.where(alive, np.exp(np.log1p(np.where(alive[:, None], x, 0)).sum(axis=1) * E.YEAR / max(x.shape[1], 1)) - 1, -1.0)


def measures(net: np.ndarray, turnover: np.ndarray, blocks: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The measures of evaluation.summary, max_drawdown and dated blocks, for every row; blocks are masks of sessions."""
    n = net.shape[1]
    worth = np.cumprod(1 + net, axis=1)
    peak = np.maximum.accumulate(worth, axis=1)
    fall = np.divide(worth, peak, out=np.full(worth.shape, np.nan), where=peak != 0) - 1
    off = net - net.mean(axis=1, keepdims=True)
    m2 = (off**2).mean(axis=1)
    moves = np.where(m2 > 0, m2, np.nan)
    by_block = np.stack([sharpe(net[:, b]) for b in blocks], axis=1) if blocks else np.full((len(net), 1), np.nan)
    some = np.isfinite(by_block).any(axis=1)
    padded = np.where(some[:, None], by_block, 0.0)
    return {
        "n": np.full(len(net), n), "sharpe": sharpe(net), "cagr": cagr(net), "vol": net.std(axis=1, ddof=1) * math.sqrt(E.YEAR) if n > 1 else np.full(len(net), np.nan),
        "max_drawdown": np.nanmin(fall, axis=1, initial=0.0), "turnover_year": turnover.sum(axis=1) * E.YEAR / max(n, 1),
        "hit_rate": (net > 0).sum(axis=1) / np.where((net != 0).any(axis=1), (net != 0).sum(axis=1), np.nan),
        "median_block_sharpe": np.where(some, np.nanmedian(padded, axis=1), np.nan), "min_block_sharpe": np.where(some, np.nanmin(padded, axis=1), np.nan),
        "skew": (off**3).mean(axis=1) / moves**1.5, "kurt": (off**4).mean(axis=1) / moves**2,
    }


def slice_sums(net: np.ndarray, slices: int = SLICES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s1, s2, n): sums and squares of each row by equal runs of sessions, cut as evaluation.slice_moments does."""
    part = (slices * (np.arange(net.shape[1]) + 1) - 1) // max(net.shape[1], 1)
    inside = (part[:, None] == np.arange(slices)[None, :]).astype(float)
    return net @ inside, net**2 @ inside, inside.sum(axis=0).astype(int)


def information(pred: np.ndarray, label: np.ndarray, h: int, least: int = 5, sessions: int = 20) -> tuple[float, float, int]:
    """(mean, t, sessions) of the daily rank correlations of predictions and labels; t counts sessions / h."""
    both = np.isfinite(pred) & np.isfinite(label)
    both &= both.sum(axis=1, keepdims=True) >= least
    a, b = (mid_rank(np.where(both, x, np.nan))[both.any(axis=1)] for x in (pred, label))
    if not len(a):
        return math.nan, math.nan, 0
    a, b = (np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True)) for x in (a, b))
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    ic = ((a * b).sum(axis=1)[size > 1e-12]) / size[size > 1e-12]
    if len(ic) < sessions:
        return math.nan, math.nan, len(ic)
    sd = ic.std(ddof=1)
    return float(ic.mean()), float(ic.mean() / sd * math.sqrt(len(ic) / max(h, 1))) if sd > 1e-12 else math.nan, len(ic)


_SCHEMA = (
    "model string, window string, variant string, h int, rule string, rule_family string, rebalance_every int, rebalance_offset int, no_trade_band double, "
    "prediction_share double, ic_mean double, ic_t double, ic_sessions long, "
    + ", ".join(f"{m} {'long' if m == 'n' else 'double'}" for m in MEASURES)
    + ", s1 array<double>, s2 array<double>, slice_n array<int>, net array<float>"
)


def run_grid(series: DataFrame, panel: DataFrame, first: int, stop: int | None = None, blocks: tuple[tuple[str, str], ...] = (), run_id: str = "run") -> DataFrame:
    """One row for each trial: trial_id, the choices, the measures over sessions [first, stop), s1, s2, slice_n, net.

    series: model, window, variant, h, session_idx, ticker, pred, label.  panel: session_idx, date, ticker, asset_group,
    tradable, r_next, cash_next, ew_net, dense and one row a session and ticker.  A series without a prediction in the
    evaluation has no trials.  blocks: dates (first, last), both included.
    """
    shared = panel.select("session_idx", "date", "ticker", F.col("asset_group").cast("string").alias("asset_group"), "tradable", "r_next", "cash_next", "ew_net")
    rows = shared.crossJoin(F.broadcast(series.select(*KEYS).distinct()))  # a row for each series of the grid
    rows = rows.join(series.select(*KEYS, "session_idx", "ticker", "pred", "label"), [*KEYS, "session_idx", "ticker"], "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["session_idx", "ticker"])
        shape = (pdf["session_idx"].nunique(), pdf["ticker"].nunique())
        grid = {c: pdf[c].to_numpy(dtype=float).reshape(shape) for c in ("pred", "label", "r_next")}
        tradable = pdf["tradable"].to_numpy(dtype=bool).reshape(shape)
        at = pdf["session_idx"].to_numpy().reshape(shape)[:, 0]
        cash, ew = (np.nan_to_num(pdf[c].to_numpy(dtype=float)).reshape(shape)[:, 0] for c in ("cash_next", "ew_net"))
        dates = pdf["date"].astype(str).str.slice(0, 10).to_numpy().reshape(shape)[:, 0]
        groups = pdf["asset_group"].to_numpy().astype(str)[: shape[1]]
        inside = (at >= first) & (at < (at[-1] + 1 if stop is None else stop))
        asked = np.isfinite(grid["pred"][inside])
        if not asked.any():
            return pd.DataFrame(columns=_columns())
        model, window, variant, h = (pdf[c].iloc[0] for c in KEYS)
        ic = information(grid["pred"][inside], grid["label"][inside], int(h))
        masks = [(dates[inside] >= a) & (dates[inside] <= b) for a, b in blocks]
        choices = [(e, o, b) for e in rebalance_choices(int(h)) for o in OFFSETS for b in BANDS]
        clocks = np.stack([(at >= first + o) & ((at - first - o) % max(1, e) == 0) for e, o, _ in choices])
        bands = np.array([b for _, _, b in choices])
        ew_row = ew[inside][None, :]
        out = []
        for label, (w, use_cash) in rule_weights(grid["pred"], tradable, groups).items():
            gross, turnover = fold_trials(w, clocks, bands, grid["r_next"], cash, use_cash)
            gross, turnover = gross[:, inside], turnover[:, inside]
            net = gross - turnover * COST_BPS / 1e4
            found = measures(net, turnover, masks)
            for bps in STRESS_BPS:
                worse = gross - turnover * bps / 1e4
                found |= {f"sharpe_cost{bps}": sharpe(worse), f"cagr_cost{bps}": cagr(worse)}
            size = np.abs(w[inside]).sum(axis=1)
            found |= {
                "info_ratio_vs_ew": sharpe(net - ew_row), "excess_cagr_vs_ew": found["cagr"] - cagr(ew_row)[0],
                "avg_gross_exposure": np.array([size[c[inside]].mean() if c[inside].any() else np.nan for c in clocks]),
            }
            s1, s2, n = slice_sums(net)
            e, o, b = zip(*choices, strict=True)
            head = {"model": model, "window": window, "variant": variant, "h": h, "rule": label, "rule_family": rule_family(label), "rebalance_every": e, "rebalance_offset": o, "no_trade_band": b}
            quality = {"prediction_share": asked.any(axis=1).mean(), "ic_mean": ic[0], "ic_t": ic[1], "ic_sessions": ic[2]}
            arrays = {"s1": list(s1), "s2": list(s2), "slice_n": [n] * len(net), "net": list(net.astype(np.float32))}
            out.append(pd.DataFrame(head | quality | {m: found[m] for m in MEASURES} | arrays))
        return pd.concat(out, ignore_index=True)

    trials = rows.groupBy(*KEYS).applyInPandas(one, _SCHEMA)
    doubles = {c: F.nanvl(c, F.lit(None).cast("double")) for c, t in trials.dtypes if t == "double"}
    # a name made from the choices, so that it does not depend on the order of tasks
    name = F.concat(F.lit(f"{run_id}:"), F.substring(F.sha2(F.concat_ws("|", *CHOICE, "rebalance_offset"), 256), 1, 12))
    return trials.withColumns(doubles).select(name.alias("trial_id"), "*")


def _columns() -> list[str]:
    return [c.split()[0] for c in _SCHEMA.split(", ")]


# -- what is read off a grid --------------------------------------------------------------------------------------------
def moments(trials: DataFrame) -> DataFrame:
    """trial, slice, s1, s2, n, as evaluation.overfitting takes them."""
    zipped = F.posexplode(F.arrays_zip("s1", "s2", "slice_n")).alias("slice", "_m")
    return trials.select(F.col("trial_id").alias("trial"), zipped).select("trial", "slice", "_m.s1", "_m.s2", F.col("_m.slice_n").cast("long").alias("n"))


def deflate(trials: DataFrame, ledger: DataFrame | None = None, run_id: str = "run") -> DataFrame:
    """The trials with dsr, dsr_trials (of this run) and dsr_all_runs, dsr_all_runs_trials (with all earlier runs of the ledger)."""
    own = trials.filter(F.col("sharpe").isNotNull()).count()
    earlier = 0 if ledger is None else ledger.filter(F.col("run_id") != run_id).count()
    out = E.add_deflated_sharpe(trials, max(own, 1)).withColumn("dsr_trials", F.lit(own))
    every = E.add_deflated_sharpe(out.withColumnRenamed("dsr", "_dsr"), max(own + earlier, 1)).withColumnRenamed("dsr", "dsr_all_runs")
    return every.withColumnRenamed("_dsr", "dsr").withColumn("dsr_all_runs_trials", F.lit(own + earlier))


def prediction_series(trials: DataFrame) -> DataFrame:
    """One row for each prediction series with its information coefficients."""
    return trials.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in ("prediction_share", "ic_mean", "ic_t", "ic_sessions")])


def pivot_ic(series: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Mean information coefficient, a row for each value of one choice and a column for each of another."""
    return series.groupBy(rows).pivot(columns, values).agg(F.avg("ic_mean"))


def top(trials: DataFrame, by: str = "median_block_sharpe", n: int = 25) -> DataFrame:
    """The n trials with the highest measure; ties by name."""
    return trials.orderBy(F.desc_nulls_last(by), "trial_id").limit(n)


def confirm(trials: DataFrame, chosen: DataFrame) -> DataFrame:
    """Trials of a second run at the choices of a first one, under the first one's trial_id."""
    return trials.drop("trial_id").join(chosen.select(*CHOICE, "trial_id"), list(CHOICE))


def better_than(trials: DataFrame, level: Column | float) -> DataFrame:
    """median_sharpe and the share of trials whose Sharpe is above a level."""
    return trials.agg(F.median("sharpe").alias("median_sharpe"), F.avg((F.col("sharpe") > level).cast("double")).alias("share_above"))
