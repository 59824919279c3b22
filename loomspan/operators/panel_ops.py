"""Labels, bins, portfolio rules and returns as panel expressions."""

from __future__ import annotations

import math

from loomspan.plans import algebra as A
from loomspan.plans.algebra import Expr

HORIZONS = (1, 3, 5, 7, 10, 15, 21, 32, 44)
MIN_VOL_WINDOW = 5
VOL_FLOOR = 0.003
N_BINS = 10


def reach(h: int, min_vol_window: int = MIN_VOL_WINDOW) -> int:
    """A label of horizon h at session t reads opens up to t + reach."""
    return 1 + max(h, min_vol_window)


def labels(h: int, payoff: float | None = 1.0, min_vol_window: int = MIN_VOL_WINDOW) -> dict[str, Expr]:
    """What a ticker earns after a decision at the close, filled at the next open and held for h sessions."""
    open_ = A.col("open")
    m = max(h, min_vol_window)
    earned = A.lead(open_, 1 + h) / A.lead(open_, 1) - 1
    daily = open_ / A.lag(open_, 1) - 1
    vol = A.where(A.ahead("count", daily, 2, 1 + m) >= m, A.ahead("std", daily, 2, 1 + m))
    scale = A.hi2(vol, VOL_FLOOR) * math.sqrt(h)
    valid = A.TRADABLE & A.present(earned) & A.present(vol)
    scaled = A.where(valid, earned / scale)
    everyone = A.present(A.col("session_idx"))
    ranked = A.rank(scaled, everyone)
    fall = A.worst_fall(open_, 1, 1 + h)
    out = {
        "vol_scaled": scaled,
        "rank": ranked,
        "excess_vol_scaled": A.where(valid, (earned - A.cross_mean(earned, valid)) / scale),
        "bin20": A.where(A.present(ranked), (A.lo2(A.floor(ranked * 20), 19.0) + 1) / 20),
        "drawdown_rank": A.rank(A.where(valid, fall / scale), everyone),
    }
    if payoff is not None:
        out["payoff"] = A.rank(A.where(valid & A.present(fall), (earned - A.mag(fall) * payoff) / scale), everyone)
    return {f"{n}_h{h}": e for n, e in out.items()}


def next_open_return() -> Expr:
    """From the open after the decision to the open after that."""
    return A.lead(A.col("open"), 2) / A.lead(A.col("open"), 1) - 1


def to_bins(pct: Expr, n: int = N_BINS) -> Expr:
    return A.clip(A.floor(pct * n) + 1, 1.0, float(n))


def ordinal_pct(x: Expr, eligible: Expr = A.TRADABLE) -> Expr:
    """Position among the session's present values, from 0 to 1; ties in ticker order, missing for fewer than two."""
    y = A.where(eligible, x)
    n = A.cross_count(y)
    return A.where(A.present(y) & (n > 1.0), (A.position(y) - 1) / (n - 1))


def average_pct(x: Expr, eligible: Expr = A.TRADABLE) -> Expr:
    """Average rank from 0 to 1; 0 for one value alone."""
    y = A.where(eligible, x)
    n = A.cross_count(y)
    return A.where(A.present(y), (Expr("crank", y) - 1) / A.hi2(n - 1, 1.0))


def time_bins(x: Expr, window: int = 63, n: int = N_BINS) -> Expr:
    return to_bins(A.rank_past(x, window, window), n)


def equal_weight(select: Expr) -> Expr:
    chosen = A.flag(select)
    return A.where(select, 1.0 / A.hi2(A.cross_sum(chosen), 1.0), 0.0)


def top_fraction(score: Expr, fraction: float, ok: Expr = A.TRADABLE) -> Expr:
    """1 for the best ceil(fraction * n) of the session, one at least; ties in ticker order."""
    y = A.where(ok, -score)
    k = A.hi2(A.ceil(A.cross_count(y) * fraction), 1.0)
    return A.flag(A.present(y) & (A.position(y) <= k))


def tradable_only(w: Expr) -> Expr:
    return A.where(A.TRADABLE, w, 0.0)


def top_bins(cs_bin: Expr, k: int, n: int = N_BINS) -> Expr:
    return tradable_only(equal_weight(cs_bin >= n - k + 1))


def long_short(cs_bin: Expr, k: int, n: int = N_BINS) -> Expr:
    return tradable_only(equal_weight(cs_bin >= n - k + 1) - equal_weight(cs_bin <= k))


def score_capped(pct: Expr, max_weight: float = 0.15, max_group: float = 0.40) -> Expr:
    """Weights by rank above the middle, capped per ticker, then per group; both caps only lower, so once is enough."""
    raw = A.first_of(A.pos(pct - 0.5), 0.0)
    w = A.lo2(raw / A.hi2(A.cross_sum(raw), A.EPS), max_weight)
    held = A.group_sum(w)
    return tradable_only(A.where(held > max_group, A.sdiv(w * max_group, held), w))


def ts_gate(ts_bin: Expr, cs_bin: Expr, ts_min: int, cs_min: int, slots: float = 0.1) -> Expr:
    passes = (ts_bin >= ts_min) & A.TRADABLE
    if cs_min:
        passes = passes & (cs_bin >= cs_min)
    k = A.hi2(A.ceil(A.cross_sum(A.flag(A.TRADABLE)) * slots), 1.0)
    return A.where(passes, 1.0 / A.hi2(k, A.cross_sum(A.flag(passes))), 0.0)


#: The variants of the rules: label -> weights from (pct, cross-sectional bin, time bin).
def rules() -> dict[str, object]:
    out = {f"top_bins_equal_top_bins{k}": (lambda pct, cs, ts, k=k: top_bins(cs, k)) for k in (1, 2, 3)}
    out["score_capped_max_weight0.15_max_block0.4"] = lambda pct, cs, ts: score_capped(pct)
    out |= {f"ts_gate_cash_ts_min{a}_cs_min{b}": (lambda pct, cs, ts, a=a, b=b: ts_gate(ts, cs, a, b)) for a in (7, 8, 9) for b in (0, 6)}
    out["long_short_top_bins1"] = lambda pct, cs, ts: long_short(cs, 1)
    return out
