"""Group, environment and book operators: panels by asset group, one basket, stress switches."""

from __future__ import annotations

import math

from loomspan.plans import algebra as A
from loomspan.plans.algebra import Expr

CASH_LIKE = ("SHY", "SGOV")


def across_groups(x: Expr, rank) -> Expr:
    """A rank of groups, each counted once however many tickers it has; x and the result are the same for all of a group's."""
    return A.where(A.present(x), A.group_sum(rank(A.where(A.first_of_group(), x), A.present(x))))


def group_label(group_ret: Expr, alive: Expr, h: int, rank, floor: float = 0.003, least_window: int = 5) -> Expr:
    """Rank across groups of what a group earns from the next open on, over its volatility.

    group_ret at a session is the return from the next open to the one after, so nothing of the label is known yet.
    """
    m = max(h, least_window)
    grown = A.ahead("mean", Expr("log", 1 + A.first_of(group_ret, 0.0)), 0, h - 1) * h
    earned = (A.exp(grown) - 1) / (A.hi2(A.ahead("std", group_ret, 0, m - 1), floor) * math.sqrt(h))
    whole = A.present(A.lead(A.col("session_idx"), m + 1))
    return across_groups(A.where(alive & whole, earned), rank)


def eligible(*excluded: str) -> Expr:
    """Tradable and not on the list of excluded tickers (cash and its like)."""
    ok = A.TRADABLE
    for name in excluded:
        ok = ok & Expr("NOT", A.is_ticker(name))
    return ok


def basket(ok: Expr, next_open: Expr) -> Expr:
    """Equal-weight next-open return of the eligible tickers; 0 in a session without any."""
    return A.first_of(A.cross_mean(next_open, ok), 0.0)


YEAR = 252


def _levels(basket: Expr) -> tuple[Expr, Expr]:
    """Worth of one unit after a session's return, and before it."""
    after = A.exp(A.running(Expr("log", 1 + basket)))
    return after, after / (1 + basket)


def environment_targets(basket: Expr, h: int, least_window: int = 10) -> dict[str, Expr]:
    """Return and worst fall of the basket over the next h returns, and its yearly volatility over max(h, least_window)."""
    m = max(h, least_window)
    after, before = _levels(basket)
    whole = A.present(A.lead(A.col("session_idx"), m + 1))
    return {
        f"env_ret_h{h}": A.where(whole, A.lead(after, h - 1) / before - 1),
        f"env_dd_h{h}": A.where(whole, A.worst_fall(before, 0, h)),
        f"env_vol_h{h}": A.where(whole, A.ahead("std", basket, 0, m - 1) * math.sqrt(YEAR)),
    }


def persistence(basket: Expr, h: int, least_window: int = 10) -> dict[str, Expr]:
    """The same measures over the latest returns that are known, those of two sessions before: what a forecast has to beat."""
    m = max(h, least_window)
    after, before = _levels(basket)
    whole = A.col("session_idx") >= m + 2
    return {
        f"past_ret_h{h}": A.where(whole, A.lag(after, 2) / A.lag(before, h + 1) - 1),
        f"past_dd_h{h}": A.where(whole, A.lag(A.worst_fall(before, 0, h), h + 1)),
        f"past_vol_h{h}": A.where(whole, A.lag(A.std(basket, m, m), 2) * math.sqrt(YEAR)),
    }


def stress(forecasts: list[Expr], window: int = 252, least: int = 126, level: float = 0.8) -> Expr:
    """1 where the mean rank of the forecasts against their own past reaches the level; unknown counts as calm."""
    ranks = [A.rank_past(f, window, least) for f in forecasts]
    known = sum((A.flag(A.present(r)) for r in ranks[1:]), A.flag(A.present(ranks[0])))
    total = sum((A.first_of(r, 0.0) for r in ranks[1:]), A.first_of(ranks[0], 0.0))
    return A.flag(A.sdiv(total, known) >= level)


def powered_score(pct: Expr, power: int) -> Expr:
    """Signed power of the distance from the middle."""
    centred = (pct - 0.5) * 2
    return A.sign(centred) * A.mag(centred) ** power


def register(query, source, algebra, r, rounded) -> None:
    """The queries of this module."""
    from loomspan.functions import catalogue
    from loomspan.operators import panel_ops as P

    scope = catalogue._names()
    ret, k21 = scope["ret"], scope["change"](21)
    next_open = P.next_open_return()
    ok = eligible(source.ROLES["SHY"])
    daily = basket(ok, next_open)

    def put(name: str, outputs: dict[str, Expr]) -> None:
        query(name, A.to_sql(source.BRAND_SQL, outputs, digits=4))(lambda spark, d: A.evaluate(source.brand_panel(spark, d), outputs, digits=4))

    put("group_returns", {"group_ret": A.group_mean(ret), "alive": A.flag(A.group_sum(A.flag(A.TRADABLE)) > 0)})
    put("group_features", {n: A.group_mean(e) for n, e in catalogue.family(catalogue.GAPS, source.ROLES).items()})
    alive = A.group_sum(A.flag(A.TRADABLE)) > 0
    put("group_label", {f"label_h{h}": group_label(A.group_mean(next_open), alive, h, P.average_pct) for h in (5, 21)})
    put("group_scores", {"score": across_groups(A.group_mean(k21), P.average_pct)})
    put("basket", {"basket": daily, "eligible": A.flag(ok)})
    put("env_targets", {n: e for h in (3, 5, 10, 21) for n, e in environment_targets(daily, h).items()})
    put("env_persistence", {n: e for h in (3, 5, 10, 21) for n, e in persistence(daily, h).items()})
    known = A.lag(daily, 2)
    put("stress_mask", {"stress": stress([A.std(known, 21), -A.mean(known, 21)])})
    calm = 1 - stress([A.std(known, 21), -A.mean(known, 21)])
    weight = P.top_bins(P.to_bins(P.ordinal_pct(k21)), 2)
    put("book_switch", {"weight": weight * (calm * 0.5 + 0.5), "powered": powered_score(P.average_pct(k21), 3)})
