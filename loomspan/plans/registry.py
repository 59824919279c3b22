"""Registered queries of the panel engine and their SQL.

Most queries are panel expressions over the brand panel; their SQL is the same plan, emitted for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.functions import catalogue
from loomspan.operators import panel_ops as P
from loomspan.plans import algebra as A
from loomspan.plans import stage_queries
from loomspan.sources import brand_panel as B

DIGITS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _panel_query(name: str, outputs: dict[str, A.Expr], digits: int = DIGITS) -> None:
    QUERIES[name] = lambda spark, sf_dir: A.evaluate(B.brand_panel(spark, sf_dir), outputs, digits=digits)
    SQL[name] = A.to_sql(B.BRAND_SQL, outputs, digits=digits)


def query(name: str, sql: str | None = None):
    """Register a function as a query, with its SQL where there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _register() -> None:
    scope = catalogue._names()
    ret, close, volume, high, low = scope["ret"], A.col("close"), A.col("volume"), A.col("high"), A.col("low")
    mkt = A.of_ticker(ret, B.ROLES["SPY"])
    k21 = scope["change"](21)

    operators = {
        "ts_mean": A.mean(ret, 21), "ts_sum": A.total(ret, 21), "ts_std": A.std(ret, 21), "ts_min": A.low_of(close, 21), "ts_max": A.high_of(close, 21),
        "ts_skew": A.skew(ret, 63), "ts_kurt": A.kurt(ret, 63), "ts_quantile": A.quantile(ret, 63, 0.05), "ts_zscore": A.zscore(close, 21),
        "ts_cov": A.cov(ret, mkt, 63) * 100, "ts_beta": A.beta(ret, mkt, 63), "ts_corr": A.corr(ret, mkt, 63), "ts_slope": A.slope(close, 21),
        "ts_rank_past": A.rank_past(close, 63, 40), "days_since_max": A.since_high(close, 63), "days_since_min": A.since_low(close, 63),
        "run_length": A.run(ret > 0), "ffill_limit": A.fill(close, 5), "true_range": scope["tr"], "obv": scope["obv"], "lag_lead": A.lag(close, 3) - A.lead(close, 2),
        "safe_div": A.sdiv(close - low, high - low), "clip": A.clip(ret, -0.1, 0.1),
        "cs_rank": A.rank(k21), "cs_zscore": A.sdiv(k21 - A.cross_mean(k21), A.sqrt(A.sdiv(A.cross_sum(A.where(A.TRADABLE, (k21 - A.cross_mean(k21)) ** 2)), A.cross_count(A.where(A.TRADABLE, k21)) - 1))),
        "cs_mean": A.cross_mean(k21), "group_mean": A.group_mean(k21), "avg_pct": P.average_pct(k21), "ordinal_pct": P.ordinal_pct(k21),
        "to_bins": P.to_bins(P.ordinal_pct(k21)), "ts_bins": P.time_bins(close), "top_fraction": P.top_fraction(k21, 0.2), "equal_weight": P.equal_weight(A.TRADABLE & (k21 > 0)),
        "tradable_mask": A.flag(A.TRADABLE), "next_open_returns": P.next_open_return(), "broadcast_session": mkt, "history_count": A.history(close),
    }
    for name, e in operators.items():
        _panel_query(name, {"value": e})

    _panel_query("feature_ret_21_rank", {"value": A.where(A.TRADABLE, A.rank(k21) - 0.5)})
    for name in ("momentum", "volatility", "drawdown", "trend", "candles", "gaps", "compression", "volume", "relative", "screeners"):
        outputs = catalogue.family(catalogue.FAMILIES[name], B.ROLES)
        # sums of whole volumes give values halfway between two numbers of four digits
        _panel_query(f"features_{name}", outputs, 5 if name == "volume" else DIGITS)
    _panel_query("features_normalised", {n: A.where(A.TRADABLE, A.rank(e) - 0.5) for n, e in catalogue.family(catalogue.FAMILIES["momentum"], B.ROLES).items()})

    for h in P.HORIZONS:
        _panel_query(f"labels_h{h}", P.labels(h))

    pct, ts = P.ordinal_pct(k21), P.time_bins(k21)
    for label, rule in P.rules().items():
        _panel_query("rule_" + label.replace(".", "_"), {"weight": rule(pct, P.to_bins(pct), ts)})


_register()
stage_queries.register(query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
