"""The book stage: score sources, the grid of books, baselines and controls.

Scores are long tables (source, session_idx, ticker, score) of percentiles from 0 to 1.  A source with one rule is a
group of sessions x tickers; all its switch states, gross sizes and intervals are simulated in one task over it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import controls as C
from loomspan.operators import evaluation as E
from loomspan.operators import grid as G
from loomspan.operators import simulation as S

# fixed values of the book
COST_BPS, STRESS_BPS = 5, 20
BORROW_SPREAD_YEAR = 0.005
EQUAL_WEIGHT_EVERY = 21
SELECTION = (("top_fraction", 0.2, 1.0), ("score_capped", None, 1.0), ("score_capped_p2", None, 2.0))
SWITCH, GROSS, EVERY = (False, True), (1.0, 1.5), (5, 21)
DRAWS = 20
MEASURES = (
    "sharpe_excess", "sharpe", "cagr", "vol_year", "max_drawdown", "info_ratio_vs_ew", "median_block_sharpe_excess", "min_block_sharpe_excess",
    "turnover_year", "skew", "kurt", "n",
)
_MEASURED = ", ".join(f"{m} {'long' if m == 'n' else 'double'}" for m in MEASURES)


# -- scores -------------------------------------------------------------------------------------------------------------
def percentile(scores: DataFrame, column: str, by: tuple[str, ...], ok: Column | None = None, ordinal: bool = False) -> Column:
    """Rank among the present values of a session from 0 to 1; ties at their mean (one value alone: 0) or in ticker order (missing)."""
    x = F.col(column) if ok is None else F.when(ok, F.col(column))
    mine = Window.partitionBy(*by, x.isNull())
    n = F.count(x).over(Window.partitionBy(*by))
    if ordinal:
        return F.when(x.isNotNull() & (n > 1), (F.row_number().over(mine.orderBy(x, "ticker")) - 1) / (n - 1))
    mid = F.rank().over(mine.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2
    return F.when(x.isNotNull(), (mid - 1) / F.greatest(n - 1, F.lit(1)))


def mean_of(scores: list[DataFrame]) -> DataFrame:
    """session_idx, ticker, score: the mean of all scores that are present, cell by cell."""
    return reduce(DataFrame.unionByName, [s.select("session_idx", "ticker", "score") for s in scores]).groupBy("session_idx", "ticker").agg(F.avg("score").alias("score"))


def ranked_among(scores: DataFrame, eligible: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The scores as percentiles among the eligible tickers: (session_idx, ticker, eligible) names every cell; by: columns that tell score sets apart."""
    cells = eligible.select("session_idx", "ticker", F.col("eligible").alias("_ok"))
    if by:
        cells = cells.crossJoin(F.broadcast(scores.select(*by).distinct()))  # a row for each score set
    cells = cells.join(scores.select(*by, "session_idx", "ticker", "score"), [*by, "session_idx", "ticker"], "left")
    return cells.select(*by, "session_idx", "ticker", percentile(cells, "score", (*by, "session_idx"), F.col("_ok")).alias("score"))


def predictions_source(preds: DataFrame, eligible: DataFrame, variants: tuple[str, ...], horizons: tuple[int, ...] | None = None) -> DataFrame:
    """Mean percentile over all prediction series (model, window, variant, h) asked for, ranked among the eligible tickers."""
    asked = preds.filter(F.col("variant").isin(*variants) & (F.lit(True) if horizons is None else F.col("h").isin(*horizons)))
    live = asked.join(eligible.filter("eligible").select("session_idx", "ticker"), ["session_idx", "ticker"])
    each = live.select("session_idx", "ticker", percentile(live, "pred", ("model", "window", "variant", "h", "session_idx"), ordinal=True).alias("score"))
    return ranked_among(each.groupBy("session_idx", "ticker").agg(F.avg("score").alias("score")), eligible)


def group_percentiles(preds: DataFrame) -> DataFrame:
    """model, window, h, session_idx, group, pct: the rank of each group's prediction among the groups; one alone: 0."""
    return preds.select("model", "window", "h", "session_idx", "group", percentile(preds, "pred", ("model", "window", "h", "session_idx")).alias("pct"))


def group_score(pct: DataFrame, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """session_idx, group, score: the mean percentile over models, windows and the horizons asked for."""
    return pct.filter(F.lit(True) if horizons is None else F.col("h").isin(*horizons)).groupBy("session_idx", "group").agg(F.avg("pct").alias("score"))


def groups_source(score: DataFrame, group_map: DataFrame, eligible: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each ticker takes its group's score, ranked among the eligible tickers; a ticker in no group has none."""
    members = group_map.filter(F.col("group").isNotNull()).select("ticker", "group")  # a row for each ticker
    return ranked_among(score.join(F.broadcast(members), "group"), eligible, by)


def mean_source(scores: list[DataFrame], eligible: DataFrame) -> DataFrame:
    return ranked_among(mean_of(scores), eligible)


# -- books --------------------------------------------------------------------------------------------------------------
def chosen(score: np.ndarray, groups: np.ndarray, rule: str, fraction: float | None, power: float) -> np.ndarray:
    """Weights of a rule: even over the top fraction, or by the powered score above the middle with caps."""
    if fraction is not None:
        return G.even(np.nan_to_num(score, nan=-1.0) >= 1.0 - fraction)
    off = score - 0.5
    return G.capped(0.5 + np.sign(off) * (2 * np.abs(off)) ** power / 2 if power != 1 else score, groups)


class _Cells:
    """The matrices of one group of rows, sessions x tickers."""

    def __init__(self, pdf: pd.DataFrame, first: int, stop: int | None, blocks):
        pdf = pdf.sort_values(["session_idx", "ticker"])
        self.shape = (pdf["session_idx"].nunique(), pdf["ticker"].nunique())
        self.pdf = pdf
        self.at = self.column("session_idx")
        self.groups = pdf["asset_group"].to_numpy().astype(str)[: self.shape[1]]
        self.tradable, self.eligible = self.matrix("tradable") > 0, self.matrix("eligible") > 0
        self.r, self.score = self.matrix("r_next"), self.matrix("score")
        self.cash, self.ew = np.nan_to_num(self.column("cash_next").astype(float)), np.nan_to_num(self.column("ew_net").astype(float))
        self.stress = np.nan_to_num(self.column("stress").astype(float)) > 0
        safe = (self.matrix("defensive") > 0) & self.tradable
        self.defensive = G.even(safe)
        self.first, self.inside = first, (self.at >= first) & (self.at < (self.at[-1] + 1 if stop is None else stop))
        dates = self.column("date").astype(str)
        self.masks = [(dates[self.inside] >= a) & (dates[self.inside] <= b) for a, b in blocks]

    def matrix(self, name: str) -> np.ndarray:
        return self.pdf[name].to_numpy(dtype=float).reshape(self.shape)

    def column(self, name: str) -> np.ndarray:
        return self.pdf[name].to_numpy().reshape(self.shape)[:, 0]

    def book(self, selection: np.ndarray, switch: bool, gross: float, every: int, share: float = 1.0, bps: float = COST_BPS) -> dict[str, float]:
        """Measures of one book: the selection, moved to the defensive basket by ``share`` in stress, times the gross size."""
        moved = (np.where(self.stress, share, 0.0) if switch else np.zeros(len(self.at)))[:, None]
        w = np.where(self.tradable, gross * ((1 - moved) * selection + moved * self.defensive), 0.0)
        clock = (self.at >= self.first) & ((self.at - self.first) % max(1, every) == 0)
        earned, turnover = S.fold_levered(w, clock, self.r, self.cash, BORROW_SPREAD_YEAR / E.YEAR)
        net, turnover = (earned - turnover * bps / 1e4)[None, self.inside], turnover[None, self.inside]
        excess = net - self.cash[None, self.inside]
        plain, over = G.measures(net, turnover, []), G.measures(excess, turnover, self.masks)
        n = excess.shape[1]
        # bias-corrected moments, as for a sample
        skew = over["skew"] * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 else np.array([np.nan])
        kurt = ((n + 1) * (over["kurt"] - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3 if n > 3 else np.array([np.nan])
        values = (
            over["sharpe"], plain["sharpe"], plain["cagr"], plain["vol"], plain["max_drawdown"], G.sharpe(net - self.ew[None, self.inside]),
            over["median_block_sharpe"], over["min_block_sharpe"], plain["turnover_year"], skew, kurt, np.array([n]),
        )
        return {m: v[0] for m, v in zip(MEASURES, values, strict=True)}


def _clean(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, t in df.dtypes if t == "double"})


def _cells(scores: DataFrame, panel: DataFrame, by: str) -> DataFrame:
    """Every cell of the panel for every score, a few of them: by, the panel's columns, score."""
    names = scores.select(by).distinct()
    return panel.drop("score", by).crossJoin(F.broadcast(names)).join(scores.select(by, "session_idx", "ticker", "score"), [by, "session_idx", "ticker"], "left")


def book_grid(scores: DataFrame, panel: DataFrame, first: int, stop: int | None = None, blocks=(), selection=SELECTION) -> DataFrame:
    """A row for each source x rule x switch x gross x interval, with its measures, dsr and dsr_trials.

    scores: source, session_idx, ticker, score.  panel: session_idx, date, ticker, asset_group, tradable, eligible,
    defensive, r_next, cash_next, ew_net, stress, dense.
    """
    rules = panel.sparkSession.createDataFrame([(r, f, p) for r, f, p in selection], "rule string, fraction double, power double")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = _Cells(pdf, first, stop, blocks)
        source, rule, fraction, power = (pdf[c].iloc[0] for c in ("source", "rule", "fraction", "power"))
        held = chosen(cells.score, cells.groups, rule, None if pd.isna(fraction) else fraction, power)
        rows = [{"source": source, "rule": rule, "switch": s, "gross": g, "rebalance_every_sessions": e} | cells.book(held, s, g, e) for s in SWITCH for g in GROSS for e in EVERY]
        return pd.DataFrame(rows)

    rows = _cells(scores, panel, "source").crossJoin(F.broadcast(rules))
    books = _clean(rows.groupBy("source", "rule").applyInPandas(one, f"source string, rule string, switch boolean, gross double, rebalance_every_sessions int, {_MEASURED}"))
    deflated = E.add_deflated_sharpe(books.withColumn("_net", F.col("sharpe")).withColumn("sharpe", F.col("sharpe_excess")))
    known = Window.partitionBy(F.lit(1))  # a row for each book
    return deflated.withColumn("sharpe", F.col("_net")).drop("_net").withColumn("dsr_trials", F.count("sharpe_excess").over(known))


def baselines(panel: DataFrame, benchmarks: DataFrame, first: int, stop: int | None = None, blocks=()) -> DataFrame:
    """Equal-weight books (switch x gross) and the fixed benchmarks (trial, session_idx, net) over the same sessions."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = _Cells(pdf, first, stop, blocks)
        rows = [{"book": "equal_weight", "switch": s, "gross": g, "rebalance_every_sessions": EQUAL_WEIGHT_EVERY} | cells.book(G.even(cells.eligible), s, g, EQUAL_WEIGHT_EVERY) for s in SWITCH for g in GROSS]
        return pd.DataFrame(rows)

    equal = _clean(panel.withColumn("score", F.lit(None).cast("double")).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(one, f"book string, switch boolean, gross double, rebalance_every_sessions int, {_MEASURED}"))
    inside = (F.col("session_idx") >= first) & (F.lit(True) if stop is None else F.col("session_idx") < stop)
    cash = panel.groupBy("session_idx").agg(F.first("cash_next").alias("_cash"))
    net = benchmarks.filter(inside).join(cash, "session_idx")
    excess = E.summary(net.select("trial", "session_idx", (F.col("net") - F.coalesce("_cash", F.lit(0.0))).alias("net"))).select("trial", F.col("sharpe").alias("sharpe_excess"))
    fixed = E.summary(net).select("trial", "sharpe", "cagr").join(E.max_drawdown(net), "trial").join(excess, "trial")
    return equal.unionByName(fixed.withColumn("book", F.concat(F.lit("benchmark "), "trial")).drop("trial"), allowMissingColumns=True)


def controls(scores: DataFrame, panel: DataFrame, first: int, stop: int | None = None, blocks=(), rule=("score_capped_p2", None, 2.0), switch: bool = True, gross: float = 1.0, every: int = 5, draws: int = DRAWS, to_ticker=None) -> DataFrame:
    """case, family and the measures of the reference book and its controls.

    scores: session_idx, ticker, score of the book's source, dense; for a groups source the group's scores with the
    group as ticker, and to_ticker makes ticker scores of frames with a column case.  Controls: the book itself, at
    stress cost, with the switch off, on stale scores, on shuffled scores and with random stress.
    """
    random = [f"random switch {i}" for i in range(draws if switch else 0)]
    settings = {"real": (switch, COST_BPS), "real, stress cost": (switch, STRESS_BPS), "real, switch off": (False, COST_BPS)}
    own = [*settings, *random]
    cased = scores.select(F.explode(F.array(*[F.lit(c) for c in own])).alias("case"), "session_idx", "ticker", "score")
    cased = cased.unionByName(C.stale(scores).select(F.lit(f"stale source ({C.STALE_LAG})").alias("case"), "session_idx", "ticker", "score"))
    cased = cased.unionByName(C.shuffles(scores, draws).select(F.concat(F.lit("shuffled source "), "draw").alias("case"), "session_idx", "ticker", "score"))
    rows = _cells(cased if to_ticker is None else to_ticker(cased), panel, "case")
    if random:
        stress = panel.groupBy("session_idx").agg(F.max(F.coalesce("stress", F.lit(0.0))).alias("stress"))
        masks = [C.random_stress(stress, i).select(F.lit(c).alias("case"), "session_idx", F.col("stress").alias("_random")) for i, c in enumerate(random)]
        rows = rows.join(reduce(DataFrame.unionByName, masks), ["case", "session_idx"], "left").withColumn("stress", F.coalesce("_random", "stress")).drop("_random")
    name, fraction, power = rule

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = _Cells(pdf, first, stop, blocks)
        case = pdf["case"].iloc[0]
        sw, bps = settings.get(case, (switch, COST_BPS))
        return pd.DataFrame([{"case": case} | cells.book(chosen(cells.score, cells.groups, name, fraction, power), sw, gross, every, bps=bps)])

    out = _clean(rows.groupBy("case").applyInPandas(one, f"case string, {_MEASURED}"))
    return out.withColumn("family", F.regexp_replace("case", r" \d+$", ""))


def by_family(rows: DataFrame, family: str, measure: str = "sharpe_excess") -> DataFrame:
    """family, median, max and n of a measure."""
    return rows.groupBy(family).agg(F.median(measure).alias("median"), F.max(measure).alias("max"), F.count(F.lit(1)).alias("n"))
