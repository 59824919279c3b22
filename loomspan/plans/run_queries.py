"""Queries of a whole run: the trial grid and what is read off it, group and environment stages, books and their controls.

The forecasts of the grid are formulas (momentum and reversal), so that it needs no fit; groups and environment are
walk-forward ridge fits.  What several queries share is made once for an application and kept.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import catalogue
from loomspan.functions.keeping import folder, kept
from loomspan.operators import book as K
from loomspan.operators import controls as C
from loomspan.operators import evaluation as E
from loomspan.operators import grid as GR
from loomspan.operators import ingest as I
from loomspan.operators import learners as L
from loomspan.operators import orchestrator as O
from loomspan.operators import panel_ops as P
from loomspan.operators import simulation as S
from loomspan.operators import stage_outputs as SO
from loomspan.operators import stages as G
from loomspan.operators import state as ST
from loomspan.plans import algebra as A
from loomspan.sources import brand_panel as B
from loomspan.sources import global_series as GS

FIRST = 300
HORIZONS = (5, 21)
BLOCKS = (("1996-01-01", "1997-12-31"), ("1998-01-01", "1999-12-31"), ("2000-01-01", "2001-12-31"))
DEFENSIVE = ("TLT", "IEF", "GLD", "UUP")
RUN_WINDOWS = {"expanding": None, "rolling_3y": 756}
RIDGE = {"name": "ridge", "kind": "ridge", "alpha": 1.0}
TREES = {
    "name": "trees", "kind": "boosted",
    "params": {"num_leaves": 7, "learning_rate": 0.15, "num_boost_round": 16, "min_data_in_leaf": 100, "max_bin": 31, "feature_fraction": 0.5, "bagging_fraction": 0.5, "bagging_freq": 1, "lambda_l2": 1.0, "seed": 7},
}


@kept
def sessions(spark, d) -> DataFrame:
    return B.densify(B.brand_bars(spark, d)).select("session_idx", "date").distinct()


@kept
def cells(spark, d) -> DataFrame:
    """session_idx, date, ticker, asset_group, tradable, eligible, defensive, r_next, cash_next, ew_net."""
    r = P.next_open_return()
    outputs = {"r_next": r, "cash_next": A.of_ticker(r, B.ROLES["SHY"]), "_live": A.flag(A.TRADABLE)}
    panel = B.brand_panel(spark, d)
    rows = A.evaluate(panel, outputs, keep=("session_idx", "date", "ticker")).join(panel.select("session_idx", "ticker", "asset_group"), ["session_idx", "ticker"])
    held = C.benchmark_targets(panel, B.ROLES, FIRST).filter("trial = 'ew_monthly'").withColumn("cash_next", F.lit(0.0))
    even = S.simulate(held, cost=GR.COST_BPS / 1e4).select("session_idx", F.col("net").alias("ew_net"))
    live = F.col("_live") > 0
    safe = F.col("ticker").isin(*[B.ROLES[r] for r in DEFENSIVE])
    flagged = rows.withColumns({"tradable": live, "eligible": live & (F.col("ticker") != B.ROLES["SHY"]), "defensive": safe}).drop("_live")
    return flagged.join(even, "session_idx", "left")


@kept
def series(spark, d) -> DataFrame:
    """model, window, variant, h, session_idx, ticker, pred, label."""
    change = catalogue._names()["change"]
    outputs = {"momentum": A.where(A.TRADABLE, change(21)), "reversal": A.where(A.TRADABLE, -change(5))}
    outputs |= {f"label_{h}": P.labels(h, payoff=None)[f"vol_scaled_h{h}"] for h in HORIZONS}
    rows = A.evaluate(B.brand_panel(spark, d), outputs, keep=("session_idx", "ticker"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("h"), F.col(m).alias("pred"), F.col(f"label_{h}").alias("label")) for m in ("momentum", "reversal") for h in HORIZONS]))
    return rows.select("session_idx", "ticker", pairs.alias("_p")).select("_p.model", F.lit("none").alias("window"), F.lit("vol_scaled").alias("variant"), "_p.h", "session_idx", "ticker", "_p.pred", "_p.label")


@kept
def trials(spark, d) -> DataFrame:
    return GR.run_grid(series(spark, d), cells(spark, d), FIRST, None, BLOCKS)


@kept
def deflated(spark, d) -> DataFrame:
    return GR.deflate(trials(spark, d)).drop("net", "s1", "s2", "slice_n")


@kept
def group_rows(spark, d) -> DataFrame:
    """session_idx, ticker (the group), tradable, the groups' mean momentum features and their rank labels."""
    features = group_features()
    alive = A.group_sum(A.flag(A.TRADABLE)) > 0
    r = A.group_mean(P.next_open_return())
    labels = {f"label_h{h}": G.group_label(r, alive, h, P.average_pct) for h in HORIZONS}
    outputs = features | labels | {"_alive": A.flag(alive)}
    panel = B.brand_panel(spark, d)
    rows = A.evaluate(panel, outputs, keep=("session_idx", "ticker")).join(panel.select("session_idx", "ticker", "asset_group"), ["session_idx", "ticker"])
    return rows.groupBy("session_idx", "asset_group").agg(*[F.max(c).alias(c) for c in outputs]).withColumnRenamed("asset_group", "ticker").withColumn("tradable", F.col("_alive") > 0)


def group_features() -> dict[str, A.Expr]:
    return {n: A.group_mean(e) for n, e in catalogue.family(catalogue.MOMENTUM, B.ROLES).items()}


def group_fits(spark, d, spec: dict, months: int = 1) -> DataFrame:
    """model, window, h, session_idx, group, pred of a model entry: a training span ends h + max(h, 5) + 2 sessions before its retrain, at session 300 or later."""
    fits = I.fits(I.retrain_schedule(sessions(spark, d), FIRST, months), HORIZONS, None, 0, lambda h: h + max(h, P.MIN_VOL_WINDOW) + 2, history=301)
    out = L.walk_forward(group_rows(spark, d), fits, sorted(group_features()), {h: [f"label_h{h}"] for h in HORIZONS}, spec)
    return out.select(F.lit(spec["name"]).alias("model"), F.lit("expanding").alias("window"), "h", "session_idx", F.col("ticker").alias("group"), "pred")


@kept
def group_preds(spark, d) -> DataFrame:
    """model, window, h, session_idx, group, pred: ridge on the groups' mean momentum features, a fit every month."""
    return group_fits(spark, d, RIDGE)


ENVIRONMENT_HORIZONS = (3, 5, 10, 21)
ENVIRONMENT = ("env_ret", "env_dd", "env_vol", "env_corr")


def environment_features(spark, d) -> list[str]:
    calendar = I.calendar_features(sessions(spark, d).select("date"))
    return sorted([*catalogue.family(catalogue.MACRO, B.ROLES), *(c for c in calendar.columns if c != "date")])


@kept
def environment_rows(spark, d) -> DataFrame:
    """session_idx, ticker, asked, share (of the features that are there), market and calendar features and the basket's targets and their latest known values."""
    macro = catalogue.family(catalogue.MACRO, B.ROLES)
    daily = G.basket(G.eligible(B.ROLES["SHY"]), P.next_open_return())
    outputs = macro | {n: e for h in ENVIRONMENT_HORIZONS for of in (G.environment_targets, G.persistence) for n, e in of(daily, h).items()}
    panel = GS.with_globals(B.brand_panel(spark, d), GS.daily(spark, d))
    rows = A.evaluate(panel, outputs, keep=("session_idx", "date", "ticker")).filter(F.col("ticker") == B.ROLES["SPY"])
    pairs = ST.environment_correlation(A.evaluate(B.brand_panel(spark, d), {"ret": A.where(G.eligible(B.ROLES["SHY"]), P.next_open_return())}, keep=("session_idx", "ticker")), ENVIRONMENT_HORIZONS)
    joined = rows.join(I.calendar_features(sessions(spark, d).select("date")), "date").join(pairs, "session_idx", "left")
    features = environment_features(spark, d)
    there = sum((F.col(f).isNotNull().cast("int") for f in features[1:]), F.col(features[0]).isNotNull().cast("int"))
    return joined.withColumns({"share": there / len(features), "asked": F.lit(True)}).drop("date")


def environment_fits(spark, d, spec: dict, months: int = 1) -> DataFrame:
    """h, session_idx, target, pred of a model entry.

    A session trains if more than half of its features are there and the target is; every session is predicted.  A
    training span ends 1 + max(h, 10) + 1 sessions before its retrain.
    """
    rows = environment_rows(spark, d)
    fits = I.fits(I.retrain_schedule(sessions(spark, d), FIRST, months), ENVIRONMENT_HORIZONS, None, 0, lambda h: 1 + max(h, 10) + 1, history=1)
    parts = []
    for measure in ENVIRONMENT:  # each target is fitted on the sessions that have it
        targets = {h: [f"{measure}_h{h}"] for h in ENVIRONMENT_HORIZONS}
        parts.append(L.walk_forward(rows.withColumn("trains", F.col("share") > 0.5), fits, environment_features(spark, d), targets, spec, least=100, trains="trains", asked="asked"))
    return reduce(DataFrame.unionByName, parts).select("h", "session_idx", "target", "pred")


@kept
def environment_preds(spark, d) -> DataFrame:
    """h, session_idx, target, pred: ridge on market and calendar features for the basket's return, fall and volatility."""
    return environment_fits(spark, d, RIDGE)


@kept
def stress(spark, d) -> DataFrame:
    """session_idx, stress: 1 where the forecast fall over 21 sessions is among the worst fifth of its own past."""
    fall = environment_preds(spark, d).filter("target = 'env_dd_h21'").select("session_idx", F.col("pred").alias("close"))
    dense = sessions(spark, d).join(fall, "session_idx", "left").withColumn("ticker", F.lit("basket"))
    return A.evaluate(dense, {"stress": G.stress([A.col("close") * -1.0])}, keep=("session_idx", "ticker")).select("session_idx", "stress")


@kept
def book_panel(spark, d) -> DataFrame:
    return cells(spark, d).join(stress(spark, d), "session_idx", "left")


def group_members(spark, d) -> DataFrame:
    return B.brand_panel(spark, d).select("ticker", F.col("asset_group").alias("group")).distinct()


def group_scores(spark, d) -> DataFrame:
    """session_idx, group, score of the group fits, dense."""
    score = K.group_score(K.group_percentiles(group_preds(spark, d)))
    every = sessions(spark, d).select("session_idx").crossJoin(F.broadcast(group_members(spark, d).select("group").distinct()))  # a row for each group
    return every.join(score, ["session_idx", "group"], "left")


@kept
def sources(spark, d) -> DataFrame:
    ok = cells(spark, d).select("session_idx", "ticker", "eligible")
    parts = {"ret_ens": K.predictions_source(series(spark, d), ok, ("vol_scaled",)), "group": K.groups_source(group_scores(spark, d), group_members(spark, d), ok)}
    parts["mix"] = K.mean_source(list(parts.values()), ok)
    out = [s.select(F.lit(n).alias("source"), "session_idx", "ticker", "score") for n, s in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@kept
def momentum_rows(spark, d) -> DataFrame:
    """session_idx, ticker, tradable, normalised momentum features and the scaled and ranked labels of all horizons."""
    outputs = momentum_features() | {"is_tradable": A.flag(A.TRADABLE)} | {n: e for t in momentum_targets().values() for n, e in t.items()}
    return A.evaluate(B.brand_panel(spark, d), outputs, keep=("session_idx", "ticker")).withColumn("tradable", F.col("is_tradable") > 0)


def momentum_features() -> dict[str, A.Expr]:
    return {n: A.first_of(A.rank(e) - 0.5, 0.0) for n, e in catalogue.family(catalogue.MOMENTUM, B.ROLES).items()}


def momentum_targets() -> dict[int, dict[str, A.Expr]]:
    return {h: {n: e for n, e in P.labels(h, payoff=None).items() if n.startswith(("vol_scaled", "rank"))} for h in P.HORIZONS}


def register_walkforwards(query, sessions_of) -> None:
    """Walk-forwards by the name of their kind of model."""

    def momentum(spark, d, spec, horizons, months, store=None):
        """All momentum features, the scaled and ranked labels of some horizons."""
        fits = I.fits(I.retrain_schedule(sessions_of(spark, d), 600, months), horizons, None, 252, lambda h: P.reach(h) + 1)
        targets = {h: sorted(t) for h, t in momentum_targets().items() if h in horizons}
        return L.walk_forward(momentum_rows(spark, d), fits, sorted(momentum_features()), targets, spec, store=store)

    @query("ridge_walkforward")
    def ridge_walkforward(spark, d):
        return momentum(spark, d, RIDGE, P.HORIZONS, 1)

    @query("boosted_walkforward")
    def boosted_walkforward(spark, d):
        """Boosted trees for two horizons, two labels each, a fit every half year."""
        return momentum(spark, d, TREES, HORIZONS, 6)

    @query("walkforward_run")
    def walkforward_run(spark, d):
        """Two ridges and trees x two windows x two horizons as jobs side by side; what an application has made is not made again."""
        rows = momentum_rows(spark, d)
        first = O.first_usable(rows)
        schedule = I.retrain_schedule(sessions_of(spark, d), 600, 12)
        specs = {m["name"]: m for m in (RIDGE | {"name": "ridge_a01", "alpha": 0.1}, RIDGE | {"name": "ridge_a1"}, TREES | {"params": TREES["params"] | {"num_boost_round": 4}})}
        targets = {h: [f"vol_scaled_h{h}"] for h in HORIZONS}

        def work(job):
            fits = I.fits(schedule, (job.h,), RUN_WINDOWS[job.window], first, lambda h: P.reach(h) + 1)
            return L.walk_forward(rows, fits, sorted(momentum_features()), {job.h: targets[job.h]}, specs[job.model]).drop("h")

        jobs = [O.Job(m, w, h) for m in specs for w in RUN_WINDOWS for h in HORIZONS]
        where = f"{folder(spark)}/run-{hashlib.sha256(d.encode()).hexdigest()[:12]}"
        O.check(O.run(spark, jobs, work, where, slow=lambda job: job.model == "trees", say=lambda _: None))
        return O.predictions(spark, where, jobs).select("model", "window", "h", "retrain", "session_idx", "ticker", "target", "pred")

    @query("groups_stage")
    def groups_stage(spark, d):
        """The groups stage as it is written and read back: scores of groups as predictions of their members."""
        where = f"{folder(spark)}/stages-{hashlib.sha256(d.encode()).hexdigest()[:12]}/groups"
        ok = cells(spark, d).select("session_idx", "ticker", "eligible")
        settings = {"groups": {"purge_extra_sessions": 2}, "evaluation": {"first": FIRST}}
        SO.groups(where, group_members(spark, d), group_rows(spark, d), group_preds(spark, d), ok, "vol_scaled", ["vol_scaled", "rank"], settings, settings)
        return spark.read.parquet(f"{where}/etf_scores")

    @query("environment_stage")
    def environment_stage(spark, d):
        """The environment stage as it is written and read back: how well each target is forecast, by the fits and by its latest known value."""
        where = f"{folder(spark)}/stages-{hashlib.sha256(d.encode()).hexdigest()[:12]}/environment"
        rows = environment_rows(spark, d)
        cases = [(m, h) for m in ENVIRONMENT for h in ENVIRONMENT_HORIZONS]
        long = lambda prefix, value: rows.select("session_idx", F.explode(F.array(*[F.struct(F.lit(m).alias("target"), F.lit(h).alias("h"), F.col(f"{m.replace('env', prefix, 1)}_h{h}").alias(value)) for m, h in cases])).alias("x")).select("session_idx", "x.*")
        preds = environment_preds(spark, d).select(F.substring_index("target", "_h", 1).alias("target"), "h", F.lit("ridge").alias("model"), "session_idx", "pred")
        basket = rows.select("session_idx", F.col("env_ret_h3").alias("ret_h3"))
        settings = {"environment": {"purge_extra_sessions": 1}, "evaluation": {"first": FIRST}}
        SO.environment(where, basket, long("env", "y"), long("past", "pred"), preds, stress(spark, d), lambda h: 1 + max(h, 10), FIRST, 1 << 30, settings, settings)
        return spark.read.parquet(f"{where}/predictability")

    windows_sql = " UNION ALL ".join(f"""SELECT '{w}' AS "window", CAST({n if n else 'NULL'} AS INTEGER) AS size""" for w, n in RUN_WINDOWS.items())
    spans_sql = f"""m AS (SELECT min(session_idx) AS s FROM days GROUP BY date_trunc('month', d)), nth AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS n FROM m),
first_row AS (SELECT min(session_idx) AS f FROM panel WHERE tradable), w AS ({windows_sql}),
ends AS (SELECT "window", size, f, CAST(h AS INTEGER) AS h, s AS retrain, s - (1 + greatest(h, 5)) - 1 AS e FROM nth, w, first_row, (SELECT unnest([5, 21]) AS h) hs WHERE n % 3 = 0),
spans AS (SELECT "window", h, retrain, CASE WHEN size IS NULL THEN f ELSE e - size + 1 END AS a, e AS b FROM ends WHERE CASE WHEN size IS NULL THEN e - f + 1 >= 252 ELSE e - size + 1 >= f END)"""

    def run_spans(spark, d):
        first = O.first_usable(B.brand_panel(spark, d))
        schedule = I.retrain_schedule(sessions_of(spark, d), 0, 3)
        each = [I.fits(schedule, HORIZONS, n, first, lambda h: P.reach(h) + 1).withColumn("window", F.lit(w)) for w, n in RUN_WINDOWS.items()]
        return each[0].unionByName(each[1])

    @query("walkforward_fit_log", f"""WITH {B.BRAND_SQL}, {spans_sql}
SELECT "window", h, r.d AS retrain, x.d AS train_start, y.d AS train_end, (SELECT count(*) FROM panel WHERE tradable AND session_idx BETWEEN a AND b) AS "rows"
FROM spans JOIN days r ON r.session_idx = retrain JOIN days x ON x.session_idx = a JOIN days y ON y.session_idx = b""")
    def walkforward_fit_log(spark, d):
        spans = run_spans(spark, d)
        parts = [O.fit_log(spans.filter(F.col("window") == w), B.brand_panel(spark, d), sessions_of(spark, d)).withColumn("window", F.lit(w)) for w in RUN_WINDOWS]
        return parts[0].unionByName(parts[1])

    @query("first_full_bins", f"""WITH {B.BRAND_SQL}, {spans_sql}
SELECT w."window", CAST(hs.h AS INTEGER) AS h, CAST((SELECT min(retrain) + 63 FROM spans WHERE spans."window" = w."window" AND spans.h = hs.h) AS INTEGER) AS session_idx FROM w, (SELECT unnest([5, 21]) AS h) hs""")
    def first_full_bins(spark, d):
        asked = sessions_of(spark, d).select(F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(h).alias("h")) for w in RUN_WINDOWS for h in HORIZONS])).alias("x")).select("x.*").distinct()
        return O.first_full_bins(run_spans(spark, d), asked)

    @query("group_walkforward_trees")
    def group_walkforward_trees(spark, d):
        return group_fits(spark, d, TREES, 6)

    @query("environment_walkforward_trees")
    def environment_walkforward_trees(spark, d):
        return environment_fits(spark, d, TREES, 6)


def register(query, trials_of, trials_sql: str, panel_sql: str, r, rounded) -> None:
    """Put the queries into a registry; trials_of and trials_sql are the books that stage_queries compares with SQL."""

    @query("trial_grid")
    def trial_grid(spark, d):
        return trials(spark, d).drop("net", "s1", "s2", "slice_n")

    @query("grid_dsr")
    def grid_dsr(spark, d):
        return deflated(spark, d).select("trial_id", *GR.CHOICE, "sharpe", "dsr", "dsr_trials", "dsr_all_runs", "dsr_all_runs_trials")

    @query("grid_pbo")
    def grid_pbo(spark, d):
        return E.overfitting(GR.moments(trials(spark, d)))

    @query("grid_top")
    def grid_top(spark, d):
        return GR.top(deflated(spark, d))

    @query("grid_medians")
    def grid_medians(spark, d):
        return E.medians(deflated(spark, d), "sharpe", "model", "window", "variant", "h", "rule_family", "rule", "rebalance_every", "no_trade_band")

    @query("grid_ic")
    def grid_ic(spark, d):
        return GR.pivot_ic(GR.prediction_series(trials(spark, d)), "model", "h", list(HORIZONS))

    @query("group_walkforward")
    def group_walkforward(spark, d):
        return group_preds(spark, d)

    @query("group_member_scores")
    def group_member_scores(spark, d):
        return sources(spark, d).filter("source = 'group'").drop("source")

    @query("environment_walkforward")
    def environment_walkforward(spark, d):
        return environment_preds(spark, d)

    @query("environment_stress")
    def environment_stress(spark, d):
        return stress(spark, d)

    @query("book_grid")
    def book_grid(spark, d):
        return K.book_grid(sources(spark, d), book_panel(spark, d), FIRST, None, BLOCKS)

    @query("book_baselines")
    def book_baselines(spark, d):
        held = C.benchmark_targets(B.brand_panel(spark, d), B.ROLES, FIRST).withColumn("cash_next", F.lit(0.0))
        return K.baselines(book_panel(spark, d), S.simulate(held, cost=K.COST_BPS / 1e4), FIRST, None, BLOCKS)

    @query("book_control_rows")
    def book_control_rows(spark, d):
        ok = cells(spark, d).select("session_idx", "ticker", "eligible")
        to_ticker = lambda s: K.groups_source(s.withColumnRenamed("ticker", "group"), group_members(spark, d), ok, ("case",))
        return K.controls(group_scores(spark, d).withColumnRenamed("group", "ticker"), book_panel(spark, d), FIRST, None, BLOCKS, to_ticker=to_ticker)

    blocks = " UNION ALL ".join(f"SELECT {i + 1} AS block, DATE '{a}' AS a, DATE '{b}' AS b" for i, (a, b) in enumerate(BLOCKS))

    @query("period_sharpes", f"""WITH {trials_sql}, dd AS (SELECT session_idx, date FROM (WITH {panel_sql} SELECT session_idx, d AS date FROM days) q), blocks AS ({blocks})
SELECT trial, CAST(block AS INTEGER) AS block, {r('CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252) END')} AS sharpe FROM trials JOIN dd USING (session_idx) JOIN blocks ON date BETWEEN a AND b GROUP BY 1, 2""")
    def period_sharpes(spark, d):
        dated = trials_of(spark, d).join(sessions(spark, d), "session_idx")
        return E.dated_sharpes(dated, BLOCKS).select("trial", "block", rounded("sharpe").alias("sharpe"))

    days = f"days2 AS (SELECT session_idx, d AS date FROM (WITH {panel_sql} SELECT session_idx, d FROM days) q)"

    @query("rebalance_clocks", f"""WITH {days}, m AS (SELECT session_idx, date, lag(date_trunc('month', date)) OVER (ORDER BY session_idx) AS before FROM days2)
SELECT session_idx, session_idx >= {FIRST} AND (before IS NULL OR before <> date_trunc('month', date)) AS monthly, session_idx = {FIRST} AS once, session_idx >= {FIRST} AND (session_idx - {FIRST}) % 21 = 0 AS every_21 FROM m""")
    def rebalance_clocks(spark, d):
        return C.clocks(sessions(spark, d), FIRST, {"monthly": "monthly", "once": "once", "every_21": 21}).drop("date")

    @query("evaluation_window", f"WITH {days} SELECT CAST(count(*) FILTER (date < DATE '1996-07-01') AS INTEGER) AS first, CAST(count(*) FILTER (date <= DATE '1999-12-31') AS INTEGER) AS stop FROM days2")
    def evaluation_window(spark, d):
        return I.evaluation_window(sessions(spark, d), "1996-07-01", "1999-12-31")

    @query("grid_choices", """SELECT m.model, h.h, e.every AS rebalance_every, b.band AS no_trade_band FROM (SELECT unnest(['momentum', 'reversal']) AS model) m, (SELECT CAST(unnest([1, 3, 5, 7, 10, 15, 21, 32, 44]) AS INTEGER) AS h) h,
(SELECT DISTINCT h AS k, CAST(every AS INTEGER) AS every FROM (SELECT unnest([1, 3, 5, 7, 10, 15, 21, 32, 44]) AS h), LATERAL (SELECT unnest([1, 5, 10, 21, h]) AS every) x) e, (SELECT unnest([0.0::DOUBLE, 0.02::DOUBLE]) AS band) b WHERE e.k = h.h""")
    def grid_choices(spark, d):
        choices = [(m, h, e, b) for m in ("momentum", "reversal") for h in P.HORIZONS for e in GR.rebalance_choices(h) for b in GR.BANDS]
        return spark.createDataFrame(choices, "model string, h int, rebalance_every int, no_trade_band double")

    @query("resume_jobs", "SELECT DISTINCT o_orderpriority AS model, o_custkey AS window FROM orders EXCEPT SELECT DISTINCT o_orderpriority, o_custkey FROM orders WHERE o_totalprice > 200000")
    def resume_jobs(spark, d):
        rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("window"), "o_totalprice")
        done = rows.filter("o_totalprice > 200000").select("model", "window").distinct()
        return rows.select("model", "window").distinct().join(done, ["model", "window"], "left_anti")

    scores = {"a": A.where(A.TRADABLE, catalogue._names()["change"](21)), "b": A.where(A.TRADABLE, catalogue._names()["change"](5))}
    own = A.to_sql(panel_sql, scores, keep=("session_idx", "ticker"))
    pct = lambda c: f"(rank() OVER (PARTITION BY session_idx, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY session_idx, {c}) - 1) / 2.0 - 1) / greatest(count({c}) OVER (PARTITION BY session_idx) - 1, 1)"

    @query("mean_score", f"""WITH s AS ({own}), p AS (SELECT session_idx, ticker, CASE WHEN a IS NOT NULL THEN {pct('a')} END AS a, CASE WHEN b IS NOT NULL THEN {pct('b')} END AS b FROM s),
m AS (SELECT session_idx, ticker, CASE WHEN a IS NULL THEN {r('b', 6)} WHEN b IS NULL THEN {r('a', 6)} ELSE {r('(a + b) / 2', 6)} END AS c FROM p) SELECT session_idx, ticker, {r(f"CASE WHEN c IS NOT NULL THEN {pct('c')} END")} AS score FROM m""")
    def mean_score(spark, d):
        rows = A.evaluate(B.brand_panel(spark, d), scores, keep=("session_idx", "ticker"))
        ok = rows.select("session_idx", "ticker", F.lit(True).alias("eligible"))
        parts = [K.ranked_among(rows.select("session_idx", "ticker", F.col(c).alias("score")), ok) for c in scores]
        mean = K.mean_of(parts).withColumn("score", rounded("score", 6))
        return K.ranked_among(mean, ok).select("session_idx", "ticker", rounded("score").alias("score"))

    ret = A.where(A.TRADABLE, P.next_open_return())
    lagged = A.to_sql(panel_sql, {"y": ret}, keep=("session_idx", "ticker"))

    @query("expanding_mean", f"""WITH s AS ({lagged}) SELECT session_idx, ticker, CASE WHEN count(y) OVER w >= 252 THEN {r('avg(y) OVER w', 6)} END AS base FROM s
WINDOW w AS (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)""")
    def expanding_mean(spark, d):
        rows = A.evaluate(B.brand_panel(spark, d), {"y": ret}, keep=("session_idx", "ticker"))
        return E.known_mean(rows.withColumnRenamed("ticker", "key"), 2, 252).select("session_idx", F.col("key").alias("ticker"), rounded("base", 6).alias("base"))
