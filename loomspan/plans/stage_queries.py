"""Queries of ingest, evaluation, simulation, groups, environment and model operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import catalogue, sql_callable
from loomspan.functions.keeping import folder
from loomspan.operators import controls as C
from loomspan.operators import evaluation as E
from loomspan.operators import ingest as I
from loomspan.operators import panel_ops as P
from loomspan.operators import simulation as S
from loomspan.operators import stages as G
from loomspan.operators import state as ST
from loomspan.plans import algebra as A
from loomspan.plans import run_queries
from loomspan.sources import brand_panel as B
from loomspan.sources import global_series as GS
from loomspan.sources import panel_store as PS

HORIZON = 5
_PANEL = "WITH " + B.BRAND_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(c, digits: int = 4):
    """Rounding by plain arithmetic, as in the SQL below."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * 10.0**digits + 0.5).cast("double") / 10.0**digits


def _r(text: str, digits: int = 4) -> str:
    return A.rounded(text, digits)


def _score() -> A.Expr:
    return catalogue._names()["change"](21)


def _books() -> dict[str, A.Expr]:
    pct = P.ordinal_pct(_score())
    bins = P.to_bins(pct)
    return {"w1": P.top_bins(bins, 1), "w2": P.top_bins(bins, 2), "w3": P.top_bins(bins, 3), "w4": P.score_capped(pct), "w5": P.long_short(bins, 1), "r": A.first_of(P.next_open_return(), 0.0)}


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial, session_idx, net of books that are rebalanced at every session."""
    held = A.evaluate(B.brand_panel(spark, sf_dir), _books(), keep=("session_idx", "ticker"))
    nets = held.groupBy("session_idx").agg(*[_round(F.sum(F.col(f"w{i}") * F.col("r")), 8).alias(f"t{i}") for i in range(1, 6)])
    return nets.unpivot("session_idx", [f"t{i}" for i in range(1, 6)], "trial", "net")


TRIALS_SQL = f"""trials AS (SELECT trial, session_idx, net FROM (SELECT session_idx, {', '.join(f"{_r(f'sum(w{i} * r)', 8)} AS t{i}" for i in range(1, 6))}
  FROM ({A.to_sql(B.BRAND_SQL, _books(), keep=('session_idx', 'ticker'))}) q GROUP BY session_idx) UNPIVOT (net FOR trial IN (t1, t2, t3, t4, t5)))"""


def register(query) -> None:  # noqa: C901
    """Put all queries of this module into a registry; query(name, sql) is its decorator."""

    # -- ingest ----------------------------------------------------------------------------------------------------
    @query("arg_max_join", """SELECT c_custkey, c_name, CAST(arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS BIGINT) AS last_order
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
    def arg_max_join(spark, d):
        last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
        return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "last_order")

    @query("multi_left_join", _PANEL + f" SELECT d AS date, tk AS ticker, {_r('close')} AS close, {_r('open')} AS open, {_r('high')} AS high, volume FROM bars")
    def multi_left_join(spark, d):
        bars = B.brand_bars(spark, d)
        fields = {c: bars.select("date", "ticker", F.col(c).alias("value")) for c in ("close", "open", "high", "volume")}
        out = I.assemble_fields(fields, ("date", "ticker"), "close")
        return out.select("date", "ticker", _round("close").alias("close"), _round("open").alias("open"), _round("high").alias("high"), "volume")

    yearly = """y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS spent FROM orders GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY yr ORDER BY spent DESC, o_custkey) AS INTEGER) AS size_rank FROM y) q WHERE size_rank <= 20)"""

    def yearly_top(spark, d):
        spent = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("spent"))
        return I.top_by_year(spent, "yr", [F.desc("spent"), F.asc("o_custkey")], 20)

    @query("topn_per_year", f"WITH {yearly} SELECT yr, o_custkey, size_rank, {_r('spent', 2)} AS spent FROM top")
    def topn_per_year(spark, d):
        return yearly_top(spark, d).select("yr", "o_custkey", "size_rank", _round("spent", 2).alias("spent"))

    @query("year_member_join", f"WITH {yearly} SELECT o_orderkey, orders.o_custkey, yr AS effective_year, size_rank FROM orders JOIN top ON top.o_custkey = orders.o_custkey AND yr = year(o_orderdate)")
    def year_member_join(spark, d):
        members = yearly_top(spark, d).select("o_custkey", F.col("yr").alias("effective_year"), "size_rank")
        return I.members_of_year(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), members, "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", "effective_year", "size_rank")

    @query("asof_publication", f"""{_PANEL}, f AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
ks AS (SELECT DISTINCT k FROM f)
SELECT days.d AS date, ks.k AS key, {_r('(SELECT arg_max(f.v, f.d) FROM f WHERE f.k = ks.k AND f.d < days.d)', 2)} AS value FROM days CROSS JOIN ks""")
    def asof_publication(spark, d):
        facts = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("key")).agg(F.avg("o_totalprice").alias("value"))
        sessions = B.brand_bars(spark, d).select("date").distinct()
        return I.as_of(sessions, facts.withColumn("available_at", F.date_add("date", 1)), "key").select("date", "key", _round("value", 2).alias("value"))

    @query("calendar_align", _PANEL + " SELECT ticker, count(*) AS sessions, count(close) AS present, CAST(min(CASE WHEN close IS NOT NULL THEN session_idx END) AS INTEGER) AS first_idx FROM panel GROUP BY ticker")
    def calendar_align(spark, d):
        return B.densify(B.brand_bars(spark, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"), F.count("close").alias("present"), F.min(F.when(F.col("close").isNotNull(), F.col("session_idx"))).alias("first_idx"))

    def sessions_of(spark, d):
        return B.densify(B.brand_bars(spark, d)).select("session_idx", "date").distinct()

    # months are numbered from the first of the data, and only then cut at session 300
    schedule = "sched AS (SELECT session_idx, date FROM (SELECT *, row_number() OVER (ORDER BY session_idx) - 1 AS n FROM (SELECT min(session_idx) AS session_idx, min(d) AS date FROM days GROUP BY date_trunc('month', d)) q) q2 WHERE n % 6 = 0 AND session_idx >= 300)"

    @query("retrain_schedule", f"{_PANEL}, {schedule} SELECT session_idx, date FROM sched")
    def retrain_schedule(spark, d):
        return I.retrain_schedule(sessions_of(spark, d), 300, 6)

    # the last open of a label of session t is t + 1 + max(h, 5); one session more is purged; a window of 500 sessions is whole from session 100 on
    @query("purge_rows", f"""{_PANEL}, {schedule}, h AS (SELECT unnest([1, 5, 21]) AS h),
f AS (SELECT CAST(session_idx AS INTEGER) AS retrain, CAST(h AS INTEGER) AS h, CAST(session_idx - (1 + greatest(h, 5)) - 1 AS INTEGER) AS train_end FROM sched, h)
SELECT retrain, h, train_end - 499 AS train_start, train_end, count(*) AS n_rows FROM f JOIN panel ON panel.session_idx BETWEEN train_end - 499 AND train_end AND tradable WHERE train_end - 499 >= 100 GROUP BY ALL""")
    def purge_rows(spark, d):
        fits = I.fits(I.retrain_schedule(sessions_of(spark, d), 300, 6), (1, 5, 21), 500, 100, lambda h: P.reach(h) + 1)
        rows = B.brand_panel(spark, d).filter("tradable").select("session_idx")
        joined = rows.join(F.broadcast(fits), F.col("session_idx").between(F.col("train_start"), F.col("train_end")))
        return joined.groupBy("retrain", "h", "train_start", "train_end").agg(F.count(F.lit(1)).alias("n_rows"))

    @query("ledger_upsert", "SELECT o_orderstatus AS run_id, o_orderkey AS trial, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS fresh FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'F'")
    def ledger_upsert(spark, d):
        orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run_id"), F.col("o_orderkey").alias("trial"))
        return I.upsert_runs(orders.filter("trial % 2 = 0").withColumn("fresh", F.lit(0)), orders.filter("run_id = 'F'").withColumn("fresh", F.lit(1)))

    past = "SELECT ticker, session_idx, close, list(close) OVER (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM panel"
    share = "(len(list_filter(p, lambda x: x < close)) + 0.5 * len(list_filter(p, lambda x: x = close))) / len(p)"
    pct_sql = f"{_PANEL}, q AS (SELECT ticker, session_idx, close, list_filter(p, lambda x: x IS NOT NULL) AS p FROM ({past}) q0) SELECT ticker AS key, session_idx, CASE WHEN close IS NOT NULL AND len(p) >= 252 THEN {_r(share, 6)} END AS pct FROM q"

    @query("expanding_pct", pct_sql)
    def expanding_pct(spark, d):
        return I.expanding_pct(B.brand_panel(spark, d).select(F.col("ticker").alias("key"), "session_idx", F.col("close").alias("value"))).select("key", "session_idx", _round("pct", 6).alias("pct"))

    def keyed(spark, d):
        """The panel's closes as a view for SQL calls."""
        sql_callable.register(spark)
        B.brand_panel(spark, d).select(F.col("ticker").alias("key"), "session_idx", F.col("close").alias("value")).createOrReplaceTempView("panel_values")

    @query("sql_expanding_pct", pct_sql)
    def sql_expanding_pct(spark, d):
        keyed(spark, d)
        return spark.sql("SELECT * FROM expanding_pct(TABLE(panel_values) PARTITION BY (key) ORDER BY (session_idx), 252)").select("key", "session_idx", _round("result", 6).alias("pct"))

    @query("sql_rank_past", f"""{_PANEL}, q AS (SELECT ticker, session_idx, close, list_filter(list(close) OVER (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS p FROM panel)
SELECT ticker AS key, session_idx, CASE WHEN close IS NOT NULL AND len(p) >= 40 THEN {_r(share, 6)} END AS share FROM q""")
    def sql_rank_past(spark, d):
        keyed(spark, d)
        ranked = spark.sql("SELECT key, session_idx, rank_past(value, 40) OVER (PARTITION BY key ORDER BY session_idx ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS share FROM panel_values")
        return ranked.withColumn("share", _round(F.nanvl("share", F.lit(None).cast("double")), 6))

    # the average one session after another: a missing close ages the weight of what is known
    @query("sql_ts_ema", f"""WITH RECURSIVE {B.BRAND_SQL}, e AS (
SELECT ticker, session_idx, close AS mean, CAST(1 AS DOUBLE) AS weight, CASE WHEN close IS NULL THEN 0 ELSE 1 END AS present FROM panel WHERE session_idx = 0
UNION ALL SELECT p.ticker, p.session_idx,
  CASE WHEN e.mean IS NULL THEN p.close WHEN p.close IS NULL THEN e.mean ELSE (e.weight * (11 / 13.0::DOUBLE) * e.mean + 2 / 13.0::DOUBLE * p.close) / (e.weight * (11 / 13.0::DOUBLE) + 2 / 13.0::DOUBLE) END,
  CASE WHEN e.mean IS NULL OR p.close IS NOT NULL THEN 1 ELSE e.weight * (11 / 13.0::DOUBLE) END, e.present + CASE WHEN p.close IS NULL THEN 0 ELSE 1 END
  FROM e JOIN panel p ON p.ticker = e.ticker AND p.session_idx = e.session_idx + 1)
SELECT ticker AS key, session_idx, CASE WHEN present >= 12 THEN {_r('mean', 6)} END AS ema FROM e""")
    def sql_ts_ema(spark, d):
        keyed(spark, d)
        return spark.sql("SELECT * FROM ts_ema(TABLE(panel_values) PARTITION BY (key) ORDER BY (session_idx), 12)").select("key", "session_idx", _round("result", 6).alias("ema"))

    kept_windows = {"mean_63": A.mean(A.col("close"), 63), "high_21": A.high_of(A.col("close"), 21), "lag_5": A.lag(A.col("close"), 5)}

    @query("stored_panel", A.to_sql(B.BRAND_SQL, kept_windows, digits=4))
    def stored_panel(spark, d):
        """Windows over the panel as a bucketed table: no shuffle, no sort."""
        name = f"panel_{hashlib.sha256(d.encode()).hexdigest()[:12]}"
        held = PS.stored(spark, name) if spark.catalog.tableExists(name) else PS.store(B.brand_panel(spark, d), name, f"{folder(spark)}/tables/{name}")
        return A.evaluate(held, kept_windows, digits=4)

    @query("features_calendar", f"""{_PANEL}, c AS (SELECT d, last_day(d) - CAST(greatest(isodow(last_day(d)) - 5, 0) AS INTEGER) AS e, last_day(d + INTERVAL 1 MONTH) AS l2, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS n FROM days),
e AS (SELECT d, n, CASE WHEN d > e THEN l2 - CAST(greatest(isodow(l2) - 5, 0) AS INTEGER) ELSE e END AS e FROM c),
t AS (SELECT d, n, CAST(len(list_filter(range(d + 1, e + 1, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS DOUBLE) AS k FROM e)
SELECT d AS date, CAST(isodow(d) - 1 AS DOUBLE) AS day_of_week, {_r('sin(month(d) * (2 * 3.141592653589793 / 12))')} AS month_sin, {_r('cos(month(d) * (2 * 3.141592653589793 / 12))')} AS month_cos, k AS business_days_to_month_end, CAST(CASE WHEN k <= 2 OR n <= 3 THEN 1 ELSE 0 END AS DOUBLE) AS turn_of_month FROM t""")
    def features_calendar(spark, d):
        f = I.calendar_features(sessions_of(spark, d).select("date"))
        return f.select("date", "day_of_week", _round("month_sin").alias("month_sin"), _round("month_cos").alias("month_cos"), "business_days_to_month_end", "turn_of_month")

    macro = catalogue.family(catalogue.MACRO, B.ROLES)
    base = B.BRAND_SQL.replace("panel AS (", "bare AS (") + GS.GLOBALS_SQL + ",\npanel AS (SELECT bare.*, lagged.* EXCLUDE (session_idx), yields.* EXCLUDE (session_idx) FROM bare JOIN lagged ON lagged.session_idx = bare.session_idx JOIN yields ON yields.session_idx = bare.session_idx)"

    @query("features_macro", f"SELECT * EXCLUDE (ticker) FROM ({A.to_sql(base, macro, digits=4)}) q WHERE ticker = '{B.ROLES['SPY']}'")
    def features_macro(spark, d):
        panel = GS.with_globals(B.brand_panel(spark, d), GS.daily(spark, d))
        return A.evaluate(panel, macro, digits=4).filter(F.col("ticker") == B.ROLES["SPY"]).drop("ticker")

    @query("features_trend_ema")
    def features_trend_ema(spark, d):
        return A.evaluate(I.ema_columns(B.brand_panel(spark, d), catalogue.EMA_SPANS), catalogue.family(catalogue.TREND_EMA, B.ROLES), digits=4)

    @query("features_normalised_all")
    def features_normalised_all(spark, d):
        """date, ticker, feature, value of all families: tickers' features as ranks of the session, global ones as shares of
        their own past, each minus 0.5.  Long, a plan for each family: one plan of all is too deep for the planner."""
        plain = B.brand_panel(spark, d)
        averages = I.ema_columns(plain, catalogue.EMA_SPANS)
        parts = []
        for f, text in catalogue.FAMILIES.items():
            if f == "macro":
                continue
            own = {n: A.where(A.TRADABLE, A.rank(e) - 0.5) for n, e in catalogue.family(text, B.ROLES).items()}
            parts.append(A.evaluate(averages if f == "trend_ema" else plain, own).unpivot(["date", "ticker"], list(own), "feature", "value"))
        series = A.evaluate(GS.with_globals(plain, GS.daily(spark, d)), macro, keep=("session_idx", "date", "ticker")).filter(F.col("ticker") == B.ROLES["SPY"])
        past = I.expanding_pct(series.unpivot("session_idx", list(macro), "key", "value")).select("session_idx", F.col("key").alias("feature"), (F.col("pct") - 0.5).alias("pct"))
        live = plain.select("session_idx", "date", "ticker", "tradable")
        parts.append(live.join(past, "session_idx").select("date", "ticker", "feature", F.when(F.col("tradable"), F.col("pct")).alias("value")))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # -- state -----------------------------------------------------------------------------------------------------
    def returns(spark, d):
        filled = A.fill(A.col("close"), 20)  # brands skip days; an eigenvalue window wants nearly complete columns
        ret = A.where(A.history(A.col("close")) >= B.HISTORY, filled / A.lag(filled, 1) - 1)
        return A.evaluate(B.brand_panel(spark, d, "p_brand"), {"ret": ret}, keep=("session_idx", "ticker"))

    @query("features_pca_state")
    def features_pca_state(spark, d):
        r = returns(spark, d)
        base = ST.state_series(r, 63, 20, "etf").join(ST.state_series(r, 252, 20, "etf"), "session_idx", "left").join(ST.state_series(r, 126, 20, "etf"), "session_idx", "left")
        return ST.tercile(ST.derived_state(base, "etf", 63, 252), "etf_eff_n_63")

    @query("features_pca_factors")
    def features_pca_factors(spark, d):
        f = ST.factor_features(returns(spark, d))
        change = F.col("pc1_loading") - F.lag("pc1_loading", 20).over(Window.partitionBy("ticker").orderBy("session_idx"))
        return f.withColumn("pc1_loading_change_20", change).withColumn("etf_idiosyncratic_share_median", F.median("idiosyncratic_share").over(Window.partitionBy("session_idx")))

    @query("features_pca_stock")
    def features_pca_stock(spark, d):
        close = F.last("close", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("session_idx").rowsBetween(-20, 0))
        dense = B.densify(B.brand_bars(spark, d, "p_name")).select("session_idx", "ticker", close.alias("close"))
        r = dense.select("session_idx", "ticker", (F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("session_idx")) - 1).alias("ret"))
        base = ST.state_series(r, 90, 10, "stock").join(ST.state_series(r, 250, 10, "stock"), "session_idx", "left")
        return ST.tercile(ST.derived_state(base, "stock", 90, 250), "stock_eff_n_90")

    # pairs of tickers whose returns are complete over the window, correlated in every window; six complete tickers at least
    corr_windows = {3: 10, 5: 10, 10: 10, 21: 21}
    trailing = ", ".join(f"""t{m} AS (SELECT session_idx, CASE WHEN n >= 6 THEN c END AS c FROM (SELECT session_idx, avg(c) AS c FROM (SELECT x.session_idx, x.n AS nx, y.n AS ny, corr(x.ret, y.ret) OVER (PARTITION BY x.ticker, y.ticker ORDER BY x.session_idx ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) AS c
  FROM k{m} x JOIN k{m} y ON x.session_idx = y.session_idx AND x.ticker < y.ticker) p WHERE nx = {m} AND ny = {m} GROUP BY 1) a JOIN (SELECT session_idx, count(*) AS n FROM k{m} WHERE n = {m} GROUP BY 1) b USING (session_idx))""" for m in (10, 21))
    known = ", ".join(f"k{m} AS (SELECT session_idx, ticker, ret, count(ret) OVER (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) AS n FROM rets)" for m in (10, 21))
    shown = ", ".join(f"{_r(f'(SELECT c FROM t{m} WHERE t{m}.session_idx = s.session_idx + {m - 1} AND s.session_idx < last - {m})', 6)} AS env_corr_h{h}, {_r(f'(SELECT c FROM t{m} WHERE t{m}.session_idx = s.session_idx - 2 AND s.session_idx >= {m + 2})', 6)} AS past_corr_h{h}" for h, m in corr_windows.items())

    @query("env_correlation", f"""WITH rets AS ({A.to_sql(B.BRAND_SQL, {"ret": P.next_open_return()}, keep=("session_idx", "ticker"))}), {known}, {trailing},
s AS (SELECT DISTINCT session_idx, max(session_idx) OVER () AS last FROM rets) SELECT session_idx, {shown} FROM s""")
    def env_correlation(spark, d):
        found = ST.environment_correlation(A.evaluate(B.brand_panel(spark, d), {"ret": P.next_open_return()}, keep=("session_idx", "ticker")))
        return found.select("session_idx", *[_round(c, 6).alias(c) for c in found.columns if c != "session_idx"])

    # -- benchmarks and controls -----------------------------------------------------------------------------------
    @query("fixed_benchmarks")
    def fixed_benchmarks(spark, d):
        held = C.benchmark_targets(B.brand_panel(spark, d), B.ROLES, 300)
        return S.simulate(held.withColumn("cash_next", F.lit(0.0001)), cost=0.001)

    @query("random_books")
    def random_books(spark, d):
        rows = A.evaluate(B.brand_panel(spark, d), {"r": P.next_open_return(), "ok": A.flag(A.TRADABLE)}, keep=("session_idx", "ticker"))
        panel = rows.select("session_idx", "ticker", (F.col("ok") > 0).alias("tradable"), F.col("r").alias("r_next"), F.lit(0.0001).alias("cash_next"))
        return C.random_books(panel, 300, cost=0.001).groupBy("trial", "draw").agg(F.count("net").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd"))

    split_sql = " ".join(f"WHEN role IN ({', '.join(repr(r) for r in rs)}) THEN 'eq_{n}'" for n, rs in C.EQUITY_SPLIT.items())
    roles_sql = "[" + ", ".join(repr(r) for rs in C.EQUITY_SPLIT.values() for r in rs) + "]"
    # the maker's digit stands for the block, the brand's own number for the role
    @query("group_map", f"""WITH b AS (SELECT DISTINCT p_brand AS ticker, substring(p_brand, 7, 1) AS maker, {roles_sql}[CAST(CAST(substring(p_brand, 7) AS INTEGER) % len({roles_sql}) AS INTEGER) + 1] AS role FROM part),
g AS (SELECT ticker, CASE WHEN maker < '4' THEN CASE {split_sql} END ELSE 'block_' || maker END AS "group" FROM b)
SELECT ticker, "group", CAST(dense_rank() OVER (ORDER BY "group") - 1 AS INTEGER) AS group_idx FROM g""")
    def group_map(spark, d):
        roles = F.array(*[F.lit(r) for rs in C.EQUITY_SPLIT.values() for r in rs])
        parts = table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
        maker = F.substring("ticker", 7, 1)
        block = F.when(maker < "4", "equity").otherwise(F.concat(F.lit("block_"), maker))
        return C.group_map(parts.select("ticker", block.alias("block_name"), F.element_at(roles, (F.substring("ticker", 7, 9).cast("int") % F.size(roles)) + 1).alias("role")))

    def scores(spark, d):
        return A.evaluate(B.brand_panel(spark, d), {"score": A.where(A.TRADABLE, _score())}, keep=("session_idx", "ticker"))

    @query("book_controls")
    def book_controls(spark, d):
        s = scores(spark, d)
        stress = G.stress([A.std(A.cross_mean(catalogue._names()["ret"]), 21)])
        mask = A.evaluate(B.brand_panel(spark, d), {"stress": stress}, keep=("session_idx", "ticker")).groupBy("session_idx").agg(F.max("stress").alias("stress"))
        cases = [("real", s), ("stale", C.stale(s)), ("shuffled 0", C.shuffled(s, 0))]
        out = cases[0][1].withColumn("case", F.lit("real"))
        for name, rows in cases[1:]:
            out = out.unionByName(rows.withColumn("case", F.lit(name)))
        return out.join(C.random_stress(mask, 0).withColumnRenamed("stress", "random_stress"), "session_idx")

    judged = {"p": _score(), "y": P.labels(HORIZON, payoff=None)[f"vol_scaled_h{HORIZON}"]}
    judged_sql = f"j AS ({A.to_sql(B.BRAND_SQL, judged, keep=('session_idx', 'ticker'))})"

    def forecasts(spark, d):
        return A.evaluate(B.brand_panel(spark, d), judged, keep=("session_idx", "ticker")).withColumnRenamed("ticker", "key")

    place = lambda c: f"rank() OVER (PARTITION BY ticker ORDER BY {c}) + (count(*) OVER (PARTITION BY ticker, {c}) - 1) / 2.0"

    @query("spearman", f"""WITH {judged_sql}, k AS (SELECT ticker, {place('p')} AS a, {place('y')} AS b FROM j WHERE p IS NOT NULL AND y IS NOT NULL),
g AS (SELECT ticker, count(*) AS n, CASE WHEN count(*) >= 100 THEN corr(a, b) END AS c FROM k GROUP BY 1)
SELECT ticker AS key, n, {_r('c')} AS spearman, {_r(f'c * sqrt(n / {HORIZON}.0)', 3)} AS t FROM g""")
    def spearman(spark, d):
        return E.spearman(forecasts(spark, d), HORIZON).select("key", "n", _round("spearman").alias("spearman"), _round("t", 3).alias("t"))

    @query("oos_r2", f"""WITH {judged_sql}, b AS (SELECT ticker, p, y, CASE WHEN count(y) OVER w >= 252 THEN avg(y) OVER w END AS base FROM j
  WINDOW w AS (PARTITION BY ticker ORDER BY session_idx ROWS BETWEEN UNBOUNDED PRECEDING AND {P.reach(HORIZON) + 1} PRECEDING))
SELECT ticker AS key, count(*) AS n, {_r('CASE WHEN count(*) >= 100 THEN 1 - sum((y - p) * (y - p)) / sum((y - base) * (y - base)) END')} AS oos_r2 FROM b WHERE p IS NOT NULL AND y IS NOT NULL AND base IS NOT NULL GROUP BY 1""")
    def oos_r2(spark, d):
        return E.oos_r2(forecasts(spark, d), P.reach(HORIZON), 252).select("key", "n", _round("oos_r2").alias("oos_r2"))

    # -- evaluation ------------------------------------------------------------------------------------------------
    def net(sql: str) -> str:
        return f"WITH {TRIALS_SQL} {sql}"

    @query("sim_every_session", net("SELECT trial, CAST(session_idx AS INTEGER) AS session_idx, net FROM trials"))
    def sim_every_session(spark, d):
        return trials(spark, d).select("trial", "session_idx", "net")

    @query("summary", net(f"""SELECT trial, count(net) AS n, {_r('avg(net) / nullif(stddev_samp(net), 0) * sqrt(252)')} AS sharpe, {_r('exp(sum(ln(1 + net)) * 252 / count(net)) - 1')} AS cagr,
{_r('stddev_samp(net) * sqrt(252)')} AS vol, {_r('CAST(count(*) FILTER (net > 0) AS DOUBLE) / nullif(count(*) FILTER (net <> 0), 0)')} AS hit_rate, {_r('kurtosis_pop(net) + 3', 2)} AS kurt FROM trials GROUP BY trial"""))
    def summary(spark, d):
        s = E.summary(trials(spark, d))
        return s.select("trial", "n", _round("sharpe").alias("sharpe"), _round("cagr").alias("cagr"), _round("vol").alias("vol"), _round("hit_rate").alias("hit_rate"), _round("kurt", 2).alias("kurt"))

    @query("max_drawdown", net(f"""SELECT trial, {_r('min(eq / peak - 1)')} AS max_drawdown FROM (SELECT trial, eq, max(eq) OVER (PARTITION BY trial ORDER BY session_idx) AS peak FROM
(SELECT trial, session_idx, product(1 + net) OVER (PARTITION BY trial ORDER BY session_idx) AS eq FROM trials) q) q2 GROUP BY trial"""))
    def max_drawdown(spark, d):
        return E.max_drawdown(trials(spark, d)).select("trial", _round("max_drawdown").alias("max_drawdown"))

    @query("block_sharpes", net(f"""SELECT trial, count(s) AS blocks, {_r('median(s)')} AS median_sharpe, {_r('min(s)')} AS min_sharpe FROM (SELECT trial, session_idx // 252 AS b,
CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252) END AS s FROM trials GROUP BY 1, 2) q GROUP BY trial"""))
    def block_sharpes(spark, d):
        return E.block_sharpes(trials(spark, d)).select("trial", "blocks", _round("median_sharpe").alias("median_sharpe"), _round("min_sharpe").alias("min_sharpe"))

    @query("slice_moments", net(f"""SELECT trial, CAST((16 * (session_idx + 1) - 1) // n_all AS INTEGER) AS slice, {_r('sum(net)')} AS s1, {_r('sum(net * net)')} AS s2, count(*) AS n
FROM trials, (SELECT max(session_idx) + 1 AS n_all FROM trials) q GROUP BY 1, 2"""))
    def slice_moments(spark, d):
        m = E.slice_moments(trials(spark, d))
        return m.select("trial", "slice", _round("s1").alias("s1"), _round("s2").alias("s2"), "n")

    @query("dsr")
    def dsr(spark, d):
        return E.add_deflated_sharpe(E.summary(trials(spark, d))).select("trial", "n", "sharpe", "dsr")

    @query("pbo")
    def pbo(spark, d):
        return E.overfitting(E.slice_moments(trials(spark, d)))

    label = P.labels(HORIZON, payoff=None)[f"vol_scaled_h{HORIZON}"]
    both = A.present(_score()) & A.present(label) & A.TRADABLE
    ranks = {"a": A.rank(_score(), both), "b": A.rank(label, both)}
    ranks_sql = A.to_sql(B.BRAND_SQL, ranks, keep=("session_idx", "ticker"))
    ic_sql = f"ic AS (SELECT session_idx, covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) AS ic, count(*) AS n FROM ({ranks_sql}) q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND stddev_samp(a) > 1e-12 AND stddev_samp(b) > 1e-12)"

    def ics(spark, d):
        return E.daily_ic(A.evaluate(B.brand_panel(spark, d), ranks, keep=("session_idx", "ticker")))

    @query("daily_ic", f"WITH {ic_sql} SELECT session_idx, {_r('ic')} AS ic, n FROM ic")
    def daily_ic(spark, d):
        return ics(spark, d).select("session_idx", _round("ic").alias("ic"), "n")

    @query("ic_summary", f"WITH {ic_sql} SELECT count(ic) AS sessions, {_r('avg(ic)')} AS mean_ic, {_r(f'avg(ic) / stddev_samp(ic) * sqrt(count(ic) / CAST({HORIZON} AS DOUBLE))')} AS t_ic FROM ic")
    def ic_summary(spark, d):
        return E.ic_summary(ics(spark, d), HORIZON).select("sessions", _round("mean_ic").alias("mean_ic"), _round("t_ic").alias("t_ic"))

    @query("medians_by_choice", f"""SELECT 'segment' AS choice, c_mktsegment AS value, {_r('median(c_acctbal)')} AS median, count(*) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), {_r('median(c_acctbal)')}, count(*) FROM customer GROUP BY 2""")
    def medians_by_choice(spark, d):
        c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "c_acctbal")
        return E.medians(c, "c_acctbal", "segment", "nation").select("choice", "value", _round("median").alias("median"), "n")

    @query("control_percentiles", f"SELECT c_mktsegment, {_r('quantile_cont(c_acctbal, 0.05)', 2)} AS p05, {_r('quantile_cont(c_acctbal, 0.5)', 2)} AS p50, {_r('quantile_cont(c_acctbal, 0.95)', 2)} AS p95 FROM customer GROUP BY 1")
    def control_percentiles(spark, d):
        return E.percentiles(table(spark, d, "customer"), "c_acctbal", "c_mktsegment").select("c_mktsegment", *[_round(p, 2).alias(p) for p in ("p05", "p50", "p95")])

    @query("ic_pivot", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
    def ic_pivot(spark, d):
        p = table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count("c_custkey"))
        return p.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))

    @query("ic_pivot_all")
    def ic_pivot_all(spark, d):
        """ic_pivot over all segments, customers without one included; a column for each."""
        c = table(spark, d, "customer").withColumn("_segment", F.lower(F.coalesce("c_mktsegment", F.lit("none"))))
        found = sorted(r["_segment"] for r in c.select("_segment").distinct().collect())
        p = c.groupBy("c_nationkey").pivot("_segment", found).agg(F.count("c_custkey"))
        return p.select("c_nationkey", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in found])

    # -- simulation ------------------------------------------------------------------------------------------------
    def targets(spark, d):
        held = A.evaluate(B.brand_panel(spark, d), _books(), keep=("session_idx", "ticker"))
        long = held.unpivot(["session_idx", "ticker", "r"], [f"w{i}" for i in range(1, 6)], "trial", "target")
        return long.withColumnRenamed("r", "r_next").withColumn("rebalance", S.rebalance_every(300, 5)).withColumn("cash_next", F.lit(0.0001))

    @query("sim_band")
    def sim_band(spark, d):
        return S.simulate(targets(spark, d), band=0.02, cost=0.001)

    @query("sim_levered")
    def sim_levered(spark, d):
        return S.simulate(targets(spark, d).withColumn("target", F.col("target") * 1.5), levered=True, spread=0.0001, cost=0.001)

    run_queries.register_walkforwards(query, sessions_of)
    G.register(query, B, A, _r, _round)
    run_queries.register(query, trials, TRIALS_SQL, B.BRAND_SQL, _r, _round)
