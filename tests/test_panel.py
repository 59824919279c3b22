"""Panel operators against pandas, hand-made books and small examples."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import catalogue
from loomspan.operators import controls as C
from loomspan.operators import evaluation as E
from loomspan.operators import ingest as I
from loomspan.operators import models as M
from loomspan.operators import panel_ops as P
from loomspan.operators import simulation as S
from loomspan.operators import state as ST
from loomspan.plans import algebra as A
from loomspan.sources.brand_panel import ROLES


def make_panel(n=140, tickers=("A", "B", "C", "D"), seed=7, gaps=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for k in tickers:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            hole = rng.random() < gaps
            c = None if hole else round(float(close[i]), 2)
            rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i), k, k if k < "C" else "Z", *([None] * 6 if hole else [c * 0.99, c * 1.02, c * 0.97, c, float(rng.integers(100, 999)), c * 300]), not hole))
    return pd.DataFrame(rows, columns=["session_idx", "date", "ticker", "asset_group", "open", "high", "low", "close", "volume", "adv", "tradable"])


@pytest.fixture(scope="module")
def panel(spark):
    pdf = make_panel()
    schema = "session_idx int, date date, ticker string, asset_group string, open double, high double, low double, close double, volume double, adv double, tradable boolean"
    rows = [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, schema).cache()


def wide(df, name="v"):
    return df.toPandas().pivot(index="session_idx", columns="ticker", values=name)


def run(panel, e):
    return wide(A.evaluate(panel[1], {"v": e}, keep=("session_idx", "ticker")))


def same(a, b):
    np.testing.assert_allclose(a.to_numpy(dtype=float), b.reindex(index=a.index, columns=a.columns).to_numpy(dtype=float), rtol=1e-8, atol=1e-10, equal_nan=True)


CLOSE = A.col("close")
RET = CLOSE / A.lag(CLOSE, 1) - 1


@pytest.mark.parametrize(
    ("name", "expr", "parity"),
    [
        ("mean", A.mean(CLOSE, 10), lambda c: c.rolling(10, min_periods=8).mean()),
        ("std", A.std(CLOSE, 10), lambda c: c.rolling(10, min_periods=8).std()),
        ("sum", A.total(CLOSE, 7), lambda c: c.rolling(7, min_periods=6).sum()),
        ("min", A.low_of(CLOSE, 10), lambda c: c.rolling(10, min_periods=8).min()),
        ("skew", A.skew(CLOSE, 20), lambda c: c.rolling(20, min_periods=16).skew()),
        ("kurt", A.kurt(CLOSE, 20), lambda c: c.rolling(20, min_periods=16).kurt()),
        ("quantile", A.quantile(CLOSE, 20, 0.05), lambda c: c.rolling(20, min_periods=16).quantile(0.05)),
        ("fill", A.fill(CLOSE, 2), lambda c: c.ffill(limit=2)),
        ("ret", RET, lambda c: c / c.shift(1) - 1),
        ("lead", A.lead(CLOSE, 3), lambda c: c.shift(-3)),
    ],
)
def test_time_operators_match_pandas(panel, name, expr, parity):
    c = panel[0].pivot(index="session_idx", columns="ticker", values="close").astype(float)
    same(run(panel, expr), parity(c))


def test_cross_rank_and_single_ticker(panel):
    c = panel[0].pivot(index="session_idx", columns="ticker", values="close").astype(float)
    n = c.notna().sum(axis=1)
    expected = (c.rank(axis=1) - 1).div((n - 1).where(n > 1), axis=0)
    same(run(panel, A.rank(CLOSE)), expected)


def test_ranks_are_the_windows_of_sql_on_odd_values(spark):
    values = [1.0, 1.0, 0.0, -0.0, float("nan"), float("nan"), None, None, -3.0, 1e300, float("-inf"), float("inf")]
    rng = np.random.default_rng(3)
    rows = [(s, t, rng.choice(values), float(rng.integers(3))) for s in range(40) for t in [*[f"t{i:02}" for i in range(s % 13 + 1)], *([None] if s % 3 == 0 else [])]]
    rows += [(40, f"u{i}", None, 1.0) for i in range(30)]
    df = spark.createDataFrame([(s, t, None if v is None else float(v), w) for s, t, v, w in rows], "session_idx int, ticker string, a double, b double").repartition(3)
    outputs = {f"{op}_{c}": A.Expr(op, A.col(c)) for op in ("crank", "crow", "ccount") for c in ("a", "b")}
    emit = A.Emitter("spark")
    expected = df.selectExpr("session_idx", "ticker", *[f"{emit.text(e)} AS {n}" for n, e in outputs.items()])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):  # sessions that end inside batches and go over several of them
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = A.evaluate(df, outputs, keep=("session_idx", "ticker"))
            assert got.dtypes == expected.dtypes
            key = lambda r: (r[0], r[1] or "")
            assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert A.evaluate(df.limit(0), outputs, keep=("session_idx", "ticker")).count() == 0


def test_many_ranks_sort_the_panel_as_often_as_one(panel):
    """Each sort takes a page of memory of its task, so it must not be one for each rank."""
    plan = lambda n: A.evaluate(panel[1], {f"r{i}": A.rank(CLOSE * (i + 1.0)) for i in range(n)} | {"p": P.ordinal_pct(CLOSE)}, keep=("session_idx", "ticker"))._jdf.queryExecution().executedPlan().toString()
    sorts = [sum(line.lstrip(" :+-*()0123456789").startswith("Sort ") for line in plan(n).splitlines()) for n in (1, 30)]
    assert sorts[0] == sorts[1] <= 2


def test_rank_past_excludes_the_current_session(panel):
    c = panel[0].pivot(index="session_idx", columns="ticker", values="close").astype(float)
    expected = pd.DataFrame(np.nan, index=c.index, columns=c.columns)
    for k in c:
        for t in range(len(c)):
            past = c[k].iloc[max(0, t - 20) : t].dropna()
            if len(past) >= 10 and c[k].iloc[t] == c[k].iloc[t]:
                expected.loc[t, k] = ((past < c[k].iloc[t]).sum() + 0.5 * (past == c[k].iloc[t]).sum()) / len(past)
    same(run(panel, A.rank_past(CLOSE, 20, 10)), expected)


def test_run_length_and_missing(panel):
    c = panel[0].pivot(index="session_idx", columns="ticker", values="close").astype(float)
    up = (c / c.shift(1) - 1) > 0
    expected = up.apply(lambda s: s.astype(int).groupby((~s).cumsum()).cumsum())
    same(run(panel, A.run(RET > 0)), expected.astype(float))


def test_ema_matches_pandas_with_gaps(panel):
    c = panel[0].pivot(index="session_idx", columns="ticker", values="close").astype(float)
    got = wide(I.ema_columns(panel[1], (5, 12, 26)), "ema_12")
    same(got, c.ewm(span=12, adjust=False, min_periods=12).mean())


def test_future_does_not_move_the_past(spark, panel):
    changed = panel[1].withColumn("close", F.when(F.col("session_idx") > 100, F.col("close") * 3).otherwise(F.col("close")))
    features = {n: e for f in ("momentum", "drawdown", "gaps") for n, e in catalogue.family(catalogue.FAMILIES[f], {**ROLES, "SPY": "A"}).items()}
    keep = ("session_idx", "ticker")
    a = A.evaluate(panel[1], features, keep=keep).filter("session_idx <= 100")
    b = A.evaluate(changed, features, keep=keep).filter("session_idx <= 100")
    pd.testing.assert_frame_equal(a.orderBy(*keep).toPandas(), b.orderBy(*keep).toPandas())


def test_catalogue_has_all_families():
    sizes = {n: len(catalogue.family(t, ROLES)) for n, t in catalogue.FAMILIES.items()}
    assert sizes == {"momentum": 35, "volatility": 30, "drawdown": 16, "trend": 21, "trend_ema": 6, "candles": 27, "gaps": 14, "compression": 13, "volume": 22, "relative": 24, "screeners": 17, "macro": 29}


def test_label_alignment_and_reach(panel):
    o = panel[0].pivot(index="session_idx", columns="ticker", values="open").astype(float)
    out = A.evaluate(panel[1], P.labels(3, payoff=None), keep=("session_idx", "ticker"))
    r = o.shift(-4) / o.shift(-1) - 1
    vol = (o / o.shift(1) - 1).rolling(5, min_periods=5).std().shift(-6)
    tradable = panel[0].pivot(index="session_idx", columns="ticker", values="tradable")
    same(wide(out, "vol_scaled_h3"), (r / (vol.clip(lower=0.003) * np.sqrt(3))).where(tradable & vol.notna()))
    assert P.reach(3) == 6 and P.reach(21) == 22


def test_banded_book_by_hand():
    target = np.array([[0.5, 0.0], [0.6, 0.0], [0.0, 1.0]])
    r = np.array([[0.1, 0.0], [0.0, 0.0], [0.0, 0.2]])
    gross, turnover = S.fold_banded(target, np.array([True, True, True]), r, np.zeros(3), 0.2, True)
    drifted = 0.5 * 1.1 / 1.05
    np.testing.assert_allclose(gross, [0.05, 0.0, 0.2])
    np.testing.assert_allclose(turnover, [0.5, 0.0, drifted + 1.0])


def test_levered_book_pays_the_spread():
    gross, turnover = S.fold_levered(np.array([[1.5]]), np.array([True]), np.array([[0.01]]), np.array([0.001]), 0.0005)
    np.testing.assert_allclose(gross, [1.5 * 0.01 - 0.5 * 0.0015])
    np.testing.assert_allclose(turnover, [1.5])


def test_simulate_groups_by_trial(spark):
    rows = [("t", i, k, 0.5, 0.01 * (k == "A"), i == 0, 0.0) for i in range(3) for k in "AB"]
    out = S.simulate(spark.createDataFrame(rows, "trial string, session_idx int, ticker string, target double, r_next double, rebalance boolean, cash_next double"), cost=0.1).orderBy("session_idx").toPandas()
    np.testing.assert_allclose(out["net"].iloc[0], 0.005 - 0.1)
    assert out["turnover"].tolist()[1:] == [0.0, 0.0]


def test_overfitting_of_noise_and_of_skill(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{k}", i, float(rng.normal(0.01 if k == 0 else 0, 0.01))) for k in range(6) for i in range(160)]
    trials = spark.createDataFrame(rows, "trial string, session_idx int, net double")
    out = E.overfitting(E.slice_moments(trials)).first()
    assert out["n_splits"] == 12870 and out["pbo"] < 0.05
    d = E.add_deflated_sharpe(E.summary(trials)).toPandas().set_index("trial")["dsr"]
    assert d["t0"] > 0.99 and d.drop("t0").max() < 0.9


def test_as_of_takes_the_last_published(spark):
    d = dt.date
    sessions = spark.createDataFrame([(d(2020, 1, i),) for i in (1, 3, 5)], "date date")
    facts = spark.createDataFrame([("x", d(2020, 1, 1), d(2020, 1, 2), 1.0), ("x", d(2020, 1, 2), d(2020, 1, 4), 2.0), ("x", d(2020, 1, 3), d(2020, 1, 4), None)], "key string, date date, available_at date, value double")
    got = {r["date"].day: r["value"] for r in I.as_of(sessions, facts, "key").collect()}
    assert got == {1: None, 3: 1.0, 5: 2.0}


def test_fence(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2020, 12, 31), 1), (d(2021, 1, 1), 2)], "date date, x int")
    with pytest.raises(I.FenceError):
        I.check_fence(df, "2021-01-01")
    with pytest.raises(I.FenceError):
        I.check_fence(spark.createDataFrame([(None, 1)], "date date, x int"), "2021-01-01")
    assert I.check_fence(df, "2021-01-02") is df


def test_resolve_needs_an_instrument(spark):
    universe = spark.createDataFrame([("A",), ("B",)], "ticker string")
    instruments = spark.createDataFrame([("A", "u1", "etf", 1), ("A", "u2", "etf", 2), ("B", "u3", "stock", 1)], "ticker string, instrument_uid string, asset string, valid_to int")
    with pytest.raises(ValueError, match="B"):
        I.resolve(universe, instruments, "etf")
    assert I.resolve(universe.filter("ticker = 'A'"), instruments, "etf").first()["instrument_uid"] == "u2"


def test_ridge_from_sums_is_the_ridge_of_the_rows():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 5)), rng.normal(size=(300, 2))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = 1.0
    parts = [M.reduce_rows(x[a:b], y[a:b]) for a, b in ((0, 120), (120, 130), (130, 300))]
    w, centre, base = M.solve({f: sum(p[f] for p in parts) for f in parts[0]}, 0.5)
    spread = np.nanstd(x, axis=0)
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.where(spread > 1e-9, spread, 1))
    b = np.linalg.solve(z.T @ z / 300 + 0.5 * np.eye(5), z.T @ (y - y.mean(0)) / 300)
    np.testing.assert_allclose(np.nan_to_num(x - centre) @ w + base, z @ b + y.mean(0), atol=1e-10)


def test_drawdown_of_a_book_that_loses_everything(spark):
    nets = {"gone": [0.1, -1.0, 0.5], "below": [0.2, -1.5, 0.1], "plain": [0.1, -0.2, 0.3]}
    rows = [(n, i, r) for n, rs in nets.items() for i, r in enumerate(rs)]
    got = {r["trial"]: r["max_drawdown"] for r in E.max_drawdown(spark.createDataFrame(rows, "trial string, session_idx int, net double")).collect()}
    for n, rs in nets.items():
        eq = np.cumprod(1 + np.array(rs))
        assert got[n] == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min())


def test_expanding_mid_ranks():
    v = np.random.default_rng(1).integers(0, 9, 300).astype(float)
    rank, before = I.mid_ranks(v)
    assert all(rank[i] == (v[:i] < v[i]).sum() + 0.5 * (v[:i] == v[i]).sum() and before[i] == i for i in range(300))


def test_ledger_upsert_replaces_runs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, x int")
    new = spark.createDataFrame([("b", 3), ("b", 4)], "run_id string, x int")
    assert sorted(tuple(r) for r in I.upsert_runs(old, new).collect()) == [("a", 1), ("b", 3), ("b", 4)]


def test_bins_and_rules(panel):
    pct = P.ordinal_pct(CLOSE)
    w = A.evaluate(panel[1], {n: r(pct, P.to_bins(pct), P.time_bins(CLOSE, 20)) for n, r in {k.replace(".", "_"): v for k, v in P.rules().items()}.items()}, keep=("session_idx", "ticker")).toPandas()
    sums = w.groupby("session_idx").sum(numeric_only=True)
    for c in [c for c in sums if c.startswith(("top_bins", "score", "ts_gate"))]:
        assert sums[c].max() <= 1 + 1e-9
    assert sums["long_short_top_bins1"].abs().max() < 1e-9
    assert w["score_capped_max_weight0_15_max_block0_4"].max() <= 0.15 + 1e-12


def test_fixed_benchmarks_and_random_books(panel):
    out = C.benchmark_targets(panel[1], {"SPY": "A", "IEF": "B"}, 35).toPandas()
    assert sorted(set(out["trial"])) == sorted(C.REBALANCE)
    w = {n: g.pivot(index="session_idx", columns="ticker", values="target") for n, g in out.groupby("trial")}
    on = panel[0].pivot(index="session_idx", columns="ticker", values="tradable")
    np.testing.assert_allclose(w["ew_monthly"], on.div(on.sum(axis=1).clip(lower=1), axis=0).astype(float))
    close = panel[0].pivot(index="session_idx", columns="ticker", values="close")
    best = (close / close.shift(126) - 1).where(on)
    for t, row in best.dropna(how="all").iterrows():
        assert w["mom_6_3"].loc[t].idxmax() == row.idxmax() and w["mom_6_3"].loc[t].sum() == 1
    assert (w["spy_ief_60_40"].sum(axis=1).round(9) == 1).all() and (w["spy"]["A"] == 1).all()
    reb = out[out["ticker"] == "A"].groupby("trial").apply(lambda g: sorted(g.loc[g["rebalance"], "session_idx"]), include_groups=False)
    assert reb["spy"] == [35] and reb["ew_monthly"] == [60, 91, 121] and reb["mom_6_3"] == [35, 98]
    rng = np.random.default_rng(3)
    tradable, r, cash = rng.random((50, 6)) > 0.1, rng.normal(0, 0.02, (50, 6)), np.full(50, 1e-4)
    gross, turnover = C.fold_random(tradable, r, cash, 0.3, 5, 10, 4, (1,))
    again, mask, target = np.random.default_rng((1,)), np.zeros(50, dtype=bool), np.zeros((4, 50, 6))
    for t in range(10, 50, 5):
        mask[t], target[:, t] = True, C.random_target(again.random((4, 6)), tradable[t], 0.3)
    for k in range(4):
        g, v = S.fold_banded(target[k], mask, r, cash, 0.0, True)
        np.testing.assert_allclose((gross[k], turnover[k]), (g, v), atol=1e-12)


def test_groups_and_book_controls(spark):
    rows = [("A", "equity", "value"), ("B", "equity", "sector"), ("C", "bonds", None), ("SHY", "bonds", None)]
    got = {r["ticker"]: (r["group"], r["group_idx"]) for r in C.group_map(spark.createDataFrame(rows, "ticker string, block_name string, role string")).collect()}
    assert got == {"A": ("eq_broad", 1), "B": ("eq_sector", 2), "C": ("bonds", 0), "SHY": (None, -1)}
    with pytest.raises(Exception, match="does not name the role"):
        C.group_map(spark.createDataFrame([("A", "equity", "odd")], "ticker string, block_name string, role string")).collect()
    rows = [(t, k, None if (t + ord(k)) % 5 == 0 else float(t * 100 + ord(k))) for t in range(200) for k in "ABCDEF"]
    s = spark.createDataFrame(rows, "session_idx int, ticker string, score double")
    a, b = wide(s, "score"), wide(C.shuffled(s, 1), "score")
    assert (a.isna() == b.isna()).all().all() and not a.equals(b) and all(sorted(a.loc[t].dropna()) == sorted(b.loc[t].dropna()) for t in a.index)
    assert wide(C.stale(s, 126), "score").equals(a.shift(126))
    mask = C.random_stress(spark.createDataFrame([(t, float(t % 4 == 0)) for t in range(2100)], "session_idx int, stress double"), 0).toPandas().sort_values("session_idx")
    assert mask.groupby(mask["session_idx"] // 21)["stress"].nunique().max() == 1 and 0.1 < mask["stress"].mean() < 0.4


def test_rank_correlation_r2_and_pair_correlation(spark):
    rng = np.random.default_rng(5)
    p, y = rng.integers(0, 20, 300).astype(float), rng.normal(size=300)
    f = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "key string, session_idx int, p double, y double")
    c = pd.Series(p).rank().corr(pd.Series(y).rank())
    got = E.spearman(f, 5).first()
    np.testing.assert_allclose((got["spearman"], got["t"]), (c, c * np.sqrt(60)))
    base = pd.Series(y).shift(7).expanding(50).mean().to_numpy()
    ok = np.isfinite(base)
    np.testing.assert_allclose(E.oos_r2(f, 6, 50).first()["oos_r2"], 1 - ((y - p)[ok] ** 2).sum() / ((y - base)[ok] ** 2).sum())
    x = rng.normal(size=(300, 7))
    x[40, 2] = np.nan
    r = spark.createDataFrame([(i, str(k), None if x[i, k] != x[i, k] else float(x[i, k])) for i in range(300) for k in range(7)], "session_idx int, ticker string, ret double")
    got = ST.environment_correlation(r).toPandas().set_index("session_idx").sort_index()
    for t in (0, 35, 120, 270):
        z = x[t : t + 21][:, np.isfinite(x[t : t + 21]).all(axis=0)]
        m = np.corrcoef(z, rowvar=False)
        np.testing.assert_allclose(got.loc[t, "env_corr_h21"], (m.sum() - len(m)) / (len(m) * (len(m) - 1)))
    assert got["env_corr_h21"].last_valid_index() == 300 - 21 - 2 and got["env_corr_h3"].equals(got["env_corr_h10"])


def test_wide_queries_cover_all_segments(spark, tmp_path):
    from loomspan.plans import registry

    rows = [(i, i % 3, ["BUILDING", "MACHINERY", "HOUSEHOLD", None][i % 4]) for i in range(50)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    out = registry.queries()["ic_pivot_all"](spark, str(tmp_path)).toPandas().set_index("c_nationkey")
    assert list(out) == ["building", "household", "machinery", "none"] and out.to_numpy().sum() == 50


def test_bars_are_summed_up_by_hash_and_read_once(spark, tmp_path):
    """Bars as by a minimum over whole keys, with tied, null and repeated ones; no task sorts all line items, sessions and panel don't read them again."""
    from pyspark.sql import functions as F

    from loomspan.sources import brand_panel as B

    days = ["1995-01-02", "1995-01-03", None]
    rows = [(o, n, p, s, float(1 + o % 7), float(900 + 13 * p + 7 * s + n), days[o % 3]) for o in range(1, 40) for n in (1, 2) for p in (1, 2, 9) for s in (1, 5)]
    rows += [(None, 1, 2, 3, 2.0, 500.0, days[0]), (39, 2, 9, 7, 4.0, None, days[0]), *rows[:5]]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string")
    parts = spark.createDataFrame([(1, "Brand#11"), (2, "Brand#12"), (9, "Brand#19")], "p_partkey long, p_brand string")
    for name, frame in (("lineitem", lines), ("part", parts)):
        frame.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")

    ticker = F.expr(f"concat('T', CAST(CAST(substring(p_brand, 7) AS INT) % {B.TICKERS} AS STRING))")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumns({"date": F.to_date("l_shipdate"), "ticker": ticker, "price": 100 + F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")) / 10, "at": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")})
    plain = joined.groupBy("date", "ticker").agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("l_quantity").alias("volume"))
    bars = B.brand_bars(spark, str(tmp_path))
    assert sorted(map(repr, bars.collect())) == sorted(map(repr, plain.collect()))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    sums = plan(B.bar_sums(spark, str(tmp_path)))
    assert "HashAggregate" in sums and "SortAggregate" not in sums and "Broadcast" not in sums and "SortMergeJoin" not in sums
    for df in (bars, B.densify(bars), B._brand_panel(spark, str(tmp_path), None)):
        assert "lineitem.parquet" not in plan(df)
