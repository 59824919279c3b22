"""The trial grid, books, snapshot tables and artefacts of a run."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import keeping
from loomspan.functions.settings import SettingsError
from loomspan.operators import artefacts as R
from loomspan.operators import book as K
from loomspan.operators import controls as C
from loomspan.operators import evaluation as E
from loomspan.operators import grid as G
from loomspan.operators import ingest as I
from loomspan.operators import panel_ops as P
from loomspan.operators import simulation as S
from loomspan.plans import algebra as A
from loomspan.sources import snapshot as X

TICKERS = ["A", "B", "C", "D", "E", "F"]
BLOCKS = (("2020-01-01", "2020-04-30"), ("2020-05-01", "2020-12-31"))


def cells(n=160, seed=3):
    """A dense panel of sessions x tickers with a score, holes in both."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, k in itertools.product(range(n), TICKERS):
        live = bool(rng.random() > 0.1)
        rows.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=i), k, "xyz"[TICKERS.index(k) % 3], live, live and k != "F", k in "DE", float(rng.normal(0, 0.02)), 0.0001, 0.0002, float(i % 7 == 0), float(np.round(rng.normal(), 1)) if rng.random() > 0.05 else None))
    names = "session_idx date ticker asset_group tradable eligible defensive r_next cash_next ew_net stress score".split()
    return pd.DataFrame(rows, columns=names)


@pytest.fixture(scope="module")
def panel(spark):
    schema = "session_idx int, date date, ticker string, asset_group string, tradable boolean, eligible boolean, defensive boolean, r_next double, cash_next double, ew_net double, stress double, score double"
    pdf = cells()
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, schema).cache()


def square(pdf, name):
    return pdf.pivot(index="session_idx", columns="ticker", values=name).to_numpy()


def test_rules_agree_with_the_panel_expressions(panel):
    pdf, df = panel
    bars = df.withColumn("close", F.col("score")).withColumn("adv", F.lit(1.0))
    x = A.col("close")
    outputs = {label: rule(P.ordinal_pct(x), P.to_bins(P.ordinal_pct(x)), P.time_bins(x)) for label, rule in P.rules().items()}
    names = {label: f"w{i}" for i, label in enumerate(outputs)}
    got = A.evaluate(bars, {names[label]: e for label, e in outputs.items()}, keep=("session_idx", "ticker")).toPandas()
    mine = G.rule_weights(square(pdf, "score").astype(float), square(pdf, "tradable").astype(bool), np.array([g for g in pdf["asset_group"][: len(TICKERS)]]))
    assert list(mine) == list(outputs)
    for label, (w, _) in mine.items():
        np.testing.assert_allclose(w, np.nan_to_num(square(got, names[label]).astype(float)), atol=1e-12, err_msg=label)


def test_fold_trials_is_the_fold_of_each():
    rng = np.random.default_rng(0)
    target, r, cash = rng.random((60, 4)) * (rng.random((60, 4)) > 0.3), rng.normal(0, 0.03, (60, 4)), np.full(60, 0.0002)
    choices = [(e, b) for e in (1, 5, 7) for b in (0.0, 0.1)]
    clocks = np.stack([(np.arange(60) >= 3) & ((np.arange(60) - 3) % e == 0) for e, _ in choices])
    for use_cash in (True, False):
        gross, turnover = G.fold_trials(target, clocks, np.array([b for _, b in choices]), r, cash, use_cash)
        for i, (_, b) in enumerate(choices):
            one, cost = S.fold_banded(target, clocks[i], r, cash, b, use_cash)
            np.testing.assert_allclose(gross[i], one, atol=1e-12)
            np.testing.assert_allclose(turnover[i], cost, atol=1e-12)


def test_measures_agree_with_the_aggregates(spark):
    rng = np.random.default_rng(1)
    net = rng.normal(0, 0.02, (3, 200))
    net[1, 50] = -1.2  # loses more than everything
    net[2] = 0.0
    rows = [(str(k), i, float(net[k, i])) for k in range(3) for i in range(200)]
    trials = spark.createDataFrame(rows, "trial string, session_idx int, net double")
    want = E.summary(trials).join(E.max_drawdown(trials), "trial").toPandas().set_index("trial").sort_index().astype(float)
    got = pd.DataFrame({k: v for k, v in G.measures(net, np.zeros_like(net), []).items()})
    for c in ("n", "sharpe", "cagr", "vol", "max_drawdown", "hit_rate"):
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-12, equal_nan=True, err_msg=c)
    np.testing.assert_allclose(got["kurt"][:2], want["kurt"][:2], rtol=1e-9)


def test_overfitting_is_brute_force(spark):
    rng = np.random.default_rng(5)
    net = rng.normal(0, 0.01, (7, 48))
    net[3] = net[2]  # a tie
    rows = [(f"t{k}", i, float(net[k, i])) for k in range(7) for i in range(48)]
    trials = spark.createDataFrame(rows, "trial string, session_idx int, net double").repartition(3, "trial")
    got = E.overfitting(E.slice_moments(trials, 6)).first()
    parts, low = net.reshape(7, 6, 8), 0
    sharpe = lambda x: x.mean(axis=1) / x.std(axis=1, ddof=1)
    splits = list(itertools.combinations(range(6), 3))
    for chosen in splits:
        rest = [k for k in range(6) if k not in chosen]
        inside, outside = sharpe(parts[:, chosen].reshape(7, -1)), sharpe(parts[:, rest].reshape(7, -1))
        best = int(np.argmax(np.round(inside, 12)))
        rank = pd.Series(np.round(outside, 12)).rank()[best]
        low += rank / 8 <= 0.5
    assert got["n_splits"] == len(splits)
    assert got["pbo"] == pytest.approx(low / len(splits))


@pytest.fixture(scope="module")
def trials(panel):
    _, df = panel
    at = df.select("session_idx", "ticker", F.col("score").alias("pred"), F.col("r_next").alias("label"))
    named = [at.select(F.lit(m).alias("model"), F.lit("w").alias("window"), F.lit("rank").alias("variant"), F.lit(h).alias("h"), "*") for m, h in (("m1", 3), ("m1", 5), ("m2", 5))]
    empty = at.select(F.lit("m3").alias("model"), F.lit("w").alias("window"), F.lit("rank").alias("variant"), F.lit(3).alias("h"), "session_idx", "ticker", F.lit(None).cast("double").alias("pred"), "label")
    series = named[0].unionByName(named[1]).unionByName(named[2]).unionByName(empty)
    return G.run_grid(series, df, 70, 150, BLOCKS, "r1").cache()


def test_grid(panel, trials):
    pdf, _ = panel
    rows = trials.toPandas()
    assert len(rows) == 11 * 2 * (5 + 4 + 4)  # rules x bands x intervals; the series without predictions has none
    assert rows["trial_id"].is_unique and rows["trial_id"].str.startswith("r1:").all()
    assert (rows["n"] == 80).all() and rows["net"].map(len).eq(80).all()
    assert rows.drop(columns=["net", "s1", "s2", "slice_n"]).notna().any().all()
    one = rows[(rows.h == 5) & (rows.model == "m1") & (rows.rule == "score_capped_max_weight0.15_max_block0.4") & (rows.rebalance_every == 21) & (rows.no_trade_band == 0.02)].iloc[0]
    w, _ = G.rule_weights(square(pdf, "score").astype(float), square(pdf, "tradable").astype(bool), pdf["asset_group"][: len(TICKERS)].to_numpy().astype(str))[one.rule]
    at = np.arange(160)
    gross, turnover = S.fold_banded(w, (at >= 70) & ((at - 70) % 21 == 0), square(pdf, "r_next"), np.full(160, 0.0001), 0.02, True)
    net = (gross - turnover * 5e-4)[70:150]
    np.testing.assert_allclose(one.net, net, atol=1e-7)
    assert one.sharpe == pytest.approx(net.mean() / net.std(ddof=1) * math.sqrt(252))
    assert one.sharpe_cost20 < one.sharpe_cost10 < one.sharpe
    assert np.sum(one.s1) == pytest.approx(net.sum()) and np.sum(one.slice_n) == 80
    blocks = [net[: 121 - 70], net[121 - 70 :]]  # sessions up to the last of April, and from May on
    sharpes = [b.mean() / b.std(ddof=1) * math.sqrt(252) for b in blocks]
    assert one.min_block_sharpe == pytest.approx(min(sharpes)) and one.median_block_sharpe == pytest.approx(np.median(sharpes))


def test_read_off_the_grid(spark, trials):
    ledger = spark.createDataFrame([("r0",)] * 1000 + [("r1",)] * 5, "run_id string")
    deflated = G.deflate(trials, ledger, "r1").toPandas()
    assert (deflated["dsr_all_runs_trials"] - deflated["dsr_trials"]).eq(1000).all()
    known = deflated.dropna(subset=["dsr"])
    assert len(known) and (known["dsr_all_runs"] <= known["dsr"] + 1e-12).all()
    assert 0 <= E.overfitting(G.moments(trials)).first()["pbo"] <= 1
    best = G.top(trials, n=4).toPandas()
    assert len(best) == 4 and best["median_block_sharpe"].iloc[0] == trials.agg(F.max("median_block_sharpe")).first()[0]
    again = trials.withColumn("trial_id", F.lit("new"))
    chosen = G.top(trials, n=2)
    assert sorted(r["trial_id"] for r in G.confirm(again, chosen).collect()) == sorted(r["trial_id"] for r in chosen.collect())
    assert G.prediction_series(trials).count() == 3
    assert G.rebalance_choices(5) == [1, 5, 10, 21] and G.rebalance_choices(3) == [1, 5, 10, 21, 3]


def test_percentiles_and_sources(spark):
    rows = [(0, "A", 3.0, True), (0, "B", 1.0, True), (0, "C", 1.0, True), (0, "D", 9.0, False), (1, "A", 5.0, True), (1, "B", None, True), (2, "A", None, True)]
    df = spark.createDataFrame(rows, "session_idx int, ticker string, score double, eligible boolean")
    got = {(r["session_idx"], r["ticker"]): r["score"] for r in K.ranked_among(df, df).collect()}
    assert got == {(0, "A"): 1.0, (0, "B"): 0.25, (0, "C"): 0.25, (0, "D"): None, (1, "A"): 0.0, (1, "B"): None, (2, "A"): None}
    members = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "y"), ("D", None)], "ticker string, group string")
    score = spark.createDataFrame([(0, "x", 0.2), (0, "y", 0.9)], "session_idx int, group string, score double")
    got = {r["ticker"]: r["score"] for r in K.groups_source(score, members, df).filter("session_idx = 0").collect()}
    assert got == {"A": 0.0, "B": 0.75, "C": 0.75, "D": None}
    mean = K.mean_of([df.select("session_idx", "ticker", "score"), df.select("session_idx", "ticker", (F.col("score") + 1).alias("score"))])
    assert {r["score"] for r in mean.filter("session_idx = 0 and ticker = 'A'").collect()} == {3.5}


def test_books_and_controls(panel):
    pdf, df = panel
    ok = df.select("session_idx", "ticker", "eligible")
    raw = df.select("session_idx", "ticker", "score")
    scores = K.ranked_among(raw, ok)
    grid = K.book_grid(scores.withColumn("source", F.lit("s")), df, 20, None, BLOCKS).toPandas()
    assert len(grid) == 3 * 2 * 2 * 2 and grid["dsr_trials"].eq(24).all() and grid["sharpe_excess"].notna().all()
    controls = K.controls(scores, df, 20, None, BLOCKS, draws=3).toPandas().set_index("case")
    assert len(controls) == 4 + 3 + 3 and set(controls["family"]) == {"real", "real, stress cost", "real, switch off", "stale source (126)", "shuffled source", "random switch"}
    mine = grid[(grid.rule == "score_capped_p2") & grid.switch & (grid.gross == 1.0) & (grid.rebalance_every_sessions == 5)].iloc[0]
    off = grid[(grid.rule == "score_capped_p2") & ~grid.switch & (grid.gross == 1.0) & (grid.rebalance_every_sessions == 5)].iloc[0]
    assert controls.loc["real", "sharpe"] == pytest.approx(mine["sharpe"])
    assert controls.loc["real, switch off", "sharpe"] == pytest.approx(off["sharpe"])
    assert controls.loc["real, stress cost", "cagr"] < controls.loc["real", "cagr"]
    shuffled = C.shuffles(raw, 2).toPandas()
    for _, part in shuffled.groupby(["draw", "session_idx"]):
        session = pdf[pdf.session_idx == part["session_idx"].iloc[0]]
        assert sorted(part["score"].dropna()) == sorted(session["score"].dropna())
    nets = df.groupBy("session_idx").agg(F.avg("r_next").alias("net")).withColumn("trial", F.lit("even"))
    base = K.baselines(df, nets, 20, None, BLOCKS).toPandas()
    assert sorted(base["book"]) == ["benchmark even"] + ["equal_weight"] * 4
    assert set(K.by_family(K.controls(scores, df, 20, draws=1), "family").toPandas()["n"]) == {1}


def test_snapshot(spark, tmp_path):
    root, out = f"{tmp_path}/root", f"{tmp_path}/snapshot"
    day = dt.date
    field = [(day(2020, 1, 1), "u1", 1.0), (day(2020, 1, 2), "u1", 2.0), (day(2021, 1, 4), "u1", 3.0), (day(2020, 1, 2), "u9", 7.0)]
    for f in X.BAR_FIELDS.values():
        rows = [r for r in field if f != "v" or r[0] != day(2020, 1, 2)]  # a bar without volume
        spark.createDataFrame(rows, "date date, instrument_uid string, value double").write.parquet(f"{root}/etf/{f}.parquet")
    spark.createDataFrame([(day(2020, 1, 2), "u1", True)], "date date, instrument_uid string, value boolean").write.parquet(f"{root}/etf/non_tradeable.parquet")
    spark.createDataFrame([(day(2020, 1, 1), "I", 1.0), (day(2021, 1, 1), "I", 2.0)], "date date, instrument string, value double").write.parquet(f"{root}/market/c.parquet")
    for t in X.TENORS:
        spark.createDataFrame([(day(2020, 12, 30), day(2020, 12, 31), 1.0), (day(2020, 12, 31), day(2021, 1, 4), 2.0)], "date date, available_at_date date, value double").write.parquet(f"{root}/treasury/yield_{t}.parquet")
    index = tmp_path / "index"
    index.mkdir()
    (index / "VIX.csv").write_text("DATE,OPEN,CLOSE\n01/02/2020,1,12.5\n01/03/2020,1,none\n")
    (index / "SKEW.csv").write_text("DATE,SKEW\n12/31/2020,110\n")
    tickers = spark.createDataFrame([("T", "u1", day(2020, 1, 2))], "ticker string, instrument_uid string, first_usable_date date")
    bars = [tuple(r) for r in X.bars(spark, root, tickers).orderBy("date").collect()]
    assert bars == [(day(2020, 1, 2), "T", 2.0, 2.0, 2.0, 2.0, None, 2.0, True), (day(2021, 1, 4), "T", 3.0, 3.0, 3.0, 3.0, 3.0, 3.0, False)]
    with pytest.raises(RuntimeError, match="rewritten"):
        X.build(spark, root, out, tickers, "2021-01-01", str(index), f"{root}/none", now=dt.datetime(2024, 1, 1, 18, 15))
    manifest = X.build(spark, root, out, tickers, "2021-01-01", str(index), f"{root}/none", now=dt.datetime(2024, 1, 1, 9))
    files = manifest["files"]
    assert len(files) == 12 and files["dev/bars.parquet"]["rows"] == 1 and files["holdout/bars.parquet"]["rows"] == 1
    assert files["dev/treasury.parquet"]["rows"] == 7 and files["holdout/treasury.parquet"]["rows"] == 7  # published after the fence
    assert files["dev/index_closes.parquet"]["rows"] == 2 and files["dev/stock_members.parquet"] | {"hash": ""} == {"rows": 0, "first": None, "last": None, "hash": ""}
    assert X.exists(spark, f"{out}/MANIFEST.json") and X.csv_table(spark, f"{out}/tickers.csv", "ticker string, block int").collect()[0].asDict() == {"ticker": "T", "block": None}
    assert X.read(spark, out, "bars", "dev", "2021-01-01").count() == 1
    with pytest.raises(I.FenceError):
        X.read(spark, out, "bars", "dev", "2020-01-02")
    with pytest.raises(I.FenceError):
        X.read(spark, out, "bars", "full", "2021-01-01")
    unlock = {"owner": "o", "date": "2024-01-01", "run_id": "r", "config_ids": ["r:1"], "statement": "s"}
    with pytest.raises(I.FenceError, match="no trials"):
        X.read(spark, out, "bars", "full", "2021-01-01", unlock, str(tmp_path / "runs"))
    spark.range(1).write.parquet(str(tmp_path / "runs" / "r" / "trials"))
    assert X.read(spark, out, "bars", "full", "2021-01-01", unlock, str(tmp_path / "runs")).count() == 2
    with pytest.raises(I.FenceError, match="owner"):
        X.read_unlock(unlock | {"owner": ""}, lambda r: True)
    with pytest.raises(I.FenceError, match="no trials"):
        X.read_unlock(unlock, lambda r: False)
    with pytest.raises(SettingsError):
        X.read(spark, out, "bars", "all", "2021-01-01")


def test_stocks(spark, tmp_path):
    universe = [(2020, "u1", 5.0, True), (2020, "u2", 9.0, True), (2020, "u3", 7.0, True), (2020, "u4", 99.0, False), (2020, "u5", None, True)]
    spark.createDataFrame(universe, "effective_year int, instrument_uid string, mktcap_63d_median double, value boolean").write.parquet(f"{tmp_path}/u")
    spark.createDataFrame([(dt.date(2020, 5, 1), "u2", 0.1), (dt.date(2021, 5, 1), "u2", 0.2), (dt.date(2020, 5, 1), "u1", 0.3)], "date date, instrument_uid string, value double").write.parquet(f"{tmp_path}/equity/ret.parquet")
    members, rets = X.stocks(spark, f"{tmp_path}/u", str(tmp_path), 2)
    assert sorted((r["instrument_uid"], r["size_rank"]) for r in members.collect()) == [("u2", 1), ("u3", 2)]
    assert [tuple(r) for r in rets.collect()] == [(dt.date(2020, 5, 1), "u2", 0.1)]


def test_artefacts(spark, trials, tmp_path):
    runs, run = str(tmp_path), str(tmp_path / "r1")
    preds = spark.createDataFrame([("m", "w", 5, 1, "A", 0.1), ("m", "w", 21, 1, "A", 0.2)], "model string, window string, h int, session_idx int, ticker string, pred double")
    wanted = R.jobs(spark, ["m"], ["w"], [5, 21, 44])
    assert R.unfinished(spark, wanted, run).count() == 3
    R.save_predictions(preds, run)
    R.save_predictions(preds.filter("h = 5").withColumn("pred", F.lit(9.0)), run)  # replaces its own partition only
    assert {(r["h"], r["pred"]) for r in R.linked_predictions(spark, run).collect()} == {(5, 9.0), (21, 0.2)}
    assert [r["h"] for r in R.unfinished(spark, wanted, run).collect()] == [44]
    for run_id in ("r1", "r2", "r1"):
        R.save_ledger(trials, runs, run_id)
    ledger = spark.read.parquet(f"{runs}/ledger").groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in ledger} == dict.fromkeys(("r1", "r2"), trials.count())
    R.log_run(runs, {"run_id": "r1", "notes": "first"})
    R.log_run(runs, {"run_id": "r1", "pbo": 0.5})
    assert "first" in (tmp_path / "RUNLOG.yaml").read_text()
    settings = {"run_name": "x", "groups": {"a": 1}, "evaluation": {}}
    R.save_stage_settings(str(tmp_path / "groups"), settings, "groups", settings)
    assert "run_settings_hash" in (tmp_path / "groups" / "settings.yaml").read_text()
    nets = trials.select(F.lit("ew_monthly").alias("trial"), F.posexplode("net").alias("session_idx", "net")).filter("session_idx < 80").groupBy("trial", "session_idx").agg(F.avg(F.col("net").cast("double")).alias("net"))
    random = nets.select(F.lit("random").alias("trial"), F.explode(F.array(F.lit(0), F.lit(1))).alias("draw"), "session_idx", "net")
    text = R.report({"run_id": "r1"}, G.deflate(trials), R.benchmark_table(nets, 0), R.random_table(random, 0), 0.25)
    assert text.startswith("# Run r1") and "probability of overfitting: 0.250" in text and "## Medians by rule_family" in text and f"- trials: {trials.count()}" in text


def test_kept_frames_are_made_once(spark, tmp_path):
    made = []

    @keeping.kept
    def numbers(spark, d):
        made.append(d)
        return spark.range(3)

    assert numbers(spark, "a").count() == 3 and numbers(spark, "a").count() == 3 and numbers(spark, "b").count() == 3
    assert made == ["a", "b"]
