"""Orchestrator, holdout, runs, caches and stage outputs."""

import datetime as dt
import os
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions.settings import SettingsError, migrated
from loomspan.operators import artefacts as AR
from loomspan.operators import holdout as H
from loomspan.operators import ingest as I
from loomspan.operators import orchestrator as O
from loomspan.operators import runs as R
from loomspan.operators import stage_outputs as SO
from loomspan.plans import algebra as A
from loomspan.sources import panel_store as PS
from loomspan.sources.shared_files import Files

JOBS = [O.Job(m, w, h) for m in ("a", "b") for w in ("expanding", "rolling") for h in (1, 5)]


def preds(spark, job, n=6):
    return spark.range(n).select(F.col("id").cast("int").alias("session_idx"), F.lit("T").alias("ticker"), F.lit(float(job.h)).alias("pred"))


# -- orchestrator ----------------------------------------------------------------------------------------------
def test_jobs_run_side_by_side_and_are_observed(spark, tmp_path):
    meet, pools = threading.Barrier(3, timeout=60), []

    def work(job):
        pools.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        if len(pools) <= 3:
            meet.wait()  # passes only if three jobs are under way at once
        return preds(spark, job)

    out = O.check(O.run(spark, JOBS, work, str(tmp_path), workers=3, say=lambda _: None))
    assert [(o.state, o.rows, o.first, o.last) for o in out] == [("done", 6, 0, 5)] * 8
    assert sorted(pools) == sorted(f"{j.model}-{j.window}" for j in JOBS)
    found = O.predictions(spark, str(tmp_path), JOBS)
    assert found.groupBy("model", "window", "h").count().count() == 8
    plan = found.filter("h = 5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(h" in plan


def test_a_failure_stays_with_its_job_and_is_made_up_for(spark, tmp_path):
    folder, made = str(tmp_path), []

    def work(job, broken=True):
        made.append(job)
        if broken and job == JOBS[3]:
            return preds(spark, job).withColumn("pred", F.raise_error(F.lit("no fit")).cast("double"))
        return preds(spark, job)

    out = O.run(spark, JOBS, work, folder, say=lambda _: None)
    assert [o.job for o in out if o.state == "failed"] == [JOBS[3]] and sum(o.state == "done" for o in out) == 7
    with pytest.raises(O.RunFailed, match="no fit"):
        O.check(out)
    times = {j: os.stat(f"{j.place(folder)}/_SUCCESS").st_mtime_ns for j in JOBS if j != JOBS[3]}
    made.clear()
    again = O.check(O.run(spark, JOBS, lambda job: work(job, broken=False), folder, say=lambda _: None))
    assert made == [JOBS[3]] and sum(o.state == "resumed" for o in again) == 7
    assert times == {j: os.stat(f"{j.place(folder)}/_SUCCESS").st_mtime_ns for j in times}
    assert O.predictions(spark, folder, JOBS).count() == 48


def test_a_killed_job_counts_as_missing(spark, tmp_path):
    folder = str(tmp_path)
    O.run(spark, JOBS[:2], lambda job: preds(spark, job), folder, say=lambda _: None)
    os.remove(f"{JOBS[0].place(folder)}/_SUCCESS")  # as if it had been killed before its commit
    out = O.run(spark, JOBS[:2], lambda job: preds(spark, job, 3), folder, say=lambda _: None)
    assert [(o.state, o.rows) for o in out] == [("done", 3), ("resumed", 0)]


def test_slow_jobs_go_first(spark, tmp_path):
    order = []
    O.run(spark, JOBS, lambda job: (order.append(job), preds(spark, job))[1], str(tmp_path), workers=1, slow=lambda job: job.model == "b", say=lambda _: None)
    assert [j.model for j in order] == ["b"] * 4 + ["a"] * 4


def calendar(spark, n=400):
    days = pd.bdate_range("2020-01-01", periods=n)
    return spark.createDataFrame([(i, d.date()) for i, d in enumerate(days)], "session_idx int, date date")


def test_fit_log_counts_training_rows(spark):
    rows = spark.range(400).select(F.col("id").cast("int").alias("session_idx"), F.explode(F.sequence(F.lit(1), (F.col("id") % 3).cast("int"))).alias("n")).filter("session_idx % 3 > 0").withColumn("tradable", F.col("session_idx") % 2 == 0)
    fits = spark.createDataFrame([(300, 1, 0, 250), (330, 1, 100, 280)], "retrain int, h int, train_start int, train_end int")
    got = {str(r["train_start"]): r["rows"] for r in O.fit_log(fits, rows, calendar(spark)).collect()}
    want = [sum(s % 3 for s in range(a, b + 1) if s % 2 == 0) for a, b in ((0, 250), (100, 280))]
    assert sorted(got.values()) == sorted(want)


def test_first_usable_and_full_bins(spark):
    panel = spark.createDataFrame([(0, "A", False), (1, "A", None), (2, "B", True), (3, "A", True)], "session_idx int, ticker string, tradable boolean")
    assert O.first_usable(panel) == 2 and O.first_usable(panel.limit(0)) is None
    fits = spark.createDataFrame([("expanding", 1, 40), ("expanding", 1, 60), ("rolling", 1, 120)], "window string, h int, retrain int")
    asked = spark.createDataFrame([("expanding", 1), ("rolling", 1), ("rolling", 5)], "window string, h int")
    bins = O.first_full_bins(fits, asked)
    assert {(r["window"], r["h"]): r["session_idx"] for r in bins.collect()} == {("expanding", 1): 103, ("rolling", 1): 183, ("rolling", 5): None}
    late = O.late_bins(bins, calendar(spark), "2020-07-01")
    assert len(late) == 2 and "window rolling, horizon 1: the first full bin is on 2020-09-14" in late[0] and "horizon 5: the first full bin is never" in late[1]


# -- stage outputs -------------------------------------------------------------------------------------------------
def test_a_stage_is_there_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "run" / "groups")
    bad = spark.range(2).withColumn("x", F.raise_error(F.lit("killed")))
    with pytest.raises(Exception, match="killed"):
        O.commit(spark, folder, {"scores": spark.range(3), "members": bad})
    assert not os.path.exists(folder)
    O.commit(spark, folder, {"scores": spark.range(3), "members": spark.range(2)}, {"settings.yaml": "a: 1\n"})
    assert spark.read.parquet(f"{folder}/scores").count() == 3 and Files(spark).text(f"{folder}/settings.yaml") == "a: 1\n"
    with pytest.raises(Exception, match="killed"):
        O.commit(spark, folder, {"scores": bad})
    assert spark.read.parquet(f"{folder}/scores").count() == 3  # what was there stays
    O.commit(spark, folder, {"scores": spark.range(7)})
    assert spark.read.parquet(f"{folder}/scores").count() == 7 and os.listdir(tmp_path / "run") == ["groups"]


# -- holdout -------------------------------------------------------------------------------------------------------
CHOICE = "model string, window string, variant string, h int, rule string, rebalance_every int, no_trade_band double, trial_id string, sharpe double"
TRIALS = [("m1", "expanding", "rank", 5, "top", 5, 0.0, "r:1", 1.0), ("m2", "rolling", "rank", 5, "top", 5, 0.0, "r:2", 2.0), ("m1", "expanding", "rank", 21, "top", 5, 0.02, "r:3", 3.0)]
SETTINGS = {"models": [{"name": "m1"}, {"name": "m2"}], "walkforward": {"windows": ["expanding", "rolling"], "x": 1}}
UNLOCK = {"owner": "o", "date": "2024-01-01", "run_id": "r", "config_ids": ["r:1", "r:3"], "statement": "s"}


def test_the_holdout_opens_once_for_trials_of_a_run(spark, tmp_path):
    runs, snapshot = str(tmp_path / "runs"), str(tmp_path / "snapshot")
    bars = [("dev", dt.date(2020, 1, 1)), ("holdout", dt.date(2021, 1, 1))]
    for part, day in bars:
        spark.createDataFrame([(day, "A")], "date date, ticker string").write.parquet(f"{snapshot}/{part}/bars.parquet")
    with pytest.raises(I.FenceError, match="no trials"):
        H.open_holdout(spark, runs, UNLOCK, SETTINGS)
    spark.createDataFrame(TRIALS, CHOICE).write.parquet(f"{runs}/r/trials")
    with pytest.raises(I.FenceError, match="names no trial"):
        H.open_holdout(spark, runs, UNLOCK | {"config_ids": ["r:9"]}, SETTINGS)
    with pytest.raises(I.FenceError, match="statement"):
        H.open_holdout(spark, runs, UNLOCK | {"statement": ""}, SETTINGS)
    assert not os.path.exists(f"{runs}/holdout_r")  # refused calls claim nothing
    opened = H.open_holdout(spark, runs, UNLOCK, SETTINGS)
    assert opened.settings == {"models": [{"name": "m1"}], "walkforward": {"windows": ["expanding"], "x": 1}}
    assert opened.table(snapshot, "bars", "2021-01-01").count() == 2
    with pytest.raises(I.FenceError, match="opened once"):
        H.open_holdout(spark, runs, UNLOCK, SETTINGS)
    new = spark.createDataFrame([(*t[:7], f"new{i}", 9.0 + i) for i, t in enumerate(TRIALS)], CHOICE)
    opened.save(new)
    got = {r["trial_id"]: r["sharpe"] for r in spark.read.parquet(f"{runs}/holdout_r/holdout_trials").collect()}
    assert got == {"r:1": 9.0, "r:3": 11.0}
    with pytest.raises(Exception, match="already exists"):
        opened.save(new)


def test_two_claims_at_once_give_one(spark, tmp_path):
    files, path = Files(spark), str(tmp_path / "x" / "lock")
    assert [files.create(path, "1"), files.create(path, "2")] == [True, False] and files.text(path) == "1"
    files.replace(path, "3")
    assert files.text(path) == "3" and files.names(str(tmp_path / "x"))[-1] == "lock"


def test_unlock_file(spark, tmp_path):
    assert H.read_unlock_file(spark, str(tmp_path / "none.yaml")) == {}
    (tmp_path / "u.yaml").write_text("owner: o\nconfig_ids: [a, b]\n")
    assert H.read_unlock_file(spark, str(tmp_path / "u.yaml")) == {"owner": "o", "config_ids": ["a", "b"]}


# -- runs ------------------------------------------------------------------------------------------------------------
def test_a_run_is_frozen(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    (code / "a.py").write_text("x = 1\n")
    settings = {"run_name": "x", "labels": {"h": [1]}, "compute": {"workers": 3}}
    run = R.Run.begin(spark, str(tmp_path / "runs"), settings, code, now=dt.datetime(2024, 1, 2, 3, 4), changes={"sets": ["labels.h=[1]"]})
    assert run.run_id == "20240102_0304_x"
    (code / "a.py").write_text("x = 2\n")
    again = R.Run.begin(spark, str(tmp_path / "runs"), settings | {"compute": {"workers": 9}}, code, run.run_id)  # what changes no result may differ
    assert [len(s["code_hash"]) for s in again.starts()] == [12, 12] and len({s["code_hash"] for s in again.starts()}) == 2
    assert again.code() == {"a.py": "x = 1\n"} and again.record()["settings"] == settings
    with pytest.raises(SettingsError, match="other settings"):
        R.Run.begin(spark, str(tmp_path / "runs"), settings | {"labels": {"h": [2]}}, code, run.run_id)
    assert len(run.starts()) == 2
    assert run.settings({"labels": {"h": [5], "floor": 0.1}, "run_name": "y"}) == {"labels": {"h": [1], "floor": 0.1}, "run_name": "x"}


def test_settings_of_an_earlier_layout():
    base = {"a": {"x": 1, "y": 2}, "models": [{"name": "m", "kind": "ridge"}, {"name": "new"}], "walkforward": {"window_sessions": {"w": 1}}, "book": {"sources": {}}, "added": 7}
    frozen = {
        "a": {"x": 5, "old": 3}, "gone": 1,
        "models": [{"name": "m", "kind": "ridge", "scope": "global", "feature_groups": None}, {"name": "off", "scope": "own", "enabled": False}, {"name": "own", "scope": "own"}],
        "walkforward": {"window_sessions": {"v": 9}}, "book": {"sources": {"s": {"pred_dir": None, "k": 1}, "t": {"pred_dir": "p"}}},
    }
    assert migrated(frozen, base) == {
        "a": {"x": 5, "y": 2}, "models": [{"name": "m", "kind": "ridge"}, {"name": "off", "enabled": False}, {"name": "own", "scope": "own"}],
        "walkforward": {"window_sessions": {"v": 9}}, "book": {"sources": {"s": {"k": 1}, "t": {"pred_dir": "p"}}}, "added": 7,
    }
    assert frozen["models"][0]["scope"] == "global"


# -- caches ------------------------------------------------------------------------------------------------------
def test_caches_follow_settings_code_and_data(spark, tmp_path):
    data, folder, made = str(tmp_path / "data"), str(tmp_path / "derived"), []
    spark.range(3).write.parquet(data)
    code = tmp_path / "labels.py"
    code.write_text("x = 1\n")

    def build(name, section):
        def make():
            made.append(name)
            return spark.range(5)

        key = R.cache_key(section, R.code_hash(code), R.fingerprint(spark, data))
        return key, R.cached(spark, folder, name, key, make)[1]

    first = build("features", {"lag": 1}), build("labels", {"h": [1, 5]})
    assert made == ["features", "labels"] and [hit for _, hit in first] == [False, False]
    # one changed label setting makes labels anew and finds the features
    second = build("features", {"lag": 1}), build("labels", {"h": [1, 5, 21]})
    assert made == ["features", "labels", "labels"] and [hit for _, hit in second] == [True, False] and first[1][0] != second[1][0]
    code.write_text("x = 2\n")
    assert not build("features", {"lag": 1})[1]
    spark.range(4).write.mode("overwrite").parquet(data)
    key, hit = build("features", {"lag": 1})
    assert not hit
    os.remove(f"{folder}/features_{key}/_SUCCESS")  # a table that was not written whole is no hit
    assert not build("features", {"lag": 1})[1]
    assert len(R.drop_stale(spark, folder, "features", {key})) == 2 and build("features", {"lag": 1})[1]


def test_fingerprint_of_a_manifest_is_its_content(spark, tmp_path):
    for name, built, rows in (("a", "t1", 3), ("b", "t2", 3), ("c", "t1", 4)):
        text = f'{{"built_at": "{built}", "files": {{"bars": {{"rows": {rows}}}}}}}'
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{tmp_path}/{name}/MANIFEST.json")
    a, b, c = (R.fingerprint(spark, f"{tmp_path}/{n}") for n in "abc")
    assert a == b != c


# -- panel store ---------------------------------------------------------------------------------------------------
def snapshot(spark, root, late_yield=False, late_member=False):
    days = [d.date() for d in pd.bdate_range("2019-01-01", periods=300)]
    bars = [(d, t, 1.0, 2.0, 0.5, 1.0 + i / 100, 10.0, 5.0, t == "B" and i == 299) for i, d in enumerate(days) for t in ("A", "B") if not (t == "A" and i == 7)]
    tables = {
        "bars": (bars, "date date, ticker string, open double, high double, low double, close double, volume double, adv double, non_tradeable boolean"),
        "market": ([(days[0], "X", 1.0), (dt.date(2018, 1, 1), "X", 2.0)], "date date, instrument string, value double"),
        "treasury": ([(days[0], dt.date(2021, 1, 1) if late_yield else days[1], 0.5, "1_year")], "date date, available_at_date date, value double, tenor string"),
        "index_closes": ([(days[0], "VIX", 9.0)], "date date, series string, value double"),
        "stock_returns": ([(days[0], "u", 0.1)], "date date, instrument_uid string, ret double"),
        "stock_members": ([(2021 if late_member else 2019, "u", 1)], "effective_year int, instrument_uid string, size_rank int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{root}/dev/{name}.parquet")
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/holdout/{name}.parquet")
    spark.createDataFrame([("A", "g1"), ("B", "g2"), ("C", "g1")], "ticker string, block_name string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/tickers.csv")
    return days


def test_panel_of_a_snapshot(spark, tmp_path):
    root = str(tmp_path / "s")
    days = snapshot(spark, root)
    t = PS.load(spark, root, "dev", "2020-12-31")
    rows = {(r["session_idx"], r["ticker"]): r for r in t.panel.collect()}
    assert len(rows) == 900 and rows[7, "A"]["close"] is None and not rows[7, "A"]["tradable"] and rows[7, "A"]["date"] == days[7]
    # A lacks a bar, so its 252nd close is one session later; C has none at all
    assert min(s for (s, k), r in rows.items() if r["tradable"] and k == "A") == 252 and min(s for (s, k), r in rows.items() if r["tradable"] and k == "B") == 251
    assert not rows[299, "B"]["tradable"] and not any(r["tradable"] for (_, k), r in rows.items() if k == "C") and rows[0, "C"]["asset_group"] == "g1"
    assert t.market.count() == 1 and {r["value"] for r in t.yields.collect()} == {None, 0.5}
    with pytest.raises(I.FenceError):
        PS.load(spark, root, "full", "2020-12-31", UNLOCK, str(tmp_path / "runs"))
    with pytest.raises(I.FenceError):
        PS.load(spark, root, "dev", "2020-01-01")
    snapshot(spark, root, late_yield=True)
    with pytest.raises(I.FenceError):
        PS.load(spark, root, "dev", "2020-12-31")
    snapshot(spark, root, late_member=True)
    with pytest.raises(I.FenceError, match="members"):
        PS.load(spark, root, "dev", "2020-12-31")


def test_windows_over_a_stored_panel_neither_shuffle_nor_sort(spark, tmp_path):
    panel = spark.range(4000).select((F.col("id") % 500).cast("int").alias("session_idx"), F.to_date(F.lit("2020-01-01")).alias("date"), F.concat(F.lit("T"), (F.col("id") / 500).cast("int")).alias("ticker"), F.lit("g").alias("asset_group"), (F.col("id") % 97).cast("double").alias("close"), F.lit(True).alias("tradable"))
    held = PS.store(panel, "kept_panel", str(tmp_path / "t"), 4)
    outputs = {"m": A.mean(A.col("close"), 21), "l": A.lag(A.col("close"), 3), "z": A.zscore(A.col("close"), 63)}
    got = A.evaluate(held, outputs, keep=("session_idx", "ticker"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan and "Sort" not in plan
    want = A.evaluate(panel, outputs, keep=("session_idx", "ticker"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    stats = spark.sql("DESCRIBE EXTENDED kept_panel close").collect()
    assert {r[0]: r[1] for r in stats}["max"] == "96.0"
    PS.store(panel.limit(10), "kept_panel", str(tmp_path / "t"), 2)
    assert PS.stored(spark, "kept_panel").count() == 10


def test_saved_features_and_labels_are_pruned(spark, tmp_path):
    features = spark.range(10).select(F.col("id").cast("int").alias("session_idx"), F.current_date().alias("date"), F.lit("A").alias("ticker"), F.rand(1).alias("f"), F.rand(2).alias("g"))
    AR.save_features(features, str(tmp_path), "t")
    some = AR.load_features(spark, str(tmp_path), "t", ("g",))
    assert "ReadSchema: struct<session_idx:int,date:date,ticker:string,g:double>" in some._jdf.queryExecution().executedPlan().toString()
    labels = spark.range(12).select(F.when(F.col("id") % 2 == 0, "rank").otherwise("bin").alias("variant"), (F.col("id") % 3).cast("int").alias("h"), F.col("id").cast("int").alias("session_idx"), F.lit("A").alias("ticker"), F.rand(1).alias("label"))
    AR.save_labels(labels, str(tmp_path), "t")
    one = AR.load_labels(spark, str(tmp_path), "t", 2, "rank")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(h" in one._jdf.queryExecution().executedPlan().toString()


# -- outputs of stages ---------------------------------------------------------------------------------------------
def test_groups_stage_gives_members_their_groups_scores(spark, tmp_path):
    preds = spark.createDataFrame([("m", "w", h, s, g, float((h + s + ord(g)) % 5)) for h in (1, 5) for s in range(4) for g in "xyz"], "model string, window string, h int, session_idx int, group string, pred double")
    members = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z"), ("D", None)], "ticker string, group string")
    ok = spark.createDataFrame([(s, t, t != "C" or s > 0) for s in range(4) for t in "ABCD"], "session_idx int, ticker string, eligible boolean")
    folder, run = str(tmp_path / "run" / "groups"), {"labels": {"variants": ["rank"]}}
    with pytest.raises(SettingsError, match="no label variant"):
        SO.groups(folder, members, preds, preds, ok, "bin20", ["rank"], {}, run)
    SO.groups(folder, members, preds, preds, ok, "rank", ["rank"], {"groups": {"k": 1}, "evaluation": {}}, run)
    etf = spark.read.parquet(f"{folder}/etf_scores").toPandas()
    assert set(etf["model"]) == {"grp_ens", "grp_ens_all_h"} and set(etf["h"]) == {1, 5} and set(etf["variant"]) == {"rank"} and "D" not in set(etf["ticker"])
    one = etf[(etf["model"] == "grp_ens") & (etf["h"] == 1) & (etf["session_idx"] == 2)].set_index("ticker")["pred"].to_dict()
    raw = {t: (1 + 2 + ord(g)) % 5 for t, g in (("A", "x"), ("B", "y"), ("C", "z"))}
    assert one == {t: sum(v < raw[t] for v in raw.values()) / 2 for t in raw}
    every = etf[etf["model"] == "grp_ens_all_h"].groupby(["session_idx", "ticker"])["pred"].nunique()
    assert (every == 1).all() and len(etf[(etf["session_idx"] == 0) & (etf["ticker"] == "C")]) == 0
    assert spark.read.parquet(f"{folder}/scores").filter("h is null").count() == 12 and "run_settings_hash" in Files(spark).text(f"{folder}/settings.yaml")


def test_environment_stage_judges_models_and_persistence(spark, tmp_path):
    rng = np.random.default_rng(1)
    y = rng.normal(size=700)
    rows = [("env_ret", h, s, float(y[s])) for h in (3, 5) for s in range(700)]
    outcomes = spark.createDataFrame(rows, "target string, h int, session_idx int, y double")
    preds = spark.createDataFrame([(t, h, "m", s, v + float(rng.normal())) for t, h, s, v in rows], "target string, h int, model string, session_idx int, pred double")
    past = spark.createDataFrame([(t, h, s, float(rng.normal())) for t, h, s, _ in rows], "target string, h int, session_idx int, pred double")
    folder = str(tmp_path / "environment")
    SO.environment(folder, spark.range(3), outcomes, past, preds, spark.range(2), lambda h: h + 1, 300, 700, {}, {})
    got = {(r["h"], r["model"]): r for r in spark.read.parquet(f"{folder}/predictability").collect()}
    assert set(got) == {(h, m) for h in (3, 5) for m in ("m", "persistence")}
    p = pd.Series([r["pred"] for r in preds.filter("h = 3").orderBy("session_idx").collect()])
    want = p[300:].rank().corr(pd.Series(y)[300:].rank())
    assert got[3, "m"]["spearman"] == pytest.approx(want) and got[3, "m"]["t"] == pytest.approx(want * (400 / 3) ** 0.5)
    assert abs(got[3, "persistence"]["spearman"]) < 0.2 and got[5, "persistence"]["oos_r2"] < got[5, "m"]["oos_r2"] + 1


def test_book_stage_is_sorted_and_reported(spark, tmp_path):
    books = spark.createDataFrame([("s", "top", 5, 0.5), ("s", "cap", 5, None), ("t", "top", 21, 0.9), ("t", "cap", 21, 0.1)], "source string, rule string, rebalance_every_sessions int, sharpe_excess double")
    controls = spark.createDataFrame([("stale", 0.2), ("stale", 0.4), ("shuffled", None)], "family string, sharpe_excess double")
    base = spark.createDataFrame([("ew", 0.3)], "book string, sharpe_excess double")
    assert [r["sharpe_excess"] for r in SO.ranked_books(books).collect()] == [0.9, 0.5, 0.1, None]
    folder = str(tmp_path / "book")
    SO.book(folder, books, base, controls, ["source", "rule"], ["sharpe_excess"], {"book": {"a": 1}}, {})
    text = Files(spark).text(f"{folder}/REPORT.md")
    assert text.index("| t | top | 0.900 |") < text.index("| s | top | 0.500 |") < text.index("| s | cap |  |")
    assert "| top | 0.700 | 2 |" in text and "| stale | 0.300 | 0.400 |" in text and "| ew | 0.300 |" in text
    assert spark.read.parquet(f"{folder}/controls").count() == 3
    SO.book(folder, books, base, None, ["rule"], ["sharpe_excess"], {}, {})
    assert "Controls" not in Files(spark).text(f"{folder}/REPORT.md") and not os.path.exists(f"{folder}/controls")
