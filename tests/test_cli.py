"""Commands over a small snapshot."""

import copy
import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
import yaml

from loomspan import cli
from loomspan.functions.settings import SettingsError
from loomspan.operators import ingest as I
from tests.test_settings_relations import BASE

DEV = len(pd.bdate_range("2018-01-01", "2020-12-31"))
NAMES = ["SPY", "TLT", "GLD", "QQQ", "SHY"]


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(0)
    days = [d.date() for d in pd.bdate_range("2018-01-01", periods=840)]
    rows = []
    for t in NAMES:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(days))))
        rows += [(d, t, float(c * 1.001), float(c * 1.01), float(c * 0.99), float(c), 1e6, 1e8, False) for d, c in zip(days, close, strict=True)]
    schema = "date date, ticker string, open double, high double, low double, close double, volume double, adv double, non_tradeable boolean"
    fence = dt.date(2021, 1, 1)
    empty = {
        "market": "date date, instrument string, value double", "treasury": "date date, available_at_date date, value double, tenor string", "index_closes": "date date, series string, value double",
        "stock_returns": "date date, instrument_uid string, ret double", "stock_members": "effective_year int, instrument_uid string, size_rank int",
    }
    for part in ("dev", "holdout"):
        mine = [r for r in rows if (r[0] < fence) == (part == "dev")]
        spark.createDataFrame(mine, schema).coalesce(1).write.parquet(f"{root}/data/{part}/bars.parquet")
        for name, s in empty.items():
            spark.createDataFrame([], s).write.parquet(f"{root}/data/{part}/{name}.parquet")
    blocks = {"SPY": ("equity", "broad_us_equity"), "QQQ": ("equity", "growth_mega_cap"), "TLT": ("bonds", "long"), "GLD": ("metals", "gold"), "SHY": ("cash", "cash")}
    spark.createDataFrame([(t, *blocks[t]) for t in NAMES], "ticker string, block_name string, role string").coalesce(1).write.option("header", True).csv(f"{root}/data/tickers.csv")
    tree = copy.deepcopy(BASE)
    tree["walkforward"] |= {"windows": ["expanding"], "retrain_every_months": 3}
    tree["evaluation"] |= {"common_start": "2019-06-03", "blocks": [["2019-06-03", "2020-12-31"]]}
    tree["models"][1]["params"] = {"num_leaves": 3, "num_boost_round": 2, "min_data_in_leaf": 50, "max_bin": 15}
    tree["labels"] |= {"horizons": [5], "variants": ["vol_scaled", "rank"]}
    (root / "base.yaml").write_text(yaml.safe_dump(tree))
    return root


def call(spark, place, command, *more):
    return cli.main([command, "--base", f"{place}/base.yaml", "--data", f"{place}/data", "--runs", f"{place}/runs", "--families", "momentum", "--least-rows", "100", *more], spark)


def test_train_resumes_and_the_holdout_opens_once(spark, place, capsys):
    run = call(spark, place, "all", "--run-id", "r1")
    said = capsys.readouterr().out
    assert "warning: window expanding, horizon 5: the first full bin is on" in said and said.count("done:") == 2
    preds = spark.read.parquet(f"{run.folder}/preds")
    assert {(r["model"], r["target"]) for r in preds.select("model", "target").distinct().collect()} == {(m, v) for m in ("r", "t") for v in ("vol_scaled", "rank")}
    fits = spark.read.parquet(f"{run.folder}/fits").collect()
    assert fits and all(str(f["train_end"]) < str(f["retrain"]) for f in fits)
    call(spark, place, "train", "--run-id", "r1")
    assert capsys.readouterr().out.count("resume:") == 2
    with pytest.raises(SettingsError, match="other settings"):
        call(spark, place, "train", "--run-id", "r1", "--set", "labels.variants=[rank]")
    assert preds.agg({"session_idx": "max"}).first()[0] == DEV - 1  # the last session before the fence

    with pytest.raises(I.FenceError, match="sealed"):
        call(spark, place, "holdout")
    chosen = [("r", "expanding", "rank", 5, "top", 5, 0.0, "r1:a", 1.0)]
    spark.createDataFrame(chosen, "model string, window string, variant string, h int, rule string, rebalance_every int, no_trade_band double, trial_id string, sharpe double").write.parquet(f"{run.folder}/trials")
    (place / "data" / "u.yaml").write_text(yaml.safe_dump({"owner": "o", "date": "2024-01-01", "run_id": "r1", "config_ids": ["r1:a"], "statement": "s"}))
    held = call(spark, place, "holdout")
    found = spark.read.parquet(f"{held.folder}/preds")
    assert {r["model"] for r in found.select("model").distinct().collect()} == {"r"} and found.agg({"session_idx": "max"}).first()[0] == 839
    with pytest.raises(I.FenceError, match="opened once"):
        call(spark, place, "holdout")


def test_features_and_labels_are_found_again(spark, place, capsys):
    call(spark, place, "features")
    call(spark, place, "labels")
    folders = set(os.listdir(place / "data" / "derived_dev"))
    call(spark, place, "features")
    call(spark, place, "labels", "--set", "labels.variants=[rank]")
    new = set(os.listdir(place / "data" / "derived_dev")) - folders
    assert len(new) == 1 and new.pop().startswith("labels_")
    assert capsys.readouterr().out.splitlines()[0] == f"features: {DEV * 5} rows"


def test_groups_command(spark, place):
    run = call(spark, place, "groups", "--run-id", "g1", "--set", "models.t.enabled=false")
    etf = spark.read.parquet(f"{run.folder}/groups/etf_scores")
    assert {r["ticker"] for r in etf.select("ticker").distinct().collect()} == {"SPY", "QQQ", "TLT", "GLD"}
    assert {r["model"] for r in etf.select("model").distinct().collect()} == {"grp_ens", "grp_ens_all_h"}


def test_commands_are_checked(spark, place):
    with pytest.raises(SettingsError, match="--source, --indices, --universe, --tickers"):
        call(spark, place, "snapshot")
    with pytest.raises(SystemExit):
        call(spark, place, "dance")
