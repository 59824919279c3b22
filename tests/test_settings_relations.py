"""Settings against each other, and from files."""

import copy

import pytest
import yaml

from loomspan.functions.settings import SettingsError
from loomspan.functions.settings_relations import check_all, load_files, rule_names, wrongs

BASE = {
    "run_name": "x", "run": {"notes": ""}, "data": {"fence_date": "2021-01-01"}, "paths": {"unlock_file": "u.yaml"}, "context": {"market_lag_sessions": 1, "cboe_lag_sessions": 1},
    "labels": {"horizons": [1, 5], "variants": ["rank"], "min_vol_window": 5},
    "models": [{"name": "r", "kind": "ridge", "alpha": 0.1, "enabled": True}, {"name": "t", "kind": "lightgbm", "enabled": True, "params": {"num_leaves": 7, "min_data_in_leaf": 1000}}],
    "model_defaults": {"ridge": {"device": "auto", "cpu_precision": "float32"}},
    "walkforward": {"windows": ["expanding", "rolling"], "window_sessions": {"rolling": 252}, "retrain_every_months": 1, "purge_extra_sessions": 1},
    "benchmarks": {"random_draws": 5}, "evaluation": {"common_start": "2010-01-01", "end": None, "blocks": [["2010-01-01", "2012-12-31"], ["2013-01-01", "2020-12-31"]], "holdout_blocks": None},
    "groups": {"source_run": None, "purge_extra_sessions": 2}, "environment": {"purge_extra_sessions": 1, "stress": {"input": "dd", "threshold": 0.8}},
    "book": {
        "sources": {"e": {"kind": "predictions", "files": "all", "variants": ["rank"], "horizons": "all"}, "g": {"kind": "groups", "horizons": [5]}, "m": {"kind": "mean", "of": ["e", "g"]}},
        "selection": [{"name": "top_fraction", "enabled": True, "fraction": 0.2}, {"name": "score_capped", "enabled": True, "max_weight": 0.15, "max_group_weight": 0.4, "iterations": 10, "score_powers": [1, 2]}],
        "switch": {"states": [False, True], "defensive_share": 1.0}, "gross": [1.0, 1.5], "rebalance_every_sessions": [5, 21],
        "controls": {"reference": {"source": "g", "rule": "score_capped_p2", "switch": True, "gross": 1.0, "rebalance_every_sessions": 5}, "shuffle_draws": 2, "random_switch_draws": 2},
    },
    "limits": {"max_gross": 2.0}, "compute": {"workers": 4, "lightgbm_threads": None},
}


def changed(path, value):
    tree = copy.deepcopy(BASE)
    node = tree
    for key in path[:-1]:
        node = node[key]
    if value is None and path[-1] in node:
        del node[path[-1]]
    else:
        node[path[-1]] = value
    return tree


def test_sound_settings_pass():
    assert wrongs(BASE, 66) == [] and check_all(BASE, 66) is BASE
    assert rule_names(BASE["book"]["selection"]) == {"top_fraction", "score_capped", "score_capped_p2"}
    assert wrongs({"models": BASE["models"]}) == []  # the settings of one stage


@pytest.mark.parametrize(
    ("path", "value", "said"),
    [
        (("models", 1, "name"), "r", "two models are called r"), (("models", 0, "alpha"), 0, "alpha"), (("models", 0, "kind"), "forest", "kind"), (("models", 0, "speed"), 1, "unknown field speed"),
        (("models", 1, "params", "objective"), "x", "params"), (("models", 1, "params", "min_data_in_leaf"), 1001, "params"), (("models", 0, "alpha"), None, "lacks alpha"),
        (("walkforward", "windows"), ["rolling_9y"], "no length"), (("walkforward", "windows"), [], "no window"), (("walkforward", "window_sessions", "rolling"), 15, "cannot hold"),
        (("evaluation", "common_start"), "2021-01-01", "fence"), (("evaluation", "end"), "2022-01-01", "fence"), (("evaluation", "blocks"), [["2013-01-01", "2012-01-01"]], "order"),
        (("evaluation", "blocks"), [["2010-01-01", "2012-01-01"], ["2012-01-01", "2013-01-01"]], "overlap"), (("evaluation", "blocks"), [["2009-01-01", "2012-01-01"]], "outside"),
        (("book", "sources", "m", "of"), ["m"], "no source of its own"), (("book", "sources", "m", "of"), ["nobody"], "no source of its own"), (("book", "sources", "e", "files"), ["a"], "files"),
        (("book", "sources", "e", "files"), ["a__b"], ""), (("book", "sources", "g", "variants"), ["rank"], "unknown field"), (("book", "sources", "g", "horizons"), [0], "horizons"),
        (("book", "selection", 0, "fraction"), 1.5, "fraction"), (("book", "selection", 1, "max_weight"), 0.5, "more for one asset"), (("book", "selection", 1, "score_powers"), None, "reference"),
        (("book", "switch", "states"), [True, True], "switch"), (("book", "gross"), [2.5], "gross"), (("book", "rebalance_every_sessions"), [0], "rebalanced"),
        (("book", "controls", "reference", "gross"), 1.2, "reference book is not in the grid: gross"), (("book", "controls", "shuffle_draws"), -1, "shuffle_draws"),
        (("groups", "source_run"), "../x", "source_run"), (("compute", "lightgbm_threads"), 0, "threads"), (("model_defaults", "ridge", "device"), "tpu", "device"),
    ],
)
def test_what_does_not_fit_is_named(path, value, said):
    tree = changed(path, value)
    if not said:
        assert wrongs(tree, 66) == []
    else:
        with pytest.raises(SettingsError, match=said):
            check_all(tree, 66)


def test_everything_wrong_is_said_at_once():
    tree = changed(("limits", "max_gross"), 0.5)
    tree["labels"]["horizons"] = []
    tree["models"][0]["alpha"] = -1
    with pytest.raises(SettingsError) as error:
        check_all(tree, 66)
    assert all(x in str(error.value) for x in ("labels.horizons", "limits.max_gross", "alpha", "gross exposure"))


def test_settings_from_files(tmp_path):
    (tmp_path / "base.yaml").write_text(yaml.safe_dump(BASE))
    (tmp_path / "smoke.yaml").write_text("models:\n  - {name: t, enabled: false}\nlabels: {horizons: [5]}\n")
    (tmp_path / "none.yaml").write_text("")
    (tmp_path / "list.yaml").write_text("- 1\n")
    tree = load_files(tmp_path / "base.yaml", [tmp_path / "smoke.yaml", tmp_path / "none.yaml"], ["compute.workers=2"], 66)
    assert tree["labels"]["horizons"] == [5] and not tree["models"][1]["enabled"] and tree["compute"]["workers"] == 2
    with pytest.raises(SettingsError, match="no mapping"):
        load_files(tmp_path / "list.yaml")
    with pytest.raises(SettingsError, match="unknown key"):
        load_files(tmp_path / "base.yaml", sets=["labels.horizon=[1]"])
    with pytest.raises(SettingsError, match="read-only"):
        load_files(tmp_path / "base.yaml", sets=["data.fence_date=2022-01-01"])
