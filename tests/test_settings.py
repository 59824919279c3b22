import pytest

from loomspan.functions import settings as S

BASE = {
    "run": {"notes": ""}, "data": {"fence_date": "2021-01-01"}, "paths": {"unlock_file": "u.yaml"}, "context": {"market_lag_sessions": 1, "cboe_lag_sessions": 1},
    "labels": {"horizons": [1, 5], "variants": ["rank"], "min_vol_window": 5}, "models": [{"name": "r", "alpha": 1.0, "enabled": True}],
    "walkforward": {"window_sessions": {"y": 252}, "retrain_every_months": 1, "purge_extra_sessions": 1}, "benchmarks": {"random_draws": 5}, "groups": {"purge_extra_sessions": 2},
    "environment": {"purge_extra_sessions": 1, "stress": {"input": "dd", "threshold": 0.8}}, "limits": {"max_gross": 2.0}, "book": {"selection": []}, "compute": {"workers": 4},
}


def test_overlays_merge_and_named_entries_keep_their_fields():
    tree = S.load(BASE, [{"models": [{"name": "r", "alpha": 0.1}, {"name": "s", "alpha": 2.0}], "labels": {"horizons": [7]}, "walkforward": {"window_sessions": {"z": 9}}}], ["models.s.enabled=false", "labels.min_vol_window=6"])
    assert tree["models"] == [{"name": "r", "alpha": 0.1, "enabled": True}, {"name": "s", "alpha": 2.0, "enabled": False}]
    assert tree["labels"] == {"horizons": [7], "variants": ["rank"], "min_vol_window": 6}
    assert tree["walkforward"]["window_sessions"] == {"y": 252, "z": 9} and BASE["labels"]["horizons"] == [1, 5]


@pytest.mark.parametrize(
    ("text", "word"),
    [
        ("walkforward.retrain_every_months=2.5", "whole number from 1"), ("groups.purge_extra_sessions=-3", "whole number from 0"), ("labels.min_vol_window=1", "from 2"), ("limits.max_gross=none", "a number from 1"),
        ("environment.stress.threshold=1.01", "share"), ("environment.stress.input=[vol]", "one of"), ("labels.horizons=[2, 3, 2]", "different"), ("labels.variants=[rank, payoff_lx]", "variants"),
        ("walkforward.window_sessions.z=1", "named windows"), ("models.r.enabled=false", "enabled model"), ("benchmarks.random_draws=true", "whole number"),
        ("labels.horizon=3", "unknown key"), ("paths.unlock_file=other.yaml", "read-only"), ("no equals sign", "key.path=value"),
    ],
)
def test_bad_settings_are_refused(text, word):
    with pytest.raises(S.SettingsError, match=word):
        S.load(BASE, sets=[text])


def test_one_error_names_all_that_is_wrong():
    with pytest.raises(S.SettingsError, match="compute.workers = 0.*|labels.horizons = .*") as e:
        S.load(BASE, sets=["compute.workers=0", "labels.horizons=[]"])
    assert "compute.workers" in str(e.value) and "labels.horizons" in str(e.value)


def test_hash_ignores_what_changes_no_result():
    same = S.load(BASE, sets=["compute.workers=8", "run.notes=x"])
    assert S.settings_hash(same) == S.settings_hash(BASE) != S.settings_hash(S.load(BASE, sets=["labels.min_vol_window=6"]))


def test_table():
    assert S.markdown_table([{"a": 1.23456, "b": None}]) == "| a | b |\n| --- | --- |\n| 1.235 |  |"
