"""What settings must be to each other, and reading them from files.

Entries (models, sources of books, selection rules) have a shape by their kind: which fields, and what each may be.
Relations look at several settings at once and say what is wrong, or nothing.  Sections that a tree lacks are not
looked at, so the same relations hold for the settings of one stage.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import yaml

from loomspan.functions.settings import RULES, SettingsError, _int, _number, _unique_list, check, label_variant, load

LEAST_ROWS = 1000  # rows that a fit needs
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def file_name(x: Any) -> bool:
    return isinstance(x, str) and bool(_NAME.fullmatch(x)) and ".." not in x


def _above(low: float, high: float = float("inf")) -> Callable[[Any], bool]:
    return lambda x: _number(low, high)(x) and x > low


def _all_or(ok: Callable[[Any], bool]) -> Callable[[Any], bool]:
    return lambda x: x == "all" or _unique_list(ok)(x)


def _tree_params(x: Any) -> bool:
    return isinstance(x, dict) and not {"objective", "num_threads"} & set(x) and x.get("min_data_in_leaf", 20) <= LEAST_ROWS


def _series(x: Any) -> bool:
    return isinstance(x, str) and len(x.split("__")) == 2 and all(map(file_name, x.split("__")))


# the shape of an entry, by its kind: fields it must have, fields it may have
Shape = tuple[dict[str, Callable[[Any], bool]], dict[str, Callable[[Any], bool]]]
_flag = lambda x: isinstance(x, bool)
MODEL: dict[str, Shape] = {
    "ridge": ({"name": file_name, "kind": str, "alpha": _above(0)}, {"enabled": _flag}),
    "lightgbm": ({"name": file_name, "kind": str}, {"params": _tree_params, "enabled": _flag}),
}
SOURCE: dict[str, Shape] = {
    "predictions": ({"kind": str, "files": _all_or(_series), "variants": _unique_list(label_variant), "horizons": _all_or(_int(1))}, {}),
    "groups": ({"kind": str, "horizons": _all_or(_int(1))}, {}),
    "mean": ({"kind": str, "of": _unique_list(file_name)}, {}),
}
SELECTION: dict[str, Shape] = {
    "top_fraction": ({"name": str, "enabled": _flag, "fraction": _above(0, 1)}, {}),
    "score_capped": ({"name": str, "enabled": _flag, "max_weight": _above(0, 1), "max_group_weight": _above(0, 1), "iterations": _int(1)}, {"score_powers": _unique_list(_above(0))}),
}


def misshapen(entry: Any, shapes: dict[str, Shape], by: str) -> Iterator[str]:
    """What is wrong with an entry."""
    kind = entry.get(by) if isinstance(entry, dict) else None
    if kind not in shapes:
        yield f"{by} {kind!r} is none of {', '.join(shapes)}"
        return
    must, may = shapes[kind]
    yield from (f"lacks {f}" for f in must if f not in entry)
    yield from (f"has an unknown field {f}" for f in entry if f not in must and f not in may)
    yield from (f"{f} = {v!r} is not allowed" for f, v in entry.items() if f in (must | may) and not (must | may)[f](v))


def enabled(entries: list[dict]) -> list[dict]:
    return [e for e in entries if isinstance(e, dict) and e.get("enabled", True)]


def rule_names(selection: list[dict]) -> set[str]:
    """Names of the rules that a book can have: a power other than 1 makes a rule of its own."""
    powers = {f"{r['name']}_p{float(p):g}" for r in enabled(selection) for p in r.get("score_powers") or () if p != 1}
    return {r["name"] for r in enabled(selection)} | powers


def _date(x: Any) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def _models(t: dict) -> Iterator[str]:
    names = [m.get("name") for m in t["models"]]
    yield from (f"two models are called {n}" for n in {n for n in names if names.count(n) > 1})
    for m in t["models"]:
        yield from (f"model {m.get('name')} {e}" for e in misshapen(m, MODEL, "kind"))


def _windows(t: dict, tickers: int | None) -> Iterator[str]:
    sizes = t["walkforward"]["window_sessions"]
    yield from (f"window {w} has no length" for w in t["walkforward"]["windows"] if w != "expanding" and w not in sizes)
    if not t["walkforward"]["windows"]:
        yield "there is no window"
    if tickers is not None:
        yield from (f"window {w} of {n} sessions cannot hold {LEAST_ROWS} rows" for w, n in sizes.items() if isinstance(n, int) and n * tickers < LEAST_ROWS)


def _periods(t: dict) -> Iterator[str]:
    e, fence = t["evaluation"], _date(t["data"]["fence_date"])
    start, end = _date(e["common_start"]), None if e.get("end") is None else _date(e["end"])
    blocks = [(_date(a), _date(b)) for a, b in e["blocks"]]
    if not start < fence or end is not None and not start < end < fence:
        yield "the evaluation is not before the fence, or ends before it starts"
    if any(a > b for a, b in blocks) or any(x[1] >= y[0] for x, y in zip(blocks, blocks[1:], strict=False)):
        yield "blocks overlap or are out of order"
    if any(a < start or b >= fence for a, b in blocks):
        yield "a block is outside the evaluation"


def _books(t: dict) -> Iterator[str]:
    b, most = t["book"], t["limits"]["max_gross"]
    sources = b["sources"]
    if not sources or not all(map(file_name, sources)):
        yield "books need named sources"
    for name, s in sources.items():
        wrong = list(misshapen(s, SOURCE, "kind"))
        yield from (f"source {name} {e}" for e in wrong)
        if not wrong and s["kind"] == "mean" and any(o == name or o not in sources or sources[o].get("kind") == "mean" for o in s["of"]):
            yield f"source {name} is the mean of something that is no source of its own"
    for r in b["selection"]:
        yield from (f"rule {r.get('name') if isinstance(r, dict) else r} {e}" for e in misshapen(r, SELECTION, "name"))
    yield from (f"rule {r['name']} allows more for one asset than for its group" for r in enabled(b["selection"]) if r.get("max_weight", 0) > r.get("max_group_weight", 1))
    if not enabled(b["selection"]):
        yield "no rule is switched on"
    if not _unique_list(_flag)(b["switch"]["states"]) or not _number(0, 1)(b["switch"]["defensive_share"]):
        yield "the switch has no states, or moves less than nothing or more than all"
    if not b["gross"] or not all(_above(0, most)(g) for g in b["gross"]):
        yield f"gross exposure is not above 0 and {most} at most"
    if not b["rebalance_every_sessions"] or not all(map(_int(1), b["rebalance_every_sessions"])):
        yield "books are not rebalanced every whole number of sessions"
    c = b["controls"]
    place = {"source": set(sources), "rule": rule_names(b["selection"]), "switch": set(b["switch"]["states"]), "gross": set(b["gross"]), "rebalance_every_sessions": set(b["rebalance_every_sessions"])}
    off = [k for k, known in place.items() if c["reference"].get(k) not in known]
    if off:
        yield f"the reference book is not in the grid: {', '.join(off)}"
    yield from (f"{k} is no number of draws" for k in ("shuffle_draws", "random_switch_draws") if not _int(0)(c[k]))


def _odds(t: dict) -> Iterator[str]:
    source, threads = t.get("groups", {}).get("source_run"), t.get("compute", {}).get("lightgbm_threads")
    if source is not None and not file_name(source):
        yield "groups.source_run is no name of a run"
    if threads is not None and not _int(1)(threads):
        yield "compute.lightgbm_threads is no number of threads"
    ridge = t.get("model_defaults", {}).get("ridge", {})
    if ridge and (ridge.get("device") not in ("auto", "cpu", "gpu") or ridge.get("cpu_precision") not in ("float32", "float64")):
        yield "model_defaults.ridge names an unknown device or precision"


def wrongs(tree: dict, tickers: int | None = None) -> list[str]:
    """Everything that is wrong between the settings; tickers: how many the universe has."""
    looks: list[tuple[tuple[str, ...], Callable[[dict], Iterator[str]]]] = [
        (("models",), _models), (("walkforward",), lambda t: _windows(t, tickers)), (("evaluation", "data"), _periods), (("book", "limits"), _books), ((), _odds),
    ]
    return [said for sections, look in looks if all(s in tree for s in sections) for said in look(tree)]


def check_all(tree: dict, tickers: int | None = None) -> dict:
    """The settings, or one error that names everything that is wrong with any of them or between them."""
    said = wrongs(tree, tickers)
    try:
        check(tree, RULES)
    except SettingsError as error:
        said.insert(0, str(error))
    if said:
        raise SettingsError("; ".join(said))
    return tree


def read_file(path: str | Path) -> dict:
    """A YAML file that holds a mapping; an empty one is empty settings."""
    tree = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if tree is None:
        return {}
    if not isinstance(tree, dict):
        raise SettingsError(f"{path} holds no mapping")
    return tree


def load_files(base: str | Path, overlays: list[str | Path] = (), sets: list[str] = (), tickers: int | None = None) -> dict:
    """Settings of a base file, overlay files and assignments, checked one by one and against each other."""
    return check_all(load(read_file(base), [read_file(p) for p in overlays], list(sets), rules=[]), tickers)
