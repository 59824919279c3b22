"""What the groups, environment and book stages leave behind, each under one commit (orchestrator.commit).

Tables are long: a row for each session and series, so a reader prunes by column and a stage of any size is written by
the cluster.  The small ones (maps, tables of measures) are Parquet too; settings and reports are text.
"""

from __future__ import annotations

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.settings import SettingsError, markdown_table, settings_hash
from loomspan.operators import book as K
from loomspan.operators import evaluation as E
from loomspan.operators import orchestrator as O

ENSEMBLE, ENSEMBLE_ALL = "grp_ens", "grp_ens_all_h"


def _settings(settings: dict, section: str, run_settings: dict) -> str:
    kept = {section: settings.get(section), "evaluation": settings.get("evaluation"), "model_defaults": settings.get("model_defaults"), "run_settings_hash": settings_hash(run_settings)}
    return yaml.safe_dump(kept, sort_keys=False)


def groups(folder: str, group_map: DataFrame, group_rows: DataFrame, preds: DataFrame, eligible: DataFrame, variant: str, variants: list[str], settings: dict, run_settings: dict) -> str:
    """group_map, group_rows (features and labels), percentiles (a series for each model, window, h), scores (h null: all
    horizons) and etf_scores, which have the layout of a model's predictions: model, window, variant, h, session_idx, ticker, pred.

    grp_ens has each horizon's own score, grp_ens_all_h the score of all horizons under every horizon.
    """
    if variant not in variants:
        raise SettingsError(f"the score variant {variant} is no label variant of the run")
    pct = K.group_percentiles(preds)
    each = pct.groupBy("h", "session_idx", "group").agg(F.avg("pct").alias("score"))
    every = K.group_score(pct).select(F.lit(None).cast("int").alias("h"), "session_idx", "group", "score")
    own = K.groups_source(each, group_map, eligible, ("h",)).select(F.lit(ENSEMBLE).alias("model"), "h", "session_idx", "ticker", "score")
    horizons = preds.select("h").distinct()  # a handful
    shared = K.groups_source(every.drop("h"), group_map, eligible).crossJoin(F.broadcast(horizons)).select(F.lit(ENSEMBLE_ALL).alias("model"), "h", "session_idx", "ticker", "score")
    etf = own.unionByName(shared).filter("score is not null").select("model", F.lit("all").alias("window"), F.lit(variant).alias("variant"), "h", "session_idx", "ticker", F.col("score").alias("pred"))
    tables = {"group_map": group_map, "group_rows": group_rows, "percentiles": pct, "scores": each.unionByName(every), "etf_scores": etf}
    return O.commit(preds.sparkSession, folder, tables, {"settings.yaml": _settings(settings, "groups", run_settings)})


def predictability(preds: DataFrame, outcomes: DataFrame, reach, first: int, stop: int, min_sessions: int = 252, least: int = 100) -> DataFrame:
    """target, h, model, spearman, t, oos_r2 of forecasts (target, h, model, session_idx, pred) of outcomes (target, h, session_idx, y).

    reach: of a horizon, the sessions until an outcome is known.
    """
    horizons = [r[0] for r in outcomes.select("h").distinct().orderBy("h").collect()]  # a handful
    joined = outcomes.join(preds, ["target", "h", "session_idx"]).select("h", F.to_json(F.struct("target", "model")).alias("key"), "session_idx", F.col("pred").alias("p"), "y")
    parts = []
    for h in horizons:
        rows = joined.filter(F.col("h") == h)
        found = E.spearman(rows, h, first, stop, least).select("key", "spearman", "t").join(E.oos_r2(rows, reach(h), min_sessions, first, stop, least).select("key", "oos_r2"), "key", "left")
        name = F.from_json("key", "target string, model string")
        parts.append(found.select(name["target"].alias("target"), F.lit(h).alias("h"), name["model"].alias("model"), "spearman", "t", "oos_r2"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def environment(folder: str, basket: DataFrame, outcomes: DataFrame, persistence: DataFrame, preds: DataFrame, stress: DataFrame, reach, first: int, stop: int, settings: dict, run_settings: dict, least: int = 100) -> str:
    """basket, outcomes, persistence, predictions, predictability (of every model and of persistence) and stress."""
    both = preds.select("target", "h", "model", "session_idx", "pred").unionByName(persistence.select("target", "h", F.lit("persistence").alias("model"), "session_idx", "pred"))
    tables = {
        "basket": basket, "outcomes": outcomes, "persistence": persistence, "predictions": preds,
        "predictability": predictability(both, outcomes, reach, first, stop, least=least).coalesce(1), "stress": stress,
    }
    return O.commit(preds.sparkSession, folder, tables, {"settings.yaml": _settings(settings, "environment", run_settings)})


def ranked_books(books: DataFrame, by: str = "sharpe_excess") -> DataFrame:
    """The books from the best to the worst; unknown measures last, ties by name."""
    return books.orderBy(F.desc_nulls_last(by), *[c for c in books.columns if c != by and c in ("source", "rule", "switch", "gross", "rebalance_every_sessions", "book_id")])


def _table(df: DataFrame) -> str:
    return markdown_table([r.asDict() for r in df.collect()])  # a table that the report prints


def book(folder: str, books: DataFrame, baselines: DataFrame, controls: DataFrame | None, choices: list[str], measures: list[str], settings: dict, run_settings: dict) -> str:
    """books, baselines, controls (where there are some) and REPORT.md: how the stage was set, the books it made from
    the best on, what each choice does to the middle book, and what the baselines and controls reach."""
    shown = [c for c in (*choices, *measures) if c in books.columns]
    middle = lambda c: F.median(c).alias(c)
    parts = ["# Books", f"{books.count()} books; measures are net of cost.", "## From the best on", _table(ranked_books(books.select(*shown)))]
    for choice in choices:
        parts += [f"## The middle book by {choice}", _table(books.groupBy(choice).agg(*[middle(m) for m in measures], F.count(F.lit(1)).alias("books")).orderBy(choice))]
    parts += ["## Baselines", _table(baselines.select(*[c for c in baselines.columns if c not in ("net",)]))]
    tables = {"books": books, "baselines": baselines}
    if controls is not None:
        tables["controls"] = controls
        stat: list[Column] = [f(m).alias(f"{m}_{n}") for m in measures if m in controls.columns for n, f in (("median", F.median), ("max", F.max))]
        parts += ["## Controls", _table(controls.groupBy("family").agg(*stat).orderBy("family"))]
    texts = {"settings.yaml": _settings(settings, "book", run_settings), "REPORT.md": "\n\n".join(parts) + "\n"}
    return O.commit(books.sparkSession, folder, tables, texts)
