"""Training spans, boosted trees against a single-process grower, models by name, stored and read back."""

import numpy as np
import pandas as pd
import pytest

from loomspan.functions.settings import SettingsError
from loomspan.operators import boosting as B
from loomspan.operators import ingest as I
from loomspan.operators import learners as L
from loomspan.operators import models as M
from loomspan.operators import panel_ops as P
from loomspan.plans import run_queries


# -- spans ---------------------------------------------------------------------------------------------------------
def calendar(spark, start, end):
    days = pd.bdate_range(start, end)
    return spark.createDataFrame(pd.DataFrame({"session_idx": np.arange(len(days), dtype="int32"), "date": days.date}))


def test_retrains_are_first_sessions_of_months(spark):
    rows = I.retrain_schedule(calendar(spark, "2010-01-04", "2010-04-30"), 0, 1).orderBy("session_idx").collect()
    assert [str(r["date"]) for r in rows] == ["2010-01-04", "2010-02-01", "2010-03-01", "2010-04-01"]


def test_months_are_counted_from_the_data_and_then_cut(spark):
    days = calendar(spark, "2010-01-04", "2010-12-31")
    # a first session in the middle of a month makes no retrain there, and does not move the count
    rows = I.retrain_schedule(days, 30, 3).orderBy("session_idx").collect()
    assert [str(r["date"]) for r in rows] == ["2010-04-01", "2010-07-01", "2010-10-01"]


def spans_at(spark, retrain, window, first_row, back, history=252):
    return [tuple(r) for r in I.fits(spark.createDataFrame([(retrain,)], "session_idx int"), (1,), window, first_row, back, history).select("train_start", "train_end").collect()]


def test_windows_start_when_they_are_whole(spark):
    ends = lambda end: lambda h: 2000 - end
    assert spans_at(spark, 2000, 252, 0, ends(1000)) == [(1000 - 252 + 1, 1000)]
    assert spans_at(spark, 2000, 1260, 0, ends(1000)) == []
    assert spans_at(spark, 2000, None, 100, ends(300)) == []
    assert spans_at(spark, 2000, None, 100, ends(400)) == [(100, 400)]


def test_no_label_reads_the_retrain_session(spark):
    for h in P.HORIZONS:
        ((_, end),) = spans_at(spark, 2000, None, 0, lambda _, h=h: P.reach(h) + 1)
        assert end + P.reach(h) < 2000


def test_the_schedule_is_made_once_for_all_horizons(spark):
    back = lambda h: P.reach(h) + 1
    schedule = I.retrain_schedule(calendar(spark, "2010-01-04", "2012-12-31"), 400, 2)
    fits = I.fits(schedule, P.HORIZONS, 252, 3, back)
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(fits) == windows(schedule) == 1
    retrains = [r["session_idx"] for r in schedule.collect()]
    ends = [(s, h, s - back(h)) for s in retrains for h in P.HORIZONS]
    assert sorted(map(tuple, fits.collect())) == sorted((s, h, e - 251, e) for s, h, e in ends if e - 251 >= 3)
    assert dict(fits.dtypes)["h"] == "int"


def test_a_task_that_makes_the_rows_of_the_walk_forward_run_holds_few_pages(spark, tmp_path):
    """Measured, not planned: Spark's peak execution memory of each task, in pages of this session (each sort takes one at least)."""
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2010-01-04", periods=320)
    many = len(days) * 8
    lines = {"l_orderkey": np.arange(many), "l_linenumber": 1, "l_partkey": np.tile(np.arange(8), len(days)), "l_suppkey": 1, "l_quantity": 1.0, "l_extendedprice": rng.uniform(1e4, 2e4, many), "l_shipdate": np.repeat(days, 8)}
    spark.createDataFrame(pd.DataFrame(lines)).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(8)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    context = spark.sparkContext
    context.setJobGroup("momentum rows", "")
    try:
        assert run_queries.momentum_rows(spark, str(tmp_path)).count() == many
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    scala, tracker = context._jsc.sc(), context.statusTracker()
    scala.listenerBus().waitUntilEmpty()
    stages = {k for job in tracker.getJobIdsForGroup("momentum rows") for k in tracker.getJobInfo(job).stageIds}
    most = 0
    for k in stages:
        tasks = scala.statusStore().taskList(k, 0, 10_000)
        most = max([most, *(tasks.apply(i).taskMetrics().get().peakExecutionMemory() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined())])
    assert 0 < most <= 8 * context._jvm.org.apache.spark.SparkEnv.get().memoryManager().pageSizeBytes()


# -- trees ---------------------------------------------------------------------------------------------------------
def plain(bins, y, key, s, model):
    """Trees of one process, by looking at every split of every node's rows."""
    trees, score = [], np.full(len(y), y.mean())
    for k in range(s.num_boost_round):
        use = B.bagged(key, k, s)
        allowed = B.allowed_features(bins.shape[1], k, model, s)
        nodes, level, tree, leaves = {1: np.arange(len(y))}, [1], {}, 1
        values = {1: 0.0}
        for _ in range(s.depth):
            found = []
            for n in level:
                rows = nodes[n][use[nodes[n]]]
                r = y[rows] - score[rows]
                best = None
                for missing in (False, True):
                    for f in np.flatnonzero(allowed):
                        b = bins[rows, f]
                        for cut in range(1, s.max_bin):
                            left = np.where(b == 0, missing, b <= cut)
                            nl, nr = left.sum(), (~left).sum()
                            if min(nl, nr) < s.min_data_in_leaf:
                                continue
                            gain = r[left].sum() ** 2 / (nl + s.lambda_l2) + r[~left].sum() ** 2 / (nr + s.lambda_l2) - r.sum() ** 2 / (len(r) + s.lambda_l2)
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, f, cut, missing, r[left].sum() / (nl + s.lambda_l2), r[~left].sum() / (nr + s.lambda_l2))
                if best and best[0] > 1e-12:
                    found.append((best, n))
            level = []
            for best, n in sorted(found, key=lambda x: -x[0][0]):
                if leaves >= s.num_leaves:
                    continue
                leaves += 1
                _, f, cut, missing, vl, vr = best
                tree[n] = (f, cut, missing)
                b = bins[nodes[n], f]
                left = np.where(b == 0, missing, b <= cut)
                for child, side, v in ((2 * n, left, vl), (2 * n + 1, ~left, vr)):
                    nodes[child], values[child] = nodes[n][side], s.learning_rate * v
                    level.append(child)
        for n, rows in nodes.items():
            if n not in tree:
                score[rows] += values[n]
        trees.append(tree)
    return trees, score


def frame(seed=1, sessions=120, tickers=8):
    rng = np.random.default_rng(seed)
    n = sessions * tickers
    x = rng.normal(size=(n, 4))
    x[:, 2] = rng.integers(0, 3, n)
    y = np.where(x[:, 0] > 0.3, 1.0, -0.5) + 0.7 * x[:, 2] + 0.2 * x[:, 1] + rng.normal(size=n) * 0.3
    y2 = np.where(np.isnan(x[:, 1]), 2.0, -x[:, 1])
    x[rng.random((n, 4)) < 0.1] = np.nan
    rows = pd.DataFrame(x, columns=list("abcd"))
    rows["session_idx"], rows["ticker"] = np.repeat(np.arange(sessions, dtype="int32"), tickers), [f"T{i}" for i in range(tickers)] * sessions
    rows["y"], rows["z"] = y, y2
    rows["tradable"] = rng.random(n) > 0.05
    return rows


SMALL = {"num_leaves": 5, "learning_rate": 0.3, "num_boost_round": 10, "min_data_in_leaf": 15, "max_bin": 15, "lambda_l2": 1.0, "seed": 3}


@pytest.mark.parametrize("more", [{}, {"feature_fraction": 0.5, "bagging_fraction": 0.6, "bagging_freq": 2}])
def test_trees_are_those_of_one_process(spark, more):
    s = B.Settings(**SMALL | more)
    rows = frame()
    data = spark.createDataFrame(rows).repartition(5)
    features, targets = list("abcd"), ["y", "z"]
    cuts = B.quantile_cuts(data, features, s.max_bin)
    table = B.bin_rows(data, features, targets, cuts)
    models, spans = [(90, 1, "y"), (90, 1, "z"), (60, 1, "y")], [(0, 80, 0), (0, 80, 1), (10, 50, 0)]
    grown = B.grow(table, 4, models, spans, [(0, 1)] * 3, s, 50)
    got = table.toPandas()
    bins = np.array([np.frombuffer(b, np.uint8) for b in got["bins"]])
    y = np.array(got["y"].tolist())
    for m, (first, last, t) in enumerate(spans):
        mine = ((got["session_idx"] >= first) & (got["session_idx"] <= last)).to_numpy()
        trees, score = plain(bins[mine], y[mine][:, t], got["key"].to_numpy()[mine], s, models[m])
        np.testing.assert_allclose(grown[m].base + B.predict(grown[m], bins[mine], s.depth), score, atol=1e-9)
        for k, tree in enumerate(trees):
            assert {n: (int(grown[m].feature[k, n]), int(grown[m].bin[k, n]), bool(grown[m].missing_left[k, n])) for n in np.flatnonzero(grown[m].feature[k] >= 0)} == {n: (int(f), c, miss) for n, (f, c, miss) in tree.items()}


def test_cuts_do_not_see_later_rows(spark):
    rows = frame()
    late = rows.copy()
    late.loc[late["session_idx"] > 80, list("abcd")] *= 1000
    spec = {"name": "t", "kind": "boosted", "params": SMALL}
    fits = spark.createDataFrame([(90, 1, 0, 80)], "retrain int, h int, train_start int, train_end int")
    same = [L.make(spec).over(spans=L.spans_of(fits), features=list("abcd"), targets={1: ["y"]}).fit(spark.createDataFrame(r)).trees.drop("target").collect() for r in (rows, late)]
    assert same[0] == same[1]


def test_held_out_rows_are_forecast(spark):
    rows = frame(sessions=200)
    fits = spark.createDataFrame([(120, 1, 0, 110), (160, 1, 0, 150)], "retrain int, h int, train_start int, train_end int")
    out = L.walk_forward(spark.createDataFrame(rows), fits, list("abcd"), {1: ["y"]}, {"name": "t", "kind": "lightgbm", "params": SMALL | {"num_boost_round": 30}}).toPandas()
    got = out.merge(rows, on=["session_idx", "ticker"])
    assert len(got) == int((rows["tradable"] & (rows["session_idx"] >= 120)).sum())
    assert set(got.loc[got["session_idx"] >= 160, "retrain"]) == {160}
    assert ((got["pred"] - got["y"]) ** 2).mean() < 0.35 * got["y"].var()


# -- models by name ------------------------------------------------------------------------------------------------
def test_ridge_by_name_fits_each_span(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"session_idx": np.repeat(np.arange(260), 3), "ticker": list("ABC") * 260, "tradable": rng.random(780) > 0.1, "f": rng.normal(size=780), "g": rng.normal(size=780), "y1": rng.normal(size=780), "y3": rng.normal(size=780)})
    rows["session_idx"] = rows["session_idx"].astype("int32")
    spans = [(200, 1, 0, 189), (230, 1, 0, 219), (200, 3, 100, 179), (230, 3, 130, 209)]
    fits = spark.createDataFrame(spans, "retrain int, h int, train_start int, train_end int")
    got = L.walk_forward(spark.createDataFrame(rows), fits, ["f", "g"], {1: ["y1"], 3: ["y3"]}, {"name": "r", "kind": "ridge", "alpha": 1.0}).toPandas()
    assert len(got) == 2 * int((rows["tradable"] & (rows["session_idx"] >= 200)).sum())
    for retrain, h, a, b in spans:
        t = rows[rows["tradable"] & (rows["session_idx"] >= a) & (rows["session_idx"] <= b)]
        w, centre, base = M.solve(M.reduce_rows(t[["f", "g"]].to_numpy(), t[[f"y{h}"]].to_numpy()), 1.0)
        mine = got[(got["retrain"] == retrain) & (got["h"] == h)].merge(rows, on=["session_idx", "ticker"])
        assert mine["session_idx"].min() == retrain
        np.testing.assert_allclose(mine["pred"], ((mine[["f", "g"]].to_numpy() - centre) @ w + base)[:, 0], atol=1e-9)


@pytest.mark.parametrize("spec", [{"name": "r", "kind": "ridge", "alpha": 0.1}, {"name": "t", "kind": "boosted", "params": SMALL}])
def test_models_are_stored_and_read_back(spark, tmp_path, spec):
    rows = spark.createDataFrame(frame())
    fits = spark.createDataFrame([(60, 1, 0, 50), (90, 1, 0, 80)], "retrain int, h int, train_start int, train_end int")
    path = str(tmp_path / "model")
    order = ["retrain", "h", "target", "session_idx", "ticker"]
    made = L.walk_forward(rows, fits, list("abcd"), {1: ["y", "z"]}, spec, store=path).toPandas().sort_values(order, ignore_index=True)
    again = L.stored(spark, spec, path).transform(rows).toPandas().sort_values(order, ignore_index=True)
    assert len(made) > 0
    pd.testing.assert_frame_equal(made, again)


def test_rows_that_train_and_rows_that_are_asked_differ(spark):
    rows = frame()
    rows["trains"], rows["asked"] = rows["a"].notna(), True
    fits = spark.createDataFrame([(90, 1, 0, 80)], "retrain int, h int, train_start int, train_end int")
    for spec in ({"name": "r", "kind": "ridge"}, {"name": "t", "kind": "boosted", "params": SMALL}):
        out = L.walk_forward(spark.createDataFrame(rows), fits, list("abcd"), {1: ["y"]}, spec, trains="trains", asked="asked")
        assert out.count() == int((rows["session_idx"] >= 90).sum())


def test_kinds_are_plugged_in_and_refused():
    with pytest.raises(SettingsError, match="unknown model kind"):
        L.make({"name": "x", "kind": "forest"})
    with pytest.raises(TypeError):
        L.make({"name": "x", "kind": "boosted", "params": {"leaves": 3}})
    L.kind("mean")(lambda spec, defaults: L.RidgeSpans(1e9))
    try:
        assert isinstance(L.make({"name": "x", "kind": "mean"}), L.RidgeSpans)
    finally:
        del L.KINDS["mean"]


def test_fits_without_rows_give_nothing(spark):
    rows = spark.createDataFrame(frame())
    fits = spark.createDataFrame([(90, 1, 0, 2)], "retrain int, h int, train_start int, train_end int")
    for spec in ({"name": "r", "kind": "ridge"}, {"name": "t", "kind": "boosted", "params": SMALL}):
        assert L.walk_forward(rows, fits, list("abcd"), {1: ["y"]}, spec).count() == 0


# -- SQL calls -----------------------------------------------------------------------------------------------------
def test_sql_calls_agree_with_frames(spark):
    from loomspan.functions import sql_callable

    rng = np.random.default_rng(2)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.integers(0, 30))) for k in ("x", "y", "z") for i in range(120)] + [("bare", 0, None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(str(k), int(i), v) for k, i, v in rows], "key string, session_idx int, value double").repartition(5)
    frame.createOrReplaceTempView("sql_values")
    sql_callable.register(spark)
    get = lambda df: {(r[0], r[1]): None if r[2] is None or r[2] != r[2] else round(r[2], 9) for r in df.collect()}
    pct = spark.sql("SELECT * FROM expanding_pct(TABLE(sql_values) PARTITION BY (key) ORDER BY (session_idx), 30)")
    assert get(pct) == get(I.expanding_pct(frame, 30))
    ema = spark.sql("SELECT * FROM ts_ema(TABLE(sql_values) PARTITION BY (key) ORDER BY (session_idx), 12)")
    want = I.ema_columns(frame.select(frame.key.alias("ticker"), "session_idx", frame.value.alias("close")), (12, 26)).select("ticker", "session_idx", "ema_12")
    assert get(ema) == get(want)
    ranked = spark.sql("SELECT key, session_idx, rank_past(value, 5) OVER (PARTITION BY key ORDER BY session_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) FROM sql_values")
    by = {k: [v for _, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: int(r[1]))] for k in ("x", "y", "z", "bare")}
    for (k, i), got in get(ranked).items():
        now, past = by[k][i], [v for v in by[k][max(0, i - 9) : i] if v is not None]
        share = None if now is None or len(past) < 5 else round((sum(p < now for p in past) + sum(p == now for p in past) / 2) / len(past), 9)
        assert got == share
