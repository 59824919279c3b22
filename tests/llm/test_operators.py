"""Corpus operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import chat, components, decontaminate, html_extract, jaccard_join, license_scan, packing, quality_classifier, quality_rules, substring_dedup, token_binary

BLANK = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(t):
    return (t or "").translate(LOWER)


def corpus(n=60, seed=1):
    """Texts with near copies, exact copies, shared passages, odd white space, null and empty ones."""
    rng = random.Random(seed)
    vocabulary = [w + s for w in "alpha beta gamma delta éta zeta Theta iota kappa lambda".split() for s in ["", ".", "s", "é", "X"]]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base, passage = [say(rng.randint(20, 90)) for _ in range(8)], say(30)
    out = []
    for i in range(n):
        w = list(rng.choice(base)) if i % 3 else say(rng.randint(1, 80))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 4 == 0:
            w = w[:10] + passage + w[10:]
        out.append((i * 7 % 101, rng.choice([" ", "  ", "\n", "\t"]).join(w)))
    return [*out, out[3], (900, None), (901, ""), (902, " \n "), (903, "one"), (904, "one"), (None, "null id text"), (905, " ".join(say(9000)))]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def key(d, t):
    return (d is None, d or 0, t or "")


# -- 1 -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("block_bytes", "pass_bytes"), [(1 << 20, 1 << 30), (700, 1 << 30), (700, 2000)])
def test_contamination_is_exact(spark, docs, rows, block_bytes, pass_bytes):
    items = [(i, " ".join(BLANK.findall(t)[:k])) for i, ((_, t), k) in enumerate(zip(rows[:12], (40, 12, 10, 9, 3, 1, 25, 0, 60, 11, 30, 2), strict=True))]
    items += [(3, items[0][1]), (77, None), (78, "..."), (None, items[1][1]), (80, next(t for d, t in rows if d == 905)), *[(81, items[10][1])] * 5]
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).update([] if i is None else [str(i)])
    sizes, whole = {len(w) for w in windows}, [ALNUM.findall(lower(t)) for _, t in items]
    expected = []
    for d, t in rows:
        w, hit, found, longest = ALNUM.findall(lower(t)), set(), set(), 0
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[j : j + size]))) is not None:
                    hit.update(range(j, j + size))
                    found |= names
                    longest = max(longest, size)
        for v in whole:  # longest common stretch with an item of more words than a window
            ahead = [0] * (len(v) + 1)
            for a in range(len(w) - 1, -1, -1) if len(v) < 200 else ():
                ahead = [1 + ahead[b + 1] if w[a] == v[b] else 0 for b in range(len(v))] + [0]
                longest = max([longest, *[x for x in ahead if x >= 10]])
        if d == 905:
            longest = len(w)
        expected.append((key(d, t), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest))
    got = decontaminate.contamination(docs.withColumn("n_words", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, pass_bytes=pass_bytes)
    got = [(key(r["doc_id"], r["text"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["longest_match"]) for r in got.collect()]
    assert sorted(got) == sorted(expected)


def test_match_spans(spark):
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[:30])), (2, " ".join(w[20:50])), (3, "one two"), (4, None)]
    docs = [(10, " ".join(["x", *w[5:25], "y", *w[15:40]])), (11, " ".join(w[:9])), (12, "zero one two three one two"), (13, None), (14, " ".join([*w[:12], *w[:12]]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    expected = [(10, "1", 5, 1, 20), (10, "1", 15, 22, 15), (10, "2", 0, 27, 20), (12, "3", 0, 1, 2), (12, "3", 0, 4, 2), (14, "1", 0, 0, 12), (14, "1", 0, 12, 12)]
    for block_bytes, pass_bytes in ((1 << 20, 1 << 30), (16, 1 << 30), (16, 150)):
        assert sorted(tuple(r) for r in decontaminate.matches(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, pass_bytes=pass_bytes).collect()) == expected


def test_decontaminate_with_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, nothing).count() == docs.count()
    assert decontaminate.decontaminate(docs.limit(0), nothing).count() == 0


# -- 2 -----------------------------------------------------------------------------------------------------------
def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = BLANK.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("large", [2_000, 6])
def test_components_are_exact(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "_TASK", large)
    rng = random.Random(5)
    rows = [(d, t) for d, t in corpus(30, 2) if d is not None]
    chain = [f"w{i}" for i in range(60)]
    for k in range(24):  # a long chain of near copies, and a star of edits
        rows.append((2000 + k, " ".join(chain[: 30 + k])))
        edit = list(chain)
        edit[rng.randrange(60)] = f"e{k}"
        rows.append((3000 + k, " ".join(edit)))
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert found == brute_components(rows)


@pytest.mark.parametrize("seed", range(6))
def test_cells_find_all_links(seed):
    """The recursive cells of one region against all pairs, and that there are levels and cells of them."""
    rng = random.Random(seed)
    sets, words = [], range(4000)
    for _ in range(rng.choice([3, 12])):
        base = rng.sample(words, 40)
        for _ in range(rng.choice([5, 25])):
            one = list(base)
            for _ in range(rng.choice([1, 3, 6, 9])):
                one[rng.randrange(40)] = rng.choice(words)
            sets.append(sorted(set(one[: rng.choice([40, 40, 33])])))
    sets = [list(x) for x in sorted({tuple(x) for x in sets})]
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    held = jaccard_join._Sets(rows, np.array([h for x in sets for h in x], np.uint64), len(sets))
    log = []
    edges = jaccard_join._join(held, 75, np.arange(len(sets)), np.arange(len(sets)), True, log)
    linked = lambda x, y: 100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y))
    assert all(linked(sets[a], sets[b]) for a, b in edges)

    def components(pairs):
        of = list(range(len(sets)))
        for a, b in pairs:
            of = [min(of[a], of[b]) if c in (of[a], of[b]) else c for c in of]
        return of

    assert components(edges) == components([(a, b) for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b])])
    if len(sets) > 60:
        assert len(log) > 1 and max(depth for depth, *_ in log) >= 1


def test_jaccard_counters_reach_the_driver_as_bytes(spark):
    from types import SimpleNamespace

    from loomspan.llm import common

    rng = np.random.default_rng(5)
    hashes = [rng.integers(-(2**63), 2**63 - 1, 60_000), rng.integers(-(2**63), 2**63 - 1, 60_000)]
    hashes[1][:5_000] = hashes[0][0]
    lists = spark.createDataFrame([(h.tolist(),) for h in hashes], "hs array<long>").repartition(2)
    rows = jaccard_join._frequencies(lists).collect()
    assert len(rows) <= jaccard_join._COUNTERS // jaccard_join._BLOCK and sum(len(r["levels"]) for r in rows) <= jaccard_join._COUNTERS
    table = np.zeros((jaccard_join._COUNTERS // jaccard_join._BLOCK, jaccard_join._BLOCK), np.uint8)
    for block, levels in rows:
        table[block] = np.frombuffer(levels, np.uint8)
    n = np.bincount((np.concatenate(hashes).view(np.uint64) >> np.uint64(44)).astype(np.int64), minlength=jaccard_join._COUNTERS)
    order = np.argsort(n, kind="stable")
    assert (np.diff(table.reshape(-1)[order].astype(int)) >= 0).all() and ((table.reshape(-1) > 0) == (n > 0)).all() and table.max() == 8 * math.log2(n.max() + 1) // 1

    # garbage is collected between the steps, but only where the heap has grown
    calls = []
    heap = SimpleNamespace(totalMemory=lambda: 300, maxMemory=lambda: 750)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: calls.append(1)))))
    common.tidy(SimpleNamespace(_jvm=jvm))
    assert not calls
    heap.totalMemory = lambda: 400
    common.tidy(SimpleNamespace(_jvm=jvm))
    assert calls == [1]


def test_rounds_of_components_are_planned_one_star_at_a_time(spark, monkeypatch):
    read = []
    write = components.materialise

    def watched(df, label, *keys):
        read.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, label, *keys)

    monkeypatch.setattr(components, "materialise", watched)
    edges = write(spark.createDataFrame([(i, i + 1) for i in range(1, 20)], "a long, b long"), "path")
    got = components.connected_components(edges).collect()
    assert {r["node"] for r in got} == set(range(1, 21)) and {r["root"] for r in got} == {1}
    assert len(read) > 3 and max(read) <= 4  # the edges that each plan reads: both stars in one would read them 12 times


def test_native_memory_of_the_driver_is_given_back(spark, monkeypatch):
    from types import SimpleNamespace

    from loomspan.llm import common

    commands = spark._jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getSpecVersion()
    assert common._trim(spark) or int(commands.split(".")[0]) < 17
    assert not common._trim(SimpleNamespace(_jvm=None))  # without such a command nothing fails
    calls = []
    monkeypatch.setattr(common, "_trim", calls.append)
    common.materialise(spark.range(3).toDF("a"), "small")
    assert calls == [spark]


def test_connected_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 9)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(9)}


@pytest.mark.parametrize(("seed", "chunk"), [(0, 1 << 20), (1, 8), (2, 50)])
def test_edges_are_contracted_without_loss(monkeypatch, seed, chunk):
    import pyarrow as pa

    monkeypatch.setattr(components, "_CHUNK", chunk)
    monkeypatch.setattr(components, "_BATCH", 3)
    rng = np.random.default_rng(seed)
    ids = rng.integers(-(2**63), 2**63 - 1, 120)
    edges = [(ids[i], ids[i + 1]) for i in range(30)] + [(ids[a], ids[b]) for a, b in rng.integers(31, 120, (60, 2))]
    of = {x: x for e in edges for x in e}
    for a, b in edges:
        of = {x: min(of[a], of[b]) if c in (of[a], of[b]) else c for x, c in of.items()}
    batches = [pa.RecordBatch.from_pydict({"a": [int(a) for a, _ in edges[i : i + 7]], "b": [int(b) for _, b in edges[i : i + 7]]}) for i in range(0, len(edges), 7)]
    stars = list(components._contracted(iter(batches)))
    assert all(a > b for x in stars for a, b in zip(*x.to_pydict().values(), strict=True))
    got = {n: r for x in components._rooted(iter(stars)) for n, r in zip(*x.to_pydict().values(), strict=True)}
    loops = {a for a, b in edges if a == b}
    assert {x: c for x, c in of.items() if x in got} == got and set(of) - set(got) <= loops
    assert not list(components._contracted(iter(()))) and not list(components._rooted(iter(())))


def test_few_edges_are_connected_in_one_task(spark, monkeypatch):
    """Rounds of stars cost five shuffles each, however few the edges are; more edges than a task holds go through them."""
    chain = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join(chain[: 30 + k])) for k in range(24)], "doc_id long, text string").repartition(3)
    written = []
    write = components.materialise

    def watched(df, label, *keys):
        written.append(label)
        return write(df, label, *keys)

    monkeypatch.setattr(components, "materialise", watched)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs).collect()}
    assert found == dict.fromkeys(range(24), 0)
    assert written == ["regions", "regions", "links", "links"]
    written.clear()
    monkeypatch.setattr(jaccard_join, "_EDGES", 3)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs).collect()} == found
    assert len(written) > 4


@pytest.mark.parametrize(("within", "tables"), [(400, 2), (100, 3), (20, 0)])
def test_edges_that_many_tasks_know_are_contracted_again(spark, monkeypatch, within, tables):
    written = []
    write = components.materialise

    def watched(df, label, *keys):
        written.append(label)
        return write(df, label, *keys)

    monkeypatch.setattr(components, "materialise", watched)
    edges = spark.sparkContext.parallelize([(i, i + 1) for _ in range(8) for i in range(39)], 8).toDF("a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges, "path", within).collect()}
    assert got == dict.fromkeys(range(40), 0)
    assert len(written) == tables if tables else len(written) > 4


# -- 3 -----------------------------------------------------------------------------------------------------------
def test_quality_measures(spark, docs, rows):
    extra = [(5000, "#a b c\n#a b c\n#a b c\n|\n\n"), (5001, "a b a b a b a"), (5002, "x " * 5000)]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {key(r["doc_id"], None)[:2]: r for r in quality_rules.measures(both.withColumn("n_lines", F.lit(1))).collect()}
    for d, t in rows + extra:
        w = BLANK.findall(t or "")
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        lines = [x for x in (t or "").split("\n") if BLANK.search(x)]
        r = got[key(d, None)[:2]]
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len({j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected


@pytest.mark.parametrize(("k", "n", "p"), [(0, 50, 0.02), (3, 200, 0.05), (10, 1000, 0.02), (0, 1, 0.1), (60, 100000, 0.001)])
def test_binomial_tail(spark, k, n, p):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(exact if k < n * p else 1.0, rel=1e-7)


def test_thresholds_limit_false_rejection(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        words = [rng.choice("aa bb cc dd ee ff gg hh".split()) + str(rng.randrange(40)) + ("" if good else "###") for _ in range(80)]
        texts.append((i, " ".join(words), "en" if i % 2 else "few" if i == 2 else None))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    judged = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas().set_index("doc_id")
    good = np.array([q for _, q, _ in labels], dtype=bool)
    assert judged.loc[good, "kept"].mean() > 0.9 and not judged.loc[~good & (judged["lang"] == "en"), "kept"].any()
    unlabelled = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert unlabelled.filter("kept = base_failed").count() == 0


# -- 4 -----------------------------------------------------------------------------------------------------------
def test_classifier_on_held_out_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(60)]
        if grade == 0:
            words[rng.randrange(60)] = rng.choice(["vile", "nasty"])
        if grade == 1:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(grade != 1), int(grade == 0), grade))
    docs = spark.createDataFrame([*rows, (9000, None)], "doc_id long, text string")
    train = spark.createDataFrame([r[:3] for r in labels if r[0] % 3], "doc_id long, quality int, toxic int").unionByName(spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, train).collect()}
    held = [r for r in labels if r[0] % 3 == 0]
    assert np.mean([got[i]["kept"] == (g == 2) for i, _, _, g in held]) > 0.95
    mean = [np.mean([got[i]["expected_grade"] for i, *_, g in held if g == k]) for k in (1, 2)]
    assert mean[0] < mean[1] and 0 <= got[9000]["p_top"] <= 1
    assert all(r["kept"] for r in quality_classifier.classify(docs, train.limit(0)).collect())


# -- 5 -----------------------------------------------------------------------------------------------------------
def test_licenses_and_inheritance(spark):
    rows = [
        (1, "a/b/x.py", "code here\nReleased under the MIT License.\nmore"), (2, "a/b/c/y.py", "nothing of the sort"), (3, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "z/q.py", None), (6, None, "just words"), (7, "a/d/w.py", "plain"), (8, "top.py", ""),
    ]
    filler = [(100 + i, f"m/{i}", " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(60)]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows + filler, "doc_id long, path string, text string")).collect()}
    assert (out[1]["own_license"], out[1]["line"], out[1]["license"]) == ("MIT", 1, "MIT")
    assert (out[2]["license"], out[2]["from_dir"]) == ("GPL-3.0", "a/b")
    assert (out[7]["license"], out[7]["from_dir"]) == ("Apache-2.0", "a")
    assert out[5]["license"] is None and out[6]["license"] is None and out[8]["license"] is None
    assert out[3]["file_score"] > 0.99


def test_common_licenses_are_found(spark):
    """A notice that a third of all documents, or all of a few, carry is found on each."""
    word = lambda i: " ".join(f"w{j}" for j in range(i, i + 30))
    for n, every in ((90, 3), (4, 1)):
        rows = [(i, f"d{i}/x.py", ("Released under the MIT License.\n" if i % every == 0 else "") + word(i)) for i in range(n)]
        out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
        assert {r["doc_id"] for r in out if r["own_license"] == "MIT" and r["line"] == 0} == set(range(0, n, every))


def test_full_license_texts_and_wrapped_headers(spark):
    full = {n: ts[-1] for n, ts in license_scan.all_templates().items() if len(ts[-1]) > 300 and not n.startswith("CC-")}
    assert len(full) == 11
    header = "import os\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n" \
        "# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\nx = 1\ny = 2"  # fmt: skip
    mit = "// Copyright 2020 Some One\n//\n" + "\n".join("// " + x for x in full["MIT"].splitlines()) + "\n" + "\n".join(f"let v{i} = w{i}" for i in range(300))
    rows = [(i, f"f{i}/LICENSE", f"Copyright (c) 2020 Some One\n\n{full[n]}") for i, n in enumerate(sorted(full))] + [(100 + i, f"f{i}/a.py", "nothing") for i in range(len(full))]
    rows += [(200, "s/a.py", header.format(3)), (201, "s/b.py", header.format(2)), (202, "s/c.js", mit), (203, "s/d", "The MIT License (MIT)"), (204, "s/e", "Creative Commons\nAttribution 4.0\nInternational"), (205, "s/f", " ".join(f"the w{j} of" for j in range(99)))]
    rows += [(300 + i, f"m/{i}", " ".join(f"w{j}" for j in range(i, i + 30))) for i in range(60)]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, n in enumerate(sorted(full)):
        assert (out[i]["own_license"], out[100 + i]["license"], out[100 + i]["from_dir"]) == (n, n, f"f{i}") and out[i]["file_score"] > 0.95
    assert [(out[i]["own_license"], out[i]["line"]) for i in (200, 201, 202, 203, 204, 205)] == [("GPL-3.0", 1), ("GPL-2.0", 1), ("MIT", 2), ("MIT", 0), ("CC-BY-4.0", 0), (None, None)]


# -- 6 -----------------------------------------------------------------------------------------------------------
def test_html_text():
    text = html_extract.parse(
        '<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><ul class="menu"><li><a href=x>1</a></ul><article><h1>T &amp; U</h1>'
        '<div class="ad">buy</div><p>one\n two<p>th&eacute;n a < b<ul><li>x<li>y</ul><script>var t="</p>";</script><form>f</form><section id="comments">'
        '<article class="comment"><p>nice</p></article></section></article><div class="cookie-notice">c</div><footer>&copy;</footer>'
    )[0]
    assert text == "T & U\none two\nthén a < b\nx\ny"
    assert html_extract.parse("")[0] == "" and html_extract.parse("<p>cut o")[0] == "cut o" and html_extract.parse("a <b cl")[0] == "a"


def test_site_templates_go_and_articles_stay(spark):
    page = lambda i: f"<body><div><p>Welcome to our site</p></div><div><p>story {i} is long</p></div><div>All rights reserved</div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(50, "http://other.example/", page(50)), (51, None, None), (52, "http://h.example/copy", page(3))]
    rows += [(60 + i, f"http://c.example/{i}", "<article><p>The same story everywhere.</p></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit(-1))).collect()}
    assert got[3] == got[52] == "story 3 is long"
    assert got[50].startswith("Welcome") and got[51] == "" and got[64] == "The same story everywhere."


def test_blocks_inside_articles_go(spark):
    box = '<div class="x7"><p>Read more stories</p></div>'
    page = lambda i: f'<body><div role="main"><div><p>story {i} is long</p></div>{box}<p>The end</p><ul><li><a href="/{i}">source {i}</a></ul></div></body>'
    teaser = "<div><article><p>The story that all quote.</p></article></div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(20 + i, f"http://l.example/{i}", f"{teaser}<article><p>list {i}</p></article>") for i in range(8)]
    rows += [(40, "http://other.example/", page(40))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 is long\nThe end\nsource 3"
    assert got[23] == "The story that all quote.\nlist 3" and "Read more stories" in got[40]


def test_templates_of_a_part_of_a_large_host_go(spark):
    """A notice on 6 of 100 pages, with the recurring hashes broadcast and joined; copies of a page count once."""
    page = lambda i: f"<body>{'<div><p>Members only</p></div>' if i < 6 else ''}{'<div><p>Twice</p></div>' if i in (7, 8) else ''}<div><p>story {i} is long</p></div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(100)] + [(200 + i, f"http://h.example/copy{i}", page(8)) for i in range(9)] + [(None, None, None), (300, None, "<p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(html_extract.extract(pages).collect(), key=str)
    assert got == sorted(html_extract.extract(pages, in_memory=0).collect(), key=str) and len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[2] == "story 2 is long" and text[8] == text[204] == "Twice\nstory 8 is long" and text[300] == "a"


# -- 7 -----------------------------------------------------------------------------------------------------------
def test_snapshots_collapse(spark):
    turns = {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c"], 4: ["a", "b", "c"], 5: ["a", "x"], 6: [None], 7: [""], 8: ["b"]}
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", x) for c, ts in turns.items() for t, x in enumerate(ts)] + [(None, 0, "user", "z")]
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8]
    assert got[5] == (2, "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------
def test_substring_dedup_is_exact(spark, docs, rows):
    least = {}
    for d, t in rows:
        w = BLANK.findall(t or "")
        for i in range(len(w) - 12 if d is not None else 0):
            k = tuple(w[i : i + 13])
            least[k] = min(d, least.get(k, d))
    expected = []
    for d, t in rows:
        w = BLANK.findall(t or "")
        gone = {j for i in range(len(w) - 12) if d is not None and least[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((key(d, None)[:2], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(key(r["doc_id"], None)[:2], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(docs.withColumn("n_removed", F.lit(0))).collect()]
    assert sorted(got) == sorted(expected)
    left = [r for r in substring_dedup.dedup(docs, with_text=True).collect() if r["left_text"] is not None]
    assert left and all(hashlib.sha256(" ".join(BLANK.findall(r["left_text"])).encode()).hexdigest() == r["kept_sha256"] for r in left)


def test_levels_extend_what_is_repeated(spark):
    """Three levels run on the documents of sf0.01; each has candidates only where the one below is shared."""
    some = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert substring_dedup.widths(13) == [4, 8, 13]
    found = [r.agg(F.count(F.lit(1)), F.count_if("shared")).first() for r in substring_dedup.level_rows(some)]
    assert len(found) == 3 and all(0 < shared < n for n, shared in found) and found[1][0] < found[0][0]


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    twice = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (1, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    assert substring_dedup.dedup(none).count() == 0 and jaccard_join.components(none).count() == 0
    assert sorted(r["n_removed"] for r in substring_dedup.dedup(twice).collect()) == [0, 0, 14]
    assert [r["component_id"] for r in jaccard_join.components(twice).collect()] == [1, 1, 1]
    assert substring_dedup.longest_repeats(none).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(none, labels).count() == 0
    assert quality_rules.judge(none.selectExpr("*", "'x' AS lang"), labels).count() == 0
    assert license_scan.scan(none.selectExpr("*", "'a/b' AS path")).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_that_only_contain_a_word_say_nothing():
    cases = {
        '<article class="post no-sidebar"><p>a b</p></article>': "a b", '<div class="content has-sidebar"><p>a</p></div>': "a",
        '<article><div class="related-work"><p>x</p></div><p class="social-science">y</p><p class="notice-period">z</p><section id="comments"><p>no</p></section></article>': "x\ny\nz",
    }
    for page, text in cases.items():
        assert html_extract.parse(page)[0] == text


def test_longest_repeats(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(["x"] + words[20:75] + ["y"])), (3, " ".join(words[:14])), (4, "unlike the others " * 3)]
    got = {r["doc_id"]: r["words"] for r in substring_dedup.longest_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 52, 3: 13}


# -- 9, 10 ---------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizers():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return {n: (P.path(n), Tokenizer.from_file(P.path(n))) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


ODD = ["a  b", "tab\there", "end ", " start", "x\n\ny", "don't it's", "12 3.5 ½", "Σς İı ẞ", "a b   c", "<|endoftext|> in text", "é combining", "日本語 テキスト", "\r\n", "word,word.word", "ﬁne", "A" * 3000]


def test_encoding_is_the_library_s(tokenizers, rows):
    from loomspan.llm.encoding import encoder

    texts = [t or "" for _, t in rows] + ODD
    for path, tokenizer in tokenizers.values():
        ids, counts = encoder(path).encode(texts)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t[:40]


def test_memo_shrinks_without_harm(tokenizers, monkeypatch):
    from loomspan.llm import encoding

    monkeypatch.setattr(encoding, "ENTRIES", 40)
    monkeypatch.setattr(encoding, "KEPT", 10)
    path, tokenizer = tokenizers["byte_bpe_50k.json"]
    enc = encoding.Encoder(path)
    for a in range(6):
        text = " ".join(f"word{i}." for i in range(a * 20, a * 20 + 45))
        assert enc.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_columns_are_encoded_as_the_library_does(tokenizers, rows):
    import pyarrow as pa

    from loomspan.llm import encoding

    rng = random.Random(4)
    parts = ["word", "Wort", "é", "née.", "don't", "it's.", "a,b", "x.", "y", "...", "#", "*", "|", "|>", "<|endoftext|>", "end<|endoftext|>.", "…", "…!", " ", "\n", " ", " ", " ", "\n", "\t", "\xa0", "\u2003", "½", "7", "3.5", "日本", "语。"]
    texts = [t for _, t in rows] + ODD + ["", None, " ", "\n", "."] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    for path, tokenizer in tokenizers.values():
        enc = encoding.Encoder(path)
        for kind in (pa.string(), pa.large_string()):
            for some in (texts, texts[::-1]):  # a slice, so that the column begins within its buffer
                ids, counts = enc.encode(pa.array(["cut off", None, *some], kind).slice(2))
                at = np.concatenate([[0], np.cumsum(counts)])
                for i, t in enumerate(some):
                    assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
        assert [len(x) for x in enc.encode(pa.array([None, ""], pa.string()))] == [0, 2] and len(enc.encode(pa.array([], pa.string()))[1]) == 0


def test_a_word_is_learnt_once_whatever_sign_follows(tokenizers):
    from loomspan.llm import encoding

    path, tokenizer = tokenizers["byte_bpe_50k.json"]
    enc = encoding.Encoder(path)
    text = " ".join(f"wort{c}{sign}" for c in "abcdefghij" for sign in (".", ",", ";", ":", "!", "?", "...", "***"))
    ids, _ = enc.encode([text, text])
    assert ids.tolist() == 2 * tokenizer.encode(text, add_special_tokens=False).ids
    assert len(enc.memo) <= 11 + 8  # words with a blank before, the first word, signs


def test_compressing_leaves_the_same_grammar_whatever_the_width():
    """Ids below and above 16 bits, documents of one id, overlapping runs: the symbols expand to the input and keep to their documents."""
    rng = np.random.default_rng(5)
    for shift in (0, 1 << 16):
        for n in (1, 2, 9, 3000):
            lengths = rng.integers(1, 40, n)
            ids = (rng.integers(1, 4, lengths.sum()) + shift).astype(np.uint32)
            ids[np.cumsum(lengths) - 1] = 0
            symbols, per_doc, base, rules = token_binary.compress(ids, lengths, least=2)
            assert (token_binary.expand(symbols, base, rules) == ids).all() and per_doc.sum() == len(symbols)
            starts = np.cumsum(per_doc) - per_doc
            for i in range(0, n, 7):
                own = symbols[starts[i] : starts[i] + per_doc[i]]
                assert len(token_binary.expand(own, base, rules)) == lengths[i]


def test_shards_round_trip(spark, docs, rows, tokenizers):
    path, tokenizer = tokenizers["byte_bpe_50k.json"]
    odd = [(10_000 + i, t) for i, t in enumerate(ODD)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    shards = token_binary.write_shards(both, path, shard_ids=3000)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_binary.read_documents(shards).collect())
    at, expected, by_id = 0, [], {}
    for d, t in sorted(rows + odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        by_id.setdefault(d, []).append(ids)
        expected.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    row = shards.orderBy("part", "seq").first().asDict()
    names = np.frombuffer(row["doc_ids"], "<i8")
    for i in (0, len(names) // 2, len(names) - 1):
        d = None if row["doc_nulls"][i] else int(names[i])
        assert token_binary.read_ids(row, i).tolist() in by_id[d]


def test_passages_that_occur_a_few_times_are_compressed():
    rng = np.random.default_rng(2)
    passage, parts = np.arange(1, 301, dtype=np.uint32), []
    for _ in range(10):
        parts += [rng.integers(1000, 60000, 50).astype(np.uint32), passage, np.zeros(1, np.uint32)]
    ids, lengths = np.concatenate(parts), np.full(10, 351)
    symbols, per_doc, base, rules = token_binary.compress(ids, lengths)
    assert (token_binary.expand(symbols, base, rules) == ids).all() and per_doc.sum() == len(symbols)
    assert len(symbols) <= 10 * (50 + 2 + 1) and base + len(rules) <= 1 << 16


def test_grammar_expands_to_its_input():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 30, 50_000).astype(np.uint32)
    lengths = np.array([1, 9, 990, 49_000])
    ids[np.cumsum(lengths) - 1] = 0
    symbols, per_doc, base, rules = token_binary.compress(ids, lengths, least=8)
    assert len(rules) and len(symbols) < 0.8 * len(ids) and per_doc.sum() == len(symbols)
    assert (token_binary.expand(symbols, base, rules) == ids).all()


def test_packing_is_whole_and_gapless(docs, rows, tokenizers):
    path, tokenizer = tokenizers["word_bpe_49k.json"]
    out = packing.pack(docs.withColumn("length", F.lit("clash")).withColumn("rank", F.lit(0)), path, capacity=64).collect()
    pieces = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces += [(key(d, None)[:2], k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((key(r["doc_id"], None)[:2], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(pieces)
    lengths = sorted(min(64, n - k) for _, t in rows for n in [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] for k in range(0, n, 64))
    assert sorted(r["length"] for r in out) == lengths
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= -(-sum(lengths) // 64) * 1.1 + 1


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 2048): rng.choice([1, 3, 500]) for _ in range(rng.choice([1, 6, 300]))}
    runs, n = packing.plan(histogram)
    ranks = {}
    for length, first, count, _, offset in runs:
        assert offset + length <= 2048
        ranks.setdefault(length, []).append((first, count))
    for length, parts in ranks.items():
        end = 0
        for first, count in sorted(parts):
            assert first == end
            end += count
        assert end == histogram[length]
    assert n >= -(-sum(k * v for k, v in histogram.items()) // 2048)


def test_tables_of_classes_are_not_broadcast(spark, monkeypatch):
    """Joins with tables that grow with the corpus sort at every size; only the large regions, which are few, are broadcast."""
    from loomspan.llm import jaccard_join

    write, broadcast = jaccard_join.materialise, set()

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def written(df, label, *partition_by):
        if "BroadcastHashJoin" in plan(df):
            broadcast.add(label)
        return write(df, label, *partition_by)

    monkeypatch.setattr(jaccard_join, "materialise", written)
    assert "BroadcastHashJoin" not in plan(jaccard_join.components(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    assert broadcast <= {"members"}
