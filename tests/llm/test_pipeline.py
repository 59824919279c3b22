"""The pipeline's stages on a small corpus, each against a brute-force version of what follows the classifier."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_operators import ALNUM, BLANK, brute_components, lower  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "jaccard_join", "substring_dedup", "decontaminate", "best_fit_pack"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
        if len(tables) < 6:
            assert tables[-1].columns == columns
    kept, one, cut, clean, packed = [t.collect() for t in tables[1:]]
    assert 0 < len(kept) < docs.count()

    comps = brute_components([(r["doc_id"], r["text"]) for r in kept])
    assert sorted(r["doc_id"] for r in one) == sorted(d for d, (_, c) in comps.items() if c == d)

    least = {}
    for r in sorted(one, key=lambda r: r["doc_id"]):
        w = BLANK.findall(r["text"] or "")
        for i in range(len(w) - 12):
            least.setdefault(tuple(w[i : i + 13]), r["doc_id"])
    left = {}
    for r in one:
        w = BLANK.findall(r["text"] or "")
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < r["doc_id"] for j in range(i, i + 13)}
        if not w or len(gone) < len(w):
            left[r["doc_id"]] = [x for j, x in enumerate(w) if j not in gone]
    assert {r["doc_id"]: BLANK.findall(r["text"] or "") for r in cut} == left
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut)

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ALNUM.findall(lower(r["text"]))
        size = min(10, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1 if w else 0)}
    sizes = {len(w) for w in windows}

    def dirty(text):
        w = ALNUM.findall(lower(text))
        return any(tuple(w[i : i + s]) in windows for s in sizes for i in range(len(w) - s + 1))

    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in cut if not dirty(r["text"]))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).filter(F.lit(True)).count() == 0


def test_near_copies_are_left_out_without_a_broadcast(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert "BroadcastHashJoin" not in left._jdf.queryExecution().executedPlan().toString()


OWN = ["kept", "n_words", "contaminated", "hashes", "left_text", "expected_grade", "_hit", "cls", "component_id", "_own0", "k", "grade", "x y"]


def test_stages_give_own_columns_back(spark):
    """Columns named like those that the stages add or use inside come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in OWN])
    now, plain = more, docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now, plain = stage(spark, now, SF).cache(), stage(spark, plain, SF).cache()
        assert now.columns == more.columns, name
        rows = now.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in OWN), name
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows) == sorted((r["doc_id"], r["text"], r["n_chars"]) for r in plain.collect()), name


def test_stages_take_nulls_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (None, "a text without a number"), (3, "word " * 60), (3, "word " * 60), (4, " ".join(f"w{i}" for i in range(400)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() > 0, name


def test_no_import_errors_are_swallowed():
    source = open(corpus_pipeline.__file__).read()
    assert not re.search(r"\btry\b", source)
