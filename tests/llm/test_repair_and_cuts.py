"""Conversation repair, fill-in-middle and MinHash near-duplicates against brute force."""

import hashlib
import heapq
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import chat_repair, decontaminate, fill_middle, html_extract, jaccard_join, minhash_dedup, quality_classifier, quality_rules, queries, substring_dedup

BLANK = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.01"


# -- 11 ----------------------------------------------------------------------------------------------------------
def damaged(rows):
    """{conv: rows after damage}, in order."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])):
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(d, 1))
    # what damage has changed is ordered anew within a turn
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def cheapest(rows):
    """Least (cost, audit, repaired) by search over all edits."""
    kinds, seen = [], set()
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        words = BLANK.findall(text)
        kind = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            counts[kind] += 1
    ok = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    into = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, q, made = heapq.heappop(heap)
        if i == len(rows) and q in ("", "a"):
            break
        if (i, q) in done:
            continue
        done.add((i, q))
        n = into[q]
        heapq.heappush(heap, (cost + 5, audit + "I", i, n, (*made, f"{name[n]}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, made))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 5 if kinds[i] == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, n, (*made, f"{name[n]}:{text}")))
                if (q, role[:1]) in ok:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, ok[q, role[:1]], (*made, f"{role}:{text}")))
    turns = sorted({t for t, _, _ in rows if t is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    first = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def log(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        say = [f"said {k}{rng.choice(['.', '!', '?', '', ' . '])}" for k in range(3)] + ["", " \n", None, "é x."]
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, rng.choice(say)))
    return rows


def as_rows(frame):
    return {r["conv_id"]: tuple(r[1:]) for r in frame.collect()}


@pytest.mark.parametrize(("seed", "rows", "partitions"), [(1, 1 << 14, 2), (2, 2, 3), (3, 1, 7), (4, 3, 1)])
def test_repair_is_the_cheapest_and_least(spark, seed, rows, partitions):
    turns = log(seed)
    # a conversation that holds a third of all rows
    turns += [(0, t, ("user", "assistant", "user")[t % 3], f"long {t % 50}{'.' * (t % 4)}") for t in range(len(turns) // 2)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("live_", F.lit(1)).withColumn("h1", F.lit("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = as_rows(chat_repair.report(chat_repair.repair(chat_repair.damage(frame), live="live", rows=rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {c: cheapest(v) for c, v in damaged(turns).items()}
    assert found.keys() == want.keys()
    for c in want:
        assert found[c] == want[c], c


def test_repair_of_nothing_and_of_dropped_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_repair.report(chat_repair.repair(chat_repair.damage(empty), live="live")).collect() == []
    gone = spark.createDataFrame([("a", 1, "user", "x.", False), ("b", None, "system", "rules.", True)], "conv_id string, turn int, role string, text string, live boolean")
    found = as_rows(chat_repair.report(chat_repair.repair(gone, live="live")))
    assert found["a"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found["b"][5:7] == (2, "D")


def test_repaired_turns_are_the_output(spark):
    rows = [(1, 0, "user", "hello."), (1, 1, "user", "again."), (1, 2, "assistant", "yes.")]
    (got,) = chat_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert (got["audit"], got["cost"]) == ("DKK", 2)
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "again."), ("assistant", "yes.")]


def test_repair_query_on_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(queries.op11_chat_repair(spark, SF)) == {c: cheapest(v) for c, v in damaged(rows).items()}


# -- 12 ----------------------------------------------------------------------------------------------------------
def cut(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1:])))


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_cuts_are_those_of_the_pattern(spark, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(["a", "Z", "é", "😀", " ", ".", "\n", "1", "word", "<P", "M>", "<"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "x<S>y", "<P>", "é" * 5000, "w" * 5000, "ab " * 70000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "no id"), (None, None)]
    frame = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, n int, form string").repartition(3)
    made = fill_middle.fill_in_middle(frame, chunk=chunk)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256)).collect()
    assert by_key(map(tuple, got)) == by_key(cut(*r) for r in rows)
    assert fill_middle.fill_in_middle(frame.limit(0)).collect() == []


@pytest.mark.parametrize(("block", "scans"), [(1, 1), (7, 3), (1 << 20, 1 << 11)])
def test_blocks_of_any_size_count_alike(monkeypatch, block, scans):
    monkeypatch.setattr(fill_middle, "_BLOCK", block)
    monkeypatch.setattr(fill_middle, "_SCANS", scans)
    texts = ["ab c", None, "", "é1éab", "zzzzzzzz", "\n", "a-b-c"]
    for chunk in (1, 2, 5):
        for h in range(9):
            n, a, b = fill_middle.cut_places(pa.array(["pad", *texts]).slice(1), np.full(7, h), np.full(7, 2 * h + 1), chunk)
            for i, t in enumerate(texts):
                tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t or "")
                x, y = sorted((h % (len(tokens) + 1), (2 * h + 1) % (len(tokens) + 1)))
                assert (n[i], a[i], b[i]) == (len(tokens), len("".join(tokens[:x])), len("".join(tokens[:y])))


def test_middle_query_on_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert by_key(map(tuple, queries.op12_fill_middle(spark, SF).collect())) == by_key(cut(*r) for r in rows)


# -- 13 ----------------------------------------------------------------------------------------------------------
def near(rows, k=4, percent=80):
    """[(doc_id, n_shingles, component_id, kept)] from all pairs."""
    sets = []
    for _, t in rows:
        w = BLANK.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for g in s:
                by.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), None if d is None else least[root(i)], d is not None and least[root(i)] == d) for i, (d, _) in enumerate(rows)]


def copies(seed, n=120, words=2000):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i * 7 % 1009, " ".join(w)))
    long = [rng.choice(vocabulary) for _ in range(9000)]
    return [*rows, rows[3], (2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "one"), (None, "null id"), (None, None), (2005, " ".join(long)), (2006, " ".join([*long[:8500], "x"]))]


@pytest.mark.parametrize(("bucket", "task"), [(1 << 12, None), (4, None), (4, 6)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, bucket, task):
    if task:
        monkeypatch.setattr(minhash_dedup.J, "_TASK", task)
    rows = copies(bucket)
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, cls int, keys string").repartition(4)
    got = [tuple(r) for r in minhash_dedup.near_duplicates(frame, bucket=bucket).collect()]
    assert by_key(got) == by_key(near(rows))


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert minhash_dedup.near_duplicates(empty).collect() == []
    bare = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(map(tuple, minhash_dedup.near_duplicates(bare).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_near_duplicate_query_on_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_key(map(tuple, queries.op13_minhash_dedup(spark, SF).collect())) == by_key(near(rows))


def test_pruning_keeps_its_promise():
    """Of pairs at the threshold the share that is pruned is small; of unlike pairs nearly all go in the first batches."""
    bounds = minhash_dedup.least_matches(80, 1e-4)
    rng = np.random.default_rng(5)
    one = rng.integers(0, 256, 160, dtype=np.uint8)

    def others(s, n=4000):
        out = rng.integers(0, 256, (n, 160), dtype=np.uint8)
        same = rng.random((n, 160)) < s
        out[same] = np.broadcast_to(one, out.shape)[same]
        return out

    assert len(minhash_dedup.survivors(one, others(0.8), bounds)) >= 3990
    assert len(minhash_dedup.survivors(one, others(0.3), bounds)) == 0
    assert len(minhash_dedup.survivors(one, others(0.3), bounds[:2])) < 400
    assert bounds[-1][0] == minhash_dedup.BANDS * minhash_dedup.ROWS


# -- 6 ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><div class="menu"><p>Soup</p></div><section id="related"><p>Related work</p></section><div class="notice">n</div><figure class="banner"><figcaption>f</figcaption></figure><div class="toolbar">t</div></article>', "Soup\nRelated work\nn\nf\nt"),
        ('<article><p>a</p><div class="ad-slot">x</div><div class="advert-box">x</div><section class="commentsSection">x</section><div id="user-comments">x</div><div class="cookie-bar">x</div><div class="promo">x</div><p>b</p></article>', "a\nb"),
        ('<article><div data-class="ad">keep me</div><pre><span class="comment"># code</span></pre></article>', "keep me\n# code"),
        ("out<div role=main>in</div>out", "in"),
        ('<article><p hidden>h</p><p style="color:red; display: none">h</p><p aria-hidden=true>h</p><p>v</p></article>', "v"),
        ('<div class="sidebar">s</div><div class="no-ads">body</div><div id=footer>f</div>', "body"),
        ('<main><p>a<div role="MAIN "><p>b</main><p>c', "a\nb"),
        ("<article class=ad><p>own</article>", "own"),
    ],
)
def test_what_is_no_article(page, text):
    assert html_extract.parse(page)[0] == text


@pytest.mark.parametrize("page", ["<span>a" * 30000 + "</p>" * 30000, "<p><table>" + "<span>a" * 30000 + "</p>" * 30000, "<div>a" * 30000 + "</div>" * 30000, "<li><span>" * 30000, "<b <i '" * 30000])
def test_pages_are_parsed_in_linear_time(page):
    began = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - began < 3  # a scan of all open elements for each tag takes minutes


def test_link_boxes_that_recur_in_shape_go(spark):
    """Outside articles a box of links with other texts on each page is found by its shape; prose of one shape stays."""
    box = lambda i: f'<div class="b{7}"><h4>Read on</h4>' + "".join(f'<p><a href="/{i}/{k}">headline {i} {k} of the day</a></p>' for k in range(2 + i % 3)) + "</div>"
    page = lambda i: f'<body><div class="c"><p>story {i} is long, with <a href=x>one link</a> in much text</p></div>{box(i)}'
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(9)] + [(50 + i, f"http://few.example/{i}", page(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story {i} is long, with one link in much text" for i in range(9))
    assert all("headline" in got[50 + i] for i in range(3))  # too few pages to tell


def test_templates_are_what_recurs_by_brute_force(spark):
    rng = random.Random(9)
    parts = [f"<div><p>part {k}</p></div>" for k in range(12)]
    rows = [(i, f"http://h{i % 3}.example/{i}", "<body>" + "".join(rng.choice(parts) for _ in range(3)) + f"<div><p>own {i % 20}</p></div>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    lines = {i: re.findall("<p>(.*?)</p>", h) for i, _, h in rows}
    on = {}
    for i, _, _ in rows:
        for line in set(lines[i]):
            on.setdefault((i % 3, line), set()).add(tuple(lines[i]))
    want = {i: "\n".join(x for x in lines[i] if len(on[i % 3, x]) < html_extract.MIN_PAGES) for i, _, _ in rows}
    assert got == want and any(len(x) >= html_extract.MIN_PAGES for x in on.values())


# -- columns and repeated rows -----------------------------------------------------------------------------------
INSIDE = ["w", "l", "cut_symbols", "cut_dup_lines", "_stratum", "_strata", "n", "good", "hashes", "h", "later", "_hit", "_items", "_longest", "cls", "k", "x", "grade", "_own0", "_own1", "t", "q"]


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op8", "op13"])
def test_columns_that_operators_use_inside_do_no_harm(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("int") if name == "op2" else F.col("doc_id"))
    labels, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("labels", "benchmark"))
    more = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in INSIDE])
    run = {
        "op1": lambda d: decontaminate.contamination(d, benchmark), "op2": jaccard_join.components, "op3": lambda d: quality_rules.judge(d, labels),
        "op4": lambda d: quality_classifier.classify(d, labels), "op8": substring_dedup.dedup, "op13": minhash_dedup.near_duplicates,
    }[name]
    plain, got = run(docs), run(more)
    same = [c for c in plain.columns if c not in INSIDE]
    assert sorted(map(str, got.select(*same).collect())) == sorted(map(str, plain.collect()))
    own = [c for c in INSIDE if c in got.columns]
    assert own == ([] if name in ("op2", "op13") else INSIDE)  # those two return columns of their own only
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in got.select("doc_id", *own).collect() for c in own)


def test_repeated_rows_do_not_break_the_bound_of_the_fit(spark, monkeypatch):
    real = quality_classifier.H.released
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(6)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")

    def counted(task):
        if task is quality_classifier._train:
            def of(batches):
                batches = list(batches)
                yield pa.RecordBatch.from_arrays([pa.array([[sum(b.num_rows for b in batches)]], pa.list_(pa.int32())), pa.array([[1.0]], pa.list_(pa.float64())), pa.array([[0.0, 1.0]], pa.list_(pa.float64()))], names=["bucket", "weight", "thresholds"])

            return real(of)
        return real(task)

    monkeypatch.setattr(quality_classifier.H, "released", counted)
    weights, _ = quality_classifier.train(docs, labels, max_labelled=2)
    seen = np.flatnonzero(weights).tolist()
    assert seen == [2]


def test_rules_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "word " * 60, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, None, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = {r["doc_id"]: (r["n_words"], r["base_failed"], r["kept"]) for r in quality_rules.judge(docs, labels).collect()}
        assert got == {1: (0, True, False), 2: (0, True, False), 3: (60, True, False)}
    assert quality_rules.judge(docs.limit(0), none).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------------------
def test_regions_of_real_documents_are_cut_into_cells(spark, monkeypatch):
    """At sf0.1 most regions are pairs of classes, which one pivot joins; the larger ones are cut, and no link is lost."""
    held, real = {}, jaccard_join.materialise

    def noted(df, label, *by):
        held[label] = real(df, label, *by)
        return held[label]

    monkeypatch.setattr(jaccard_join, "materialise", noted)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    jaccard_join.links(docs, jaccard_join.by_class(jaccard_join.classes(docs)))
    rows = held["members"].select("root", "cls", "text").orderBy("root").toArrow()
    depths, compared, pairs = {}, 0, 0
    for _, table, at, hashes in jaccard_join._groups(iter(rows.to_batches()), ["root"], 5):
        n, log = len(table), []
        sets = jaccard_join._Sets(at, hashes, n)
        edges = jaccard_join._join(sets, 75, np.arange(n), np.arange(n), True, log)
        every = [(x, y) for x in range(n) for y in range(x) if 100 * (c := len(np.intersect1d(sets.of(x), sets.of(y)))) >= 75 * (sets.size[x] + sets.size[y] - c)]
        comp = lambda e, n=n: jaccard_join_components(e, n)
        assert comp(edges) == comp(every)
        for depth, _, _ in log:
            depths[depth] = depths.get(depth, 0) + 1
        pairs += n * (n - 1) // 2
        compared += n > 4
    assert pairs > 0 and compared > 0 and max(depths) >= 1 and depths[1] > 0


def jaccard_join_components(edges, n):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
