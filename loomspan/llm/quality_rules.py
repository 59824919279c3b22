"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base measures come from the whole text of each document.  The adjustable rules
reject a document when a measure goes beyond a cutoff; each cutoff is selected
by learn-then-test: on labelled good documents (the holdout), per stratum and
for every candidate cutoff of a fixed grid, the null hypothesis "this cutoff
rejects more than ``risk / rules`` of good documents" is tested with the exact
binomial tail P(X <= rejected | n, risk / rules), at level ``level`` divided by
the number of all tests (Bonferroni over strata, rules and cutoffs).  Of the
cutoffs that pass, the one that rejects most is used; where none passes, the
rule rejects nothing in that stratum.  So with probability 1 - level no stratum
loses more than ``risk`` of its good documents to the rules.

The binomial tail is the last term, with Stirling's series for the factorials,
times a falling series that is summed until its rest is bounded; the bound of
the rest is added, so the test never errs to the lenient side.

Defined results: null text has no words and fails the base rules; a null
stratum is a stratum of its own; a document is good if every label row of it
says so; labels without document count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import aside, materialise

MIN_WORDS = 50
RISK = 0.10
LEVEL = 0.05
#: rule -> (numerator, denominator, candidate cutoffs); a document is rejected where the ratio is above the cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "dup_lines": ("n_dup_lines", "n_lines", [0.05, 0.1, 0.15, 0.2, 0.3, 0.5]),
    "repeats": ("n_repeat_words", "n_words", [0.05, 0.1, 0.2, 0.3, 0.4]),
    "capitals": ("n_capitals", "word_chars", [0.1, 0.15, 0.2, 0.3, 0.5]),
    "long_words": ("word_chars", "n_words", [6.0, 7.0, 8.0, 10.0, 12.0, 15.0]),
}


def _let(value: Column, body) -> Column:
    """Evaluate value once and use it in body: optimiser rules don't copy it into lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that are found at least twice."""

    def of(hashes: Column) -> Column:
        def covered(places: Column) -> Column:
            # (end so far, words so far) over rising places
            step = F.aggregate(
                places,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
            )
            return step["n"].cast("long")

        def by_sorting(pairs: Column) -> Column:
            same = lambda i, j: F.get(pairs, i)["h"].eqNullSafe(F.get(pairs, j)["h"])
            kept = F.filter(pairs, lambda p, k: same(k, k - 1) | same(k, k + 1))
            return covered(F.sort_array(F.transform(kept, lambda p: p["i"])))

        def found_twice(repeated: Column) -> Column:
            # a few repeated windows are looked up; many are found by sorting (window, place) pairs
            every = F.sequence(F.lit(0), F.size(hashes) - 1)
            looked_up = covered(F.filter(every, lambda i: F.array_contains(repeated, F.get(hashes, i))))
            pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            return F.when(F.size(repeated) <= 24, looked_up).otherwise(_let(F.sort_array(pairs), by_sorting))

        repeated = _let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda h, k: h.eqNullSafe(F.get(s, k - 1)))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(repeated, found_twice))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(windows, of))


_MEASURES = ("word_chars", "n_symbols", "n_capitals", "n_words", "n_repeat_words", "n_lines", "n_dup_lines")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of the documents but the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def without(pattern: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")

    one = F.struct(
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        without("[#*$%&|<>]+").alias("n_symbols"),
        without("[A-Z]+").alias("n_capitals"),
    )
    # a generator is evaluated once for each row; the optimiser copies projections into filters and each other
    renamed, back = aside(docs, text)
    own = [c for c in renamed.columns if c != text]
    measured = renamed.select(*own, F.inline(F.array(one)))
    return back(measured.select(*own, "n_symbols", "n_capitals", "w.*", "l.*"), _MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(over: str, under: str) -> Column:
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)).cast("double")


def _ln_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 8 and the product between."""
    x = n.cast("double") + 8
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    y = n.cast("double")
    product = F.lit(0.0)
    for k in range(1, 8):
        product = product + F.ln(y + k)
    return series - product


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p): an upper bound that is exact to about 1e-9 where k < n p; 1 elsewhere."""
    kd, nd = k.cast("double"), n.cast("double")
    last = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + kd * F.ln(F.lit(p)) + (nd - kd) * F.ln(F.lit(1 - p)))
    ratio = lambda i: (kd - i + 1) / (nd - kd + i) * ((1 - p) / p)
    steps = F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(4000)), F.lit(1)).cast("int"))
    folded = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum")),
    )
    rest = F.when(k > 4000, folded["term"] * ratio(F.lit(1.0)) / F.greatest(1 - ratio(F.lit(1.0)), F.lit(1e-9))).otherwise(0.0)
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), last * (folded["sum"] + rest)))


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL, key: str = "doc_id") -> DataFrame:
    """stratum and, for each rule, the selected cutoff (null: the rule rejects nothing there)."""
    good = labels.groupBy(key).agg((F.min(F.coalesce(F.col("quality"), F.lit(0))) >= 1).alias("good")).filter("good")
    held = measured.filter(~base_failed()).join(good, key, "left_semi")
    counts = [F.count(F.lit(1)).alias("n")]
    grid = []
    for rule, (over, under, cutoffs) in RULES.items():
        for i, c in enumerate(cutoffs):
            counts.append(F.count_if(_ratio(over, under) > c).alias(f"{rule}_{i}"))
            grid.append(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k")))
    by = held.groupBy(F.col(stratum).alias("_stratum")).agg(*counts)
    strata = by.withColumn("_strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    tests = strata.select("_stratum", "n", (F.col("_strata") * len(grid)).alias("n_tests"), F.inline(F.array(*grid)))
    passing = tests.filter(binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= level / F.col("n_tests"))
    return passing.groupBy("_stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES])


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The documents with their measures, base_failed and kept."""
    added = (*_MEASURES, "base_failed", "kept")
    renamed, back = aside(docs.drop(*[c for c in added if c not in (text, stratum, "doc_id")]), "doc_id", text, stratum)
    measured = materialise(measures(renamed, text), "measures")  # texts are read and measured once
    cuts = thresholds(measured, labels, stratum, risk, level)
    # one row for each stratum: grouped values of one column, a handful; joined as a plain equi-join that Spark sizes itself
    joined = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule, (over, under, _) in RULES.items():
        rejected = rejected | F.coalesce(_ratio(over, under) > F.col(f"cut_{rule}"), F.lit(False))
    judged = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"cut_{r}" for r in RULES])
    return back(judged, added)
