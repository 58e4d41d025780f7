"""Quality rules with risk-controlled thresholds.

DataFrame functions only.  Every text is measured inside its own row (no shuffle).
Labelled documents then decide how strict the rules may be in each stratum.  A test is
a rule with one cutoff of a fixed grid.  The labelled bad documents and the unlabelled
ones put a stratum's tests in an order (first those that catch many bad ones for each
unlabelled one; those that catch no bad one are left out); the labelled good ones,
which had no say in that order, prove them: step by step one more
test joins those that reject, and the exact binomial tail must show that all of them
together reject at most a share alpha of the good documents.  A stratum's tests end at
the first step that is not proven (fixed sequence), so only the number of strata that
are tested divides delta (Bonferroni).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, shared_table

#: rule: (value as SQL over the measures, cutoffs; a document above the cutoff is rejected).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.3, 0.4)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.2, 0.3, 0.5)),
    "long_words": ("word_chars / greatest(n_words, 1)", (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 16.0)),
    "short": ("-n_words", (-400.0, -200.0, -120.0, -80.0, -60.0)),
}
def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang) and the counts of each whole text; null: no words."""
    line_spaces = SPACES.replace("\n", "")
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("stratum"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    one = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  binds a value, so that it is made once
    words = F.array_remove(F.split(F.translate("text", line_spaces[1:] + "\n", " " * 5), " +"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, line_spaces, "")) > 0)

    def repeated(w):
        windows = F.when(F.size(w) < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))
        )
        twice = one(windows, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return one(starts, lambda q: F.aggregate(F.transform(q, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(q, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))

    counted = base.select(
        "doc_id",
        "stratum",
        F.xxhash64("text").alias("text_hash"),
        one(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated(w).alias("n_repeat_words"))).alias("w"),
        one(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    return counted.select("doc_id", "stratum", "text_hash", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_factorial(x: Column) -> Column:
    """ln x! for whole x: exact to 20, then Stirling's series (error below 1e-14)."""
    y = x + F.lit(1.0)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise((y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series)


def log_tail(k: Column, n: Column, rate: float) -> Column:
    """ln P(Binomial(n, rate) <= k): the terms from k downward, in logs; 0 from the mean on.

    Below the mean each term is less than the one above it, and 40 standard deviations
    below k they are less than a double can add, so the sum ends there.
    """
    odds = F.log(F.lit((1 - rate) / rate))
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * rate * (1 - rate))) + 100)
    ratio = F.aggregate(
        F.sequence(F.lit(0).cast("long"), terms - 1),
        F.struct(F.lit(0.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, i: F.struct((s["term"] + F.log((k - i) / (n - k + i + 1)) + odds).alias("term"), (s["total"] + F.exp(s["term"] + F.log((k - i) / (n - k + i + 1)) + odds)).alias("total")),
        lambda s: s["total"],
    )
    return F.when(k >= n * rate, F.lit(0.0)).when(k == 0, n * F.log(F.lit(1 - rate))).otherwise(top + F.log(ratio))


#: All tests: (rule, cutoff, how many cutoffs of the rule are looser).
TESTS = [(rule, float(cut), loose) for rule, (_, cuts) in RULES.items() for loose, cut in enumerate(sorted(cuts, reverse=True))]


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum and one cutoff for each rule (null: none is proven).

    With probability 1 - delta, in no stratum do the rules together reject more than a
    share alpha of the good documents that pass the base rule.  Copies of a text count
    once.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.filter(~F.col("base_failed")).join(known.filter("quality is not null"), "doc_id").withColumn("good", F.col("quality") == 1)
    values = [F.expr(value).cast("double").alias(f"v_{rule}") for rule, (value, _) in RULES.items()]
    held = shared_table(held.select("stratum", "text_hash", "good", *values).dropDuplicates(["stratum", "text_hash", "good"]), "quality-held")
    above = [F.col(f"v_{rule}") > cut for rule, cut, _ in TESTS]
    counted = lambda name: [F.count_if(x).alias(f"{name}{i}") for i, x in enumerate(above)]
    caught = held.filter(~F.col("good")).groupBy("stratum").agg(*counted("b"))
    plain = measured.filter(~F.col("base_failed")).join(known, "doc_id", "left_anti").select("stratum", *values).groupBy("stratum").agg(*counted("u"))
    each = caught.join(plain, "stratum", "left").select("stratum", F.explode(F.array(*(F.struct(F.lit(i).alias("test"), F.lit(loose).alias("loose"), F.col(f"b{i}").alias("bad"), F.col(f"u{i}").alias("plain")) for i, (_, _, loose) in enumerate(TESTS)))).alias("t")).select("stratum", "t.*")
    lift = F.coalesce(F.col("bad") / (F.col("plain") + 1), F.lit(0.0))  # without unlabelled documents loose cutoffs come first
    ranks = each.filter("bad > 0").withColumn("step", F.row_number().over(Window.partitionBy("stratum").orderBy(lift.desc(), "loose", F.desc("bad"), "test")))  # a row for each test of a stratum
    wide = ranks.groupBy("stratum").agg(*(F.min(F.when(F.col("test") == i, F.col("step"))).alias(f"s{i}") for i in range(len(TESTS))))
    steps = [F.when(x, F.col(f"s{i}")) for i, x in enumerate(above)]
    # the step at which a good document begins to be rejected (null: never)
    first = held.filter("good").join(wide, "stratum").select("stratum", F.least(*steps).alias("step")).groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    sizes = first.groupBy("stratum").agg(F.sum("n").alias("n"))
    lost = ranks.select("stratum", "step").join(first.withColumnRenamed("n", "k"), ["stratum", "step"], "left").withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy("stratum").orderBy("step")))
    tested = lost.join(sizes, "stratum")
    strata = sizes.agg(F.count(F.lit(1)).alias("strata"))  # one row
    proven = tested.crossJoin(F.broadcast(strata)).withColumn("proven", log_tail(F.col("k"), F.col("n"), alpha) <= F.log(F.lit(delta) / F.col("strata")))
    last = proven.groupBy("stratum").agg(F.coalesce(F.min(F.when(~F.col("proven"), F.col("step"))), F.lit(len(TESTS) + 1)).alias("end"))
    used = ranks.join(last, "stratum").filter("step < end")
    return used.groupBy("stratum").agg(*(F.min(F.when(F.col("test").isin([i for i, t in enumerate(TESTS) if t[0] == rule]), F.element_at(F.array(*(F.lit(t[1]) for t in TESTS)), F.col("test") + 1))).alias(f"cut_{rule}") for rule in RULES))


def quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Counts, base verdict and kept for every row of ``docs``.

    Null texts have no words and fail the base rule.  A stratum (lang; null counts as
    '') without enough labels has no proven cutoff, so only the base rule speaks there; so
    does an empty ``labels``.  Of contradicting labels the worse counts.  Repeated rows
    are judged each.  Equal windows are told by 64-bit hashes of their words.
    """
    measured = shared_table(measures(docs), "quality-measures")
    cuts = shared_table(cutoffs(measured, labels, alpha, delta), "quality-cutoffs")
    judged = measured.join(cuts, "stratum", "left")  # a row for each stratum: planned by its size
    rejected = [F.coalesce(F.expr(value) > F.col(f"cut_{rule}"), F.lit(False)) for rule, (value, _) in RULES.items()]
    bad = F.col("base_failed")
    for x in rejected:
        bad = bad | x
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~bad).alias("kept"))
