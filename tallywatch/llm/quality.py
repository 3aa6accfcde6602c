"""Quality rules with risk-controlled cutoffs, in Spark expressions.

Each rule rejects texts whose measure exceeds a cutoff. Cutoffs come from a fixed grid and
are chosen per stratum (language) on the labelled holdout: the good documents (label 1) of
a stratum show k false rejections in n, and a cutoff is safe if a rate of at least
``risk / rules`` would show as few only with probability ``error / tests`` (exact binomial
tail, Bonferroni over all strata, rules and cutoffs). The lowest cutoff that is safe, and
whose higher ones all are, is used. So with probability ``1 - error`` no stratum loses more
than ``risk`` of its good documents to the rules. A stratum with too few labels rejects by
the base rule only.

Defined results: a null text has no words, so it fails the base; a null language is a
stratum; documents without label judge nothing; a document labelled twice counts as good
only if all its labels are 1; repeated rows are judged alike; an empty labels table gives no
cutoffs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.llm.common import bounded, pick, words
from tallywatch.session import stage


@dataclass(frozen=True)
class Risk:
    """Of all good documents of a stratum at most ``risk`` are lost, but for ``error``."""

    risk: float = 0.02
    error: float = 0.05
    min_words: int = 50
    #: Percent of words in repeated 3-word windows that the base rule allows.
    max_repeat: int = 50


#: Rule: its measure (of the columns of ``measure``) and its grid of cutoffs, rising.
RULES = {
    "symbols": ("n_symbols / word_chars", (0.01, 0.02, 0.05, 0.1, 0.2, 0.4)),
    "dup_lines": ("n_dup_lines / n_words", (0.002, 0.005, 0.01, 0.02, 0.05, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    "long_words": ("word_chars / n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
}


def measure(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``lang`` and the counts of the whole text.

    The 3-word windows of a text are hashed to 64 bits and sorted within the row, each with
    its position in the low bits; equal neighbours are repeated windows, and the gaps
    between their positions give the words they cover.
    """
    docs = pick(documents, "doc_id", "lang", "text").withColumn("text", F.coalesce("text", F.lit("")))
    split = docs.withColumn("words", words(F.col("text"))).withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        "doc_id",
        "lang",
        "n",
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        # So many low bits hold a position; at least one, so that a shift is never by 64.
        F.greatest(F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) + 1)), F.lit(1)).cast("int").alias("bits"),
        F.when(
            F.col("n") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 3),
                lambda i: F.xxhash64(
                    F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)
                ),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("hashes"),
    )
    packed = counted.withColumn(
        "packed",
        F.sort_array(
            F.transform(
                "hashes",
                lambda h, i: F.call_function("shiftleft", F.call_function("shiftright", h, F.col("bits")), F.col("bits")).bitwiseOR(
                    i.cast("bigint")
                ),
            )
        ),
    )
    head = lambda x: F.call_function("shiftright", x, F.col("bits"))
    repeated = F.filter(
        F.col("packed"),
        lambda x, i: (head(F.get("packed", i + 1)) == head(x)).eqNullSafe(True)
        | ((i > 0) & (head(F.get("packed", F.greatest(i - 1, F.lit(0)))) == head(x))),
    )
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits")) - 1
    placed = packed.withColumn(
        "at", F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(mask)))
    )
    covered = F.aggregate(
        F.transform(
            "at", lambda p, i: F.least(F.coalesce(F.get("at", i + 1) - p, F.lit(3)), F.lit(3))
        ),
        F.lit(0).cast("bigint"),
        lambda s, x: s + x,
    )
    return placed.select(
        "doc_id",
        "lang",
        F.col("n").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def base_failed(risk: Risk) -> Column:
    return (F.col("n_words") < risk.min_words) | (
        100 * F.col("n_repeat_words") > risk.max_repeat * F.col("n_words")
    )


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, and back by recurrence."""
    y = x + 8
    series = (
        (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi))
        + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    )
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X ~ Bin(n, rate), exact to rounding; 1 where ``k`` is not below the mean.

    The terms fall from k down, each below the one before by i (1-p) / ((n-i+1) p) < 1. They
    are summed from k on; past 60 standard deviations below k nothing is left to add.
    """
    log_top = (
        log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
        + k * F.lit(math.log(rate)) + (n - k) * F.lit(math.log1p(-rate))
    )
    steps = F.least(k, F.ceil(60 * F.sqrt(n * rate) + 60)).cast("bigint")
    down = F.sequence(F.lit(0).cast("bigint"), steps)
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    added = F.aggregate(
        down,
        zero,
        lambda s, j: F.struct(
            (s["term"] * (k - j) * F.lit((1 - rate) / rate) / (n - (k - j) + 1)).alias("term"),
            (s["sum"] + s["term"]).alias("sum"),
        ),
    )["sum"]
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(log_top) * added)


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Per stratum and rule the tested cutoffs: ``n``, ``k``, ``tail``, ``chosen``."""
    good = (
        pick(labels, "doc_id", "quality")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"))
        .filter("quality = 1")
    )
    held = measured.filter(~base_failed(risk)).join(good, F.col("doc_id") == F.col("_doc"))
    tests = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(cut).alias("cutoff"),
                (F.expr(value) > cut).cast("bigint").alias("hit"),
            )
            for rule, (value, grid) in RULES.items()
            for cut in grid
        ]
    )
    counts = (
        held.select("lang", F.inline(tests))
        .groupBy("lang", "rule", "cutoff")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("k"))
    )
    rate = risk.risk / len(RULES)
    all_tests = F.count(F.lit(1)).over(Window.partitionBy())
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    judged = counts.withColumn("tests", all_tests).withColumn("tail", tail(k, n, rate))
    safe = (F.col("tail") <= F.lit(risk.error) / F.col("tests")).cast("int")
    above = Window.partitionBy("lang", "rule").orderBy(F.col("cutoff").desc())
    judged = judged.withColumn(
        "run", F.min(safe).over(above.rowsBetween(Window.unboundedPreceding, 0))
    )
    lowest = F.min(F.when(F.col("run") == 1, F.col("cutoff"))).over(Window.partitionBy("lang", "rule"))
    return judged.select(
        "lang", "rule", "cutoff", "n", "k", "tail", F.coalesce(F.col("cutoff") == lowest, F.lit(False)).alias("chosen")
    )


def judge(documents: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``broken`` (rules), ``kept``."""
    measured = stage(measure(documents), "quality")
    tested = stage(choose_cutoffs(measured, labels, risk), "cutoffs")
    chosen = (
        tested.filter("chosen")
        .groupBy(F.col("lang").alias("_lang"))
        .pivot("rule", list(RULES))
        .agg(F.min("cutoff"))
    )
    broken = F.array_compact(
        F.array(*[F.when(F.expr(value) > F.col(f"`{rule}`"), F.lit(rule)) for rule, (value, _) in RULES.items()])
    )
    return (
        measured.join(bounded(chosen), F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("base_failed", base_failed(risk))
        .withColumn("broken", F.when(F.col("n_words") > 0, broken).otherwise(F.array().cast("array<string>")))
        .select(
            "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "broken", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
        )
    )
