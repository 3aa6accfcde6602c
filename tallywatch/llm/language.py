"""Language identification by word-first backoff.

Known words score their log frequency per language. A word that was not learned is scored
by its character n-grams instead: the longest length of which it has a known n-gram, down to
single letters, with the mean log frequency of the known ones. The scores of all words of
the whole text add up, and the language of the highest sum wins; the score is its posterior
probability under equal priors.

The model is fitted on a bounded sample of labelled rows (``sample_rows``, drawn by a hash of
the text, so it does not depend on ids, labels or partitions) and keeps ``vocabulary`` words
and ``ngrams`` n-grams at most per language and length, the most frequent ones (those of equal
count stay or go together), so its size does not grow with the corpus.

Defined results: ``und`` with score 0 if the text is null, has no letter, or nothing was
learned; a text none of whose words and letters were learned gets the first language by name
with an equal share as score; ties go to the first language by name; rows without language
teach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.llm.common import bounded, pick, place, positional, ship_code
from tallywatch.session import stage

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    vocabulary: int = 30_000
    ngrams: int = 20_000
    longest: int = 4
    #: A language model seen fewer times than this is no evidence.
    least: int = 2


@dataclass
class Model:
    """``languages`` in order, and per known word or n-gram its row of log frequencies."""

    languages: list[str]
    rows: dict[str, int]
    grams: list[dict[str, int]]  # by length, from 1
    scores: np.ndarray


def _tokens(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _counted(longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words (length 0) and n-grams of a batch, counted per language."""
        for batch in batches:
            totals: dict[tuple[str, int, str], int] = {}
            by_lang: dict[str, dict[str, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = by_lang.setdefault(lang, {})
                for word in _tokens(text or ""):
                    seen[word] = seen.get(word, 0) + 1
            for lang, seen in by_lang.items():
                for word, n in seen.items():
                    totals[lang, 0, word] = n
                    marked = f"<{word}>"
                    for size in range(1, longest + 1):
                        for i in range(len(marked) - size + 1):
                            key = lang, size, marked[i : i + size]
                            totals[key] = totals.get(key, 0) + n
            keys = list(totals)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.string()),
                    pa.array(list(totals.values()), pa.int64()),
                ],
                names=["lang", "size", "gram", "n"],
            )

    return count


def fit(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``text`` and ``lang``; only the kept counts come to the driver.

    At most ``vocabulary + longest * ngrams`` rows per language do. No task sees all grams of
    a language: the cut is found from how many there are of each count.
    """
    ship_code(documents.sparkSession)
    known = pick(documents, "lang", "text").filter("lang is not null and text is not null")
    total = known.count()
    if total > settings.sample_rows:
        # A rate, so the bound holds but for chance.
        share = F.lit(settings.sample_rows / total)
        known = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share * float(1 << 40))
    counts = (
        known.select("lang", "text")
        .mapInArrow(_counted(settings.longest), "lang string, size int, gram string, n bigint")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = stage(counts, "grams")
    # The lowest count to keep, from how many grams there are of each count.
    same = counts.groupBy("lang", "size", "n").agg(F.count(F.lit(1)).alias("grams"))
    down = Window.partitionBy("lang", "size").orderBy(F.col("n").desc())
    limit = F.when(F.col("size") == 0, settings.vocabulary).otherwise(settings.ngrams)
    fits = F.when((F.sum("grams").over(down) <= limit) & (F.col("n") >= settings.least), F.col("n"))
    limits = (
        same.withColumn("fits", fits)
        .groupBy("lang", "size")
        .agg(F.min("fits").alias("lowest"), F.sum(F.col("n") * F.col("grams")).alias("total"))
    )
    kept = (
        counts.join(bounded(limits), ["lang", "size"])
        .filter("n >= lowest")
        .select("lang", "size", "gram", "n", "total")
        .collect()
    )
    languages = sorted({r["lang"] for r in kept})
    totals = np.ones((settings.longest + 1, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    rows: list[dict[str, int]] = [{} for _ in range(settings.longest + 1)]
    keys: list[tuple[int, int, int, int]] = []
    n_rows = 0
    for r in kept:
        table = rows[r["size"]]
        if r["gram"] not in table:
            table[r["gram"]] = n_rows
            n_rows += 1
        keys.append((table[r["gram"]], place[r["lang"]], r["n"], r["size"]))
        totals[r["size"], place[r["lang"]]] = r["total"]
    scores = np.full((n_rows, len(languages)), 0.5)
    size_of = np.zeros(n_rows, int)
    for row, lang, n, size in keys:
        scores[row, lang] = n
        size_of[row] = size
    scores = np.log(scores / totals[size_of]) if n_rows else scores
    return Model(languages, rows[0], rows[1:], scores)


class Scorer:
    """Scores texts; words once resolved are remembered, up to a bounded number."""

    def __init__(self, model: Model, remembered: int = 200_000) -> None:
        self.model = model
        self.most = remembered
        self._start()

    def _start(self) -> None:
        self.rows = dict(self.model.rows)
        self.extra: list[np.ndarray] = []
        self.table = self.model.scores

    def _unseen(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        for size in range(len(self.model.grams), 0, -1):
            grams = self.model.grams[size - 1]
            found = [
                grams[g]
                for i in range(len(marked) - size + 1)
                if (g := marked[i : i + size]) in grams and g not in "<>"
            ]
            if found:
                return self.model.scores[found].mean(axis=0)
        return np.zeros(len(self.model.languages))

    def text(self, text: str | None) -> tuple[str, float]:
        # Digits of other scripts and superscripts are word characters, but no letters.
        if not self.model.languages or not any(c.isalpha() for c in text or ""):
            return UNDETERMINED, 0.0
        tokens = _tokens(text)
        if len(self.rows) > self.most + len(self.model.rows):
            self._start()
        get = self.rows.get
        found = [get(w, -1) for w in tokens]
        if -1 in found:
            base = len(self.model.scores)
            for i, w in enumerate(tokens):
                if found[i] < 0:
                    row = get(w)
                    if row is None:
                        row = base + len(self.extra)
                        self.extra.append(self._unseen(w))
                        self.rows[w] = row
                    found[i] = row
        at = np.array(found)
        base = len(self.model.scores)
        total = self.model.scores[at[at < base]].sum(axis=0)
        late = at[at >= base]
        if len(late):
            ids, times = np.unique(late, return_counts=True)
            total = total + times @ np.stack([self.extra[i - base] for i in ids])
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.model.languages[best], float(odds[best] / odds.sum())


def _scored(documents: DataFrame, model: Model) -> DataFrame:
    """Columns by position, then ``lang_pred`` and ``score``."""
    ship_code(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = place(documents.columns, "text")
    rows = positional(documents)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.text(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``."""
    return _scored(documents, model).toDF(*documents.columns, "lang_pred", "score")


def keep_identified(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """``documents`` whose language is known with a score of at least ``least``."""
    kept = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    found = _scored(documents, model).filter(kept).drop("lang_pred", "score")
    return found.toDF(*documents.columns)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, as text, falls in ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
