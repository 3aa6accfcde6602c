"""Spelling variants by permuterm rotations.

A word with a terminator has one rotation for every place where it can be cut: ``s$p`` for the
word ``ps``. Two words that differ by one replaced character at the same place have rotations
that agree up to their last character, the replaced one; if one word lacks a character the
other has, its whole rotation is the other's without that last character. So a rotation is
sorted under its prefix that skips the edited character, and all near words of a word are in the
groups of its prefixes. A scan of a sorted group gives each member the number of its neighbours
there and the best of them; no pair is ever made. A group holds at most one shorter word
and one word per letter of the alphabet, 90 of them.

A prefix is known by 128 bits of rolling hashes, which are linear in a word's length for all its
rotations together; among a billion words two different prefixes agree with a chance below
one in 10^15. A word is known by its rank by falling frequency and code points, so the better
of two neighbours is the lower number and words of any length move as eight bytes.

A character inserted into a run of equal ones gives the same word at each place of the run; only
the first place counts, so each near pair is met once and counts need no removal of repeats.

Defined results: null and empty texts have no words; a null ``doc_id`` is written as the empty
text in the draw; repeated rows count again; words may have any length; further columns, also
of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.llm.common import pick, ship_code
from tallywatch.llm.textarrays import mixed
from tallywatch.operators.ordered import ranked
from tallywatch.session import stage

# The letters of a run, and those that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Variants:
    """Words of ``length`` letters seen ``times``; a form is ``ratio`` times as frequent.

    In one of ``thinned`` (document, run) pairs a letter of the run is left out.
    """

    length: int = 7
    times: int = 2
    ratio: int = 10
    thinned: int = 31


_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_random = np.random.RandomState(23)
#: A random number per hash and letter; the last one is the terminator's.
_LETTERS = (_random.randint(0, 1 << 62, (2, 0x101)).astype(_U) << _U(1)) | _U(1)
_NONE = np.iinfo(np.int64).max
#: Letters whose rotations are made at once.
_SEGMENT = 1 << 18


def _powers(base: np.uint64, n: int) -> np.ndarray:
    values = np.full(n, base, _U)
    values[0] = 1
    return np.multiply.accumulate(values)


def _inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


def _prefixes(words: list[str]) -> tuple[np.ndarray, ...]:
    """Of all rotations of all words: word number, kind, and the two hashes of the prefix.

    Kind 0 is a whole rotation; 1 and 2 are rotations without their last character, 2 if it
    repeats the one before it in the word.
    """
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    # Places 0..size of each word: where it is cut.
    cut_word = np.repeat(np.arange(len(words)), size + 1)
    cut = np.arange(len(cut_word)) - np.repeat(begin[:-1] + np.arange(len(words)), size + 1)
    edit_word = np.repeat(np.arange(len(words)), size)
    edit = np.arange(len(codes)) - begin[edit_word]
    before = np.zeros(len(codes), bool)
    before[1:] = (codes[1:] == codes[:-1]) & (edit[1:] > 0)
    longest = int(size.max()) + 2
    hashes = []
    for which, base in enumerate(_BASES):
        power, back = _powers(base, longest), _powers(_inverse(base), longest)
        letter = _LETTERS[which][codes]
        total = np.zeros(len(codes) + 1, _U)
        np.cumsum(letter * power[edit], out=total[1:])
        end = total[begin[1:]]
        terminator = _LETTERS[which][0x100]

        def rotation(word: np.ndarray, upto: np.ndarray, after: np.ndarray) -> np.ndarray:
            """The hash of word[after:] + terminator + word[:upto]."""
            tail = size[word] - after
            first = total[begin[word]]
            h = (end[word] - total[begin[word] + after]) * back[after]
            h = h + terminator * power[tail] + (total[begin[word] + upto] - first) * power[tail + 1]
            return mixed(h + (tail + upto).astype(_U))

        hashes.append(np.concatenate([rotation(cut_word, cut, cut), rotation(edit_word, edit, edit + 1)]))
    kind = np.concatenate([np.zeros(len(cut), np.int8), np.where(before, 2, 1).astype(np.int8)])
    return np.concatenate([cut_word, edit_word]), kind, hashes[0].view(np.int64), hashes[1].view(np.int64)


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``high, low, kind, rank`` of every prefix of every word."""
    for batch in batches:
        ranks = batch.column(0).to_numpy()
        words = batch.column(1).to_pylist()
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _SEGMENT, "right")) - 1)
            word, kind, high, low = _prefixes(words[i:j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(high), pa.array(low), pa.array(kind), pa.array(ranks[i:j][word])],
                names=["high", "low", "kind", "rank"],
            )
            i = j


def _neighbours(high: np.ndarray, low: np.ndarray, kind: np.ndarray, rank: np.ndarray):
    """Of sorted prefixes: rank, number of near words in the group, and the lowest of them."""
    change = np.ones(len(high), bool)
    change[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(change)
    group = np.cumsum(change) - 1
    shorter, longer, leads = kind == 0, kind > 0, kind == 1

    def lowest(mask: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(mask, rank, _NONE), starts)

    def number(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), starts)

    of_short, of_long, of_lead = lowest(shorter)[group], lowest(longer)[group], lowest(leads)[group]
    second = lowest(longer & (rank != of_long))[group]
    has_short = leads & (of_short != _NONE)
    near = np.where(shorter, number(leads)[group], number(longer)[group] - 1 + has_short)
    best = np.where(shorter, of_lead, np.where(rank == of_long, second, of_long))
    best = np.where(has_short, np.minimum(best, of_short), best)
    met = near > 0
    return rank[met], near[met], best[met]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbours in every group of sorted rotations; a group may go on in the next batch."""
    held: list[np.ndarray] | None = None

    def record(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in _neighbours(*columns)], names=["rank", "near", "best"]
        )

    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(4)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        if not len(columns[0]):
            continue
        open_group = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = int(np.flatnonzero(open_group)[0])  # sorted, so the last group is the end
        held = [c[cut:] for c in columns]
        if cut:
            yield record([c[:cut] for c in columns])
    if held is not None:
        yield record(held)


def word_counts(documents: DataFrame, variants: Variants = Variants()) -> DataFrame:
    """``word, n``: the words of all texts and how often they occur."""
    docs = pick(documents, "doc_id", "text")
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))
    lowered = docs.select("doc_id", F.explode(runs).alias("run")).select(
        "doc_id", F.translate("run", UPPER, LOWER).alias("run")
    )
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    draw: Column = F.crc32(named.cast("binary"))
    at = F.pmod(F.col("draw"), F.length("run")).cast("int")
    thinned = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = (
        # A shorter run cannot become long enough, whatever is left out.
        lowered.filter(F.length("run") >= variants.length)
        .withColumn("draw", draw)
        .select(F.when(F.col("draw") % variants.thinned == 0, thinned).otherwise(F.col("run")).alias("word"))
        .filter(F.length("word") >= variants.length)
    )
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= variants.times)


def near_words(words: DataFrame) -> DataFrame:
    """Of ``rank, word``: ``rank``, ``n_near`` and ``best``, the lowest rank of a near word.

    Words without a near word are left out.
    """
    ship_code(words.sparkSession)
    rotations = words.select("rank", "word").mapInArrow(
        _rotations, "high bigint, low bigint, kind tinyint, rank bigint"
    )
    scanned = (
        rotations.repartition("high", "low")
        .sortWithinPartitions("high", "low")
        .mapInArrow(_scanned, "rank bigint, near bigint, best bigint")
    )
    return scanned.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """``rank, to`` links followed to their ends by doubling.

    Each step goes to a word at least ``ratio`` times as frequent, so for a ratio of 10
    chains have at most 18 links and five rounds are enough.
    """
    while True:
        further = links.select(F.col("rank").alias("_rank"), F.col("to").alias("_to"))
        joined = links.join(further.hint("merge"), F.col("to") == F.col("_rank"), "left")
        step = stage(
            joined.select("rank", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")),
            "roots",
        )
        links = step.select("rank", "to")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(documents: DataFrame, variants: Variants = Variants()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts."""
    counts = stage(word_counts(documents, variants), "word-counts")
    words = stage(ranked(counts, [F.desc("n"), F.asc("word")], "rank"), "words")
    near = stage(near_words(words), "near-words")
    better = words.select(F.col("rank").alias("_better"), F.col("n").alias("_better_n"))
    known = (
        words.join(near.withColumnRenamed("rank", "_rank").hint("merge"), F.col("rank") == F.col("_rank"), "left")
        .join(better.hint("merge"), F.col("best") == F.col("_better"), "left")
        .withColumn("_has", F.col("_better_n") >= variants.ratio * F.col("n"))
        .select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(F.col("_has"), F.col("best")).alias("form_rank"),
            F.when(F.col("_has"), F.col("_better_n")).alias("form_n"),
        )
    )
    known = stage(known, "forms")
    links = known.filter("form_rank is not null").select("rank", F.col("form_rank").alias("to"))
    roots = _roots(links).select(F.col("rank").alias("_linked"), F.col("to").alias("root_rank"))
    forms = words.select(F.col("rank").alias("_form"), F.col("word").alias("form"))
    ends = words.select(F.col("rank").alias("_root"), F.col("word").alias("root"))
    return (
        known.join(roots.hint("merge"), F.col("rank") == F.col("_linked"), "left")
        .join(forms.hint("merge"), F.col("form_rank") == F.col("_form"), "left")
        .join(ends.hint("merge"), F.col("root_rank") == F.col("_root"), "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
