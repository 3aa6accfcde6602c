"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

The hash rolls over the words joined by one space each, so a passage has the same cuts however
it is wrapped or indented. A text is cut before a word wherever the gear hash of the 16 bytes
before it falls in a quarter of its range: about every fourth word, and at the same places of a
passage whatever stands before or after it, so insertions shift nothing. A chunk that occurred before (in a
lower ``doc_id``, or earlier in the text) is a repeat. Repeats in a row that hold at least
``min_words`` words are cut out of the text, with the white space after them.

A repeated passage is found but for the chunks at its ends, so ``min_words`` is set lower
than the passages sought: with 20, one of 51 words is missed once in 400 cases, one of 60
words once in 4,000.

Within one Arrow batch only the first occurrence of a chunk is shuffled, the others are
known repeats: a chunk that a third of all documents hold is one row per batch. Digests
are 64-bit hashes of the chunk's words; a run takes several of them.

Defined results: a null or wordless text has no chunk and stays as it is; rows of equal
``doc_id`` and text count as one document; of equal ``doc_id`` and different texts one comes
first by its hash; a null ``doc_id`` comes first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallywatch.llm import textarrays as ta
from tallywatch.llm.common import pick, place, positional, ship_code

#: Of 65,536 gear values so many cut.
CUTS = 1 << 14


def chunks(data: np.ndarray, at: np.ndarray):
    """Words and chunks of a run of texts.

    Word starts and ends, first word and digest of every chunk, first chunk of every text.
    """
    start, end, hashes, first = ta.words(data, at)
    joined, place = _joined(data, start, end)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    inside = place - place[first[text]]
    cut = np.zeros(len(start), bool)
    far = inside >= 16
    cut[far] = ta.gear(joined)[place[far] - 1] < CUTS
    cut[first[:-1][np.diff(first) > 0]] = True
    low = np.flatnonzero(cut)
    high = np.append(low[1:], len(start)) if len(low) else low
    return start, end, low, ta.sequences(hashes, low, high), np.searchsorted(low, first), hashes, first


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and where each word begins there."""
    size = end - start
    place = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(place[-1], 0x20, np.uint8)
    # Words are all there is but white space, in order.
    joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[~ta.SPACE[data]]
    return joined, place[:-1]


def _marks(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """31 bits of each text, above the 32 bits of a chunk's number."""
    whole = ta.sequences(hashes, first[:-1], first[1:])
    return (whole >> np.uint64(33)).astype(np.int64) << 32


def _occurrences(batches: Iterator[pa.RecordBatch], local: bool) -> Iterator[pa.RecordBatch]:
    """Per batch each chunk's first occurrence, or with ``local`` all others."""
    for batch in batches:
        data, at = ta.layout(batch.column(1))
        digest, row, place = [], [], []
        for i, j in ta.row_groups(at):
            part, bounds = data[at[i] : at[j]], at[i : j + 1] - at[i]
            _, _, low, digests, firsts, hashes, first = chunks(part, bounds)
            text = np.repeat(np.arange(j - i), np.diff(firsts))
            digest.append(digests)
            row.append(text + i)
            place.append(_marks(hashes, first)[text] + (np.arange(len(low)) - firsts[text]))
        if not digest:
            continue
        digest, row, place = map(np.concatenate, (digest, row, place))
        column = batch.column(0)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        # Nulls filled, so that integers stay integers.
        filler = 0 if pa.types.is_integer(column.type) else ""
        ids = column.fill_null(filler).to_numpy(zero_copy_only=False)
        rank = np.zeros(len(ids), np.int64)
        if known.any():
            # Equal ids need equal ranks; null comes first.
            rank[known] = np.unique(ids[known], return_inverse=True)[1] + 1
        order = np.lexsort((place, rank[row], digest))
        sorted_digest = digest[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_digest[1:] != sorted_digest[:-1]
        if local:
            # The same place again (a repeated row) is no repeat.
            key = np.stack([rank[row][order], place[order]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            chosen = order[~new & (key != key[:, lead]).any(axis=0)]
        else:
            chosen = order[new]
        out = [batch.column(0).take(pa.array(row[chosen])), pa.array(place[chosen])]
        names = ["doc_id", "place"]
        if not local:
            out.insert(0, pa.array(digest[chosen].view(np.int64)))
            names.insert(0, "digest")
        yield pa.RecordBatch.from_arrays(out, names=names)


def _cut_out(min_words: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = ta.layout(batch.column(1))
            repeats = batch.column(2)
            texts, spans = [], []
            for i in range(batch.num_rows):
                taken = repeats[i].as_py()
                part = data[at[i] : at[i + 1]]
                found: list[tuple[int, int]] = []
                if taken:
                    bounds = np.array([0, len(part)])
                    start, end, low, _, _, _, _ = chunks(part, bounds)
                    again = np.zeros(len(low) + 2, bool)
                    again[np.unique(np.array(taken)) + 1] = True
                    edges = np.flatnonzero(again[1:] != again[:-1])
                    word = np.append(low, len(start))
                    for a, b in zip(edges[::2], edges[1::2]):
                        if word[b] - word[a] >= min_words:
                            found.append((int(word[a]), int(word[b])))
                if not found:
                    texts.append(batch.column(1)[i])
                    spans.append([])
                    continue
                kept, here = [], 0
                for a, b in found:
                    kept.append(part[here : start[a]].tobytes())
                    here = int(start[b]) if b < len(start) else len(part)
                kept.append(part[here:].tobytes())
                texts.append(pa.scalar(b"".join(kept).decode()))
                spans.append([{"first": a, "words": b - a} for a, b in found])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            text = pa.array([t.as_py() for t in texts], batch.column(1).type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(spans, kind)], names=["_key", "text", "removed"]
            )

    return apply


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``place``: every chunk that is not the first of its digest."""
    kind = dict(docs.dtypes)["doc_id"]
    firsts = docs.mapInArrow(
        lambda b: _occurrences(b, False), f"digest bigint, doc_id {kind}, place bigint"
    )
    order = Window.partitionBy("digest").orderBy("doc_id", "place")
    known = F.first(F.struct("doc_id", "place")).over(order)
    later = (
        firsts.withColumn("known", known)
        .filter(~F.struct("doc_id", "place").eqNullSafe(F.col("known")))
        .select("doc_id", "place")
    )
    local = docs.mapInArrow(lambda b: _occurrences(b, True), f"doc_id {kind}, place bigint")
    return later.unionByName(local)


def dedup_substrings(documents: DataFrame, min_words: int = 20) -> DataFrame:
    """``documents`` with repeats cut out of ``text``, and ``removed``.

    ``removed``: structs of first word (0-based, in the old text) and number of words.
    """
    ship_code(documents.sparkSession)
    narrow = pick(documents, "doc_id", "text")
    found = (
        repeated_chunks(narrow)
        .withColumn("mark", F.shiftright("place", 32))
        .withColumn("chunk", F.col("place").bitwiseAND(F.lit((1 << 32) - 1)))
        .groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"))
        .agg(F.collect_list("chunk").alias("chunks"))
    )
    columns = documents.columns
    doc, text = place(columns, "doc_id"), place(columns, "text")
    rows = _marked(positional(documents), f"_{text}")
    met = rows.join(
        found, F.col(f"_{doc}").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left"
    )
    rest = [f"_{i}" for i in range(len(columns)) if i != text]
    kinds = dict(rows.dtypes)
    key = F.struct(*rest)
    kind = "struct<" + ",".join(f"{n}:{kinds[n]}" for n in rest) + ">"
    done = met.select(key.alias("_key"), F.col(f"_{text}").alias("text"), "chunks").mapInArrow(
        _cut_out(min_words), f"_key {kind}, text string, removed array<struct<first:bigint,words:bigint>>"
    )
    names = [
        F.col("text").alias(n) if i == text else F.col(f"_key._{i}").alias(n)
        for i, n in enumerate(columns)
    ]
    return done.select(*names, "removed")


def _mark_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = ta.layout(batch.column(batch.num_columns - 1))
        marks = [np.zeros(0, np.int64)]
        for i, j in ta.row_groups(at):
            _, _, hashes, first = ta.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            marks.append(_marks(hashes, first) >> 32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.concatenate(marks))], names=[*batch.schema.names, "mark"]
        )


def _marked(rows: DataFrame, text: str) -> DataFrame:
    """``rows``, the text last, with the mark of the text."""
    last = rows.select(*[n for n in rows.columns if n != text], text)
    kinds = ", ".join(f"{n} {t}" for n, t in last.dtypes)
    return last.mapInArrow(_mark_texts, f"{kinds}, mark bigint")
