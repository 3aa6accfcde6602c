"""Benchmark decontamination by SimHash of item-sized windows, in Spark expressions.

For an item of n words the windows of n words of a document are fingerprinted (64-bit
SimHash over shingles, each weighted by how often the window holds it) and looked up among
the items of that size: fingerprints are cut into ``radius + 1`` blocks, and two that differ
in at most ``radius`` bits agree on one block at least, so the joins on (size, block, value)
miss none within the radius. What is within it is verified by the exact weighted Jaccard
similarity of the shingles. At the default radius a window of similarity 0.8 is within it in
more than 999 of 1,000 cases, a verbatim one always.

Windows are only made where they can count: a window whose similarity is not zero shares a
shingle with an item of its size, so the positions of shared shingles (one equi-join on the
shingle hashes of all whole texts) tell every window worth a fingerprint. Fingerprints of all windows
of all sizes would be forty times the words of the corpus.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` as written; an item of fewer words than a
shingle is one shingle; a document shorter than an item is one window; null or wordless
texts and items match nothing; rows of equal ``doc_id`` and text share their result; items that
repeat are reported each; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.llm.common import bounded, pick, place, positional, words
from tallywatch.session import stage


@dataclass(frozen=True)
class Leak:
    size: int = 5
    threshold: float = 0.8
    radius: int = 19


def shingles(of: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; none in a shorter text."""
    last = F.size(of) - size
    hashes = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(size)]),
    )
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the shingles, repeats counted, have it."""
    zero, half = F.lit(0).cast("bigint"), F.size(hashes)
    bits = []
    bit = lambda h, b: F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1))

    def pair(b: int) -> Column:
        """Two counters in one sum, 32 bits each."""
        return F.aggregate(
            hashes, zero, lambda s, h: s + bit(h, b) + F.shiftleft(bit(h, b + 1), 32)
        )

    for b in range(0, 64, 2):
        both = pair(b)
        count = both.bitwiseAND(F.lit((1 << 32) - 1))
        bits.append((b, count))
        bits.append((b + 1, F.shiftrightunsigned(both, 32)))
    value = zero
    for b, count in bits:
        value = value.bitwiseOR(F.when(2 * count > half, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(zero))
    return value


def blocks(fingerprint: Column, radius: int) -> Column:
    """``radius + 1`` blocks of the 64 bits, as structs of number and value."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("number"),
                F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"),
            )
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def similarity(left: Column, right: Column) -> Column:
    """Weighted Jaccard of two bags of shingles: the sum of the lower over that of the higher counts."""
    # The k-th occurrence of a shingle is an element of its own.
    numbered = lambda bag: F.transform(
        bag,
        lambda h, i: F.struct(h.alias("h"), F.size(F.filter(F.slice(bag, 1, i), lambda x: x == h)).alias("k")),
    )
    common = F.size(F.array_intersect(numbered(left), numbered(right)))
    return common / (F.size(left) + F.size(right) - common)


def find_leaks(documents: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """``doc_id``, ``mark`` (of the text), ``item_id``, ``first`` word, ``words``, ``similarity``.

    One row per document and item: its most similar window, of equal ones the first.
    """
    items = (
        pick(benchmark, "item_id", "text")
        .select("item_id", words(F.col("text")).alias("ws"))
        .withColumn("n", F.size("ws"))
        .filter("n > 0")
    )
    sizes = [r[0] for r in items.select(F.least("n", F.lit(leak.size))).distinct().collect()]
    docs = pick(documents, "doc_id", "text").filter("text is not null")
    found = None
    for size in sorted(sizes):
        own = items.filter(F.least("n", F.lit(leak.size)) == size)
        part = _of_size(docs, own, size, leak)
        found = part if found is None else found.unionByName(part)
    if found is None:
        empty = docs.select("doc_id", F.xxhash64("text").alias("mark")).limit(0)
        item = items.select("item_id").limit(0)
        return empty.join(item, F.lit(False)).select(
            "doc_id", "mark", "item_id",
            F.lit(0).alias("first"), F.lit(0).alias("words"), F.lit(0.0).alias("similarity"),
        )
    return found


def _of_size(docs: DataFrame, items: DataFrame, size: int, leak: Leak) -> DataFrame:
    """Leaks of the items whose shingles have ``size`` words."""
    item = stage(
        items.select("item_id", "n", shingles(F.col("ws"), size).alias("bag")).select(
            "item_id", "n", "bag", simhash(F.col("bag")).alias("print")
        ),
        "items",
    )
    anchors = item.select("n", F.explode("bag").alias("_hash")).distinct()
    read = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("ws"))
    hits = (
        read.select("doc_id", "mark", F.size("ws").alias("n_doc"), F.posexplode(shingles(F.col("ws"), size)))
        .withColumnRenamed("col", "hash")
        .join(bounded(anchors, 100_000), F.col("hash") == F.col("_hash"))
        .groupBy("doc_id", "mark", "n", "n_doc")
        .agg(F.collect_set("pos").alias("at"))
    )
    # Starts of the windows that hold a shared shingle.
    latest = F.greatest(F.col("n_doc") - F.col("n"), F.lit(0))
    starts = F.array_distinct(
        F.flatten(
            F.transform(
                "at",
                lambda p: F.sequence(
                    F.greatest(F.least(p, latest) - (F.col("n") - size), F.lit(0)), F.least(p, latest)
                ),
            )
        )
    )
    hits = stage(hits.select("doc_id", "mark", "n", starts.alias("starts")), "hits")
    named = hits.select(
        F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("n").alias("n"), "starts"
    )
    # Repeated rows give the same windows twice; the last step takes the best of them.
    of_doc = docs.withColumn("mark", F.xxhash64("text")).join(
        bounded(named, weight=F.size("starts")), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    )
    windows = (
        of_doc.select("doc_id", "mark", "n", "starts", words(F.col("text")).alias("ws"))
        .select("doc_id", "mark", "n", "starts", shingles(F.col("ws"), size).alias("bags"))
        .select("doc_id", "mark", "n", "bags", F.explode("starts").alias("first"))
        .select("doc_id", "mark", "n", "first", F.slice("bags", F.col("first") + 1, F.col("n") - size + 1).alias("bag"))
        .select("doc_id", "mark", "n", "first", "bag", simhash(F.col("bag")).alias("print"))
    )
    windows = stage(windows, "windows")
    keyed = windows.select("doc_id", "mark", "n", "first", "print", F.explode(blocks(F.col("print"), leak.radius)).alias("b"))
    table = item.select(
        F.col("item_id"), F.col("n").alias("_n"), F.col("print").alias("_print"),
        F.explode(blocks(F.col("print"), leak.radius)).alias("_b"),
    )
    near = (
        keyed.join(
            bounded(table, 100_000),
            (F.col("n") == F.col("_n"))
            & (F.col("b.number") == F.col("_b.number"))
            & (F.col("b.value") == F.col("_b.value"))
            & (F.bit_count(F.col("print").bitwiseXOR(F.col("_print"))) <= leak.radius),
        )
        .select("doc_id", "mark", "n", "first", "item_id")
        .distinct()
    )
    near = stage(near, "near")
    same = (
        windows.select(
            F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("n").alias("_n"), F.col("first").alias("_first"), "bag"
        )
        .join(
            bounded(near),
            F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
            & (F.col("n") == F.col("_n")) & (F.col("first") == F.col("_first")),
        )
        .join(
            bounded(
                item.select(F.col("item_id").alias("_item"), F.col("bag").alias("_bag"), F.col("n").alias("_size")),
                weight=F.size("_bag"),
            ),
            F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("n") == F.col("_size")),
        )
        .withColumn("similarity", similarity(F.col("bag"), F.col("_bag")))
        .filter(F.col("similarity") >= leak.threshold)
    )
    best = F.max(F.struct("similarity", (-F.col("first")).alias("first"), F.col("n").alias("n")))
    return (
        same.groupBy("doc_id", "mark", "item_id")
        .agg(best.alias("best"))
        .select(
            "doc_id", "mark", "item_id", (-F.col("best.first")).alias("first"),
            F.col("best.n").alias("words"), F.col("best.similarity").alias("similarity"),
        )
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """``documents`` with ``leaks``: structs of item_id, first word, words and similarity."""
    leaks = (
        find_leaks(documents, benchmark, leak)
        .groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"))
        .agg(F.sort_array(F.collect_list(F.struct("item_id", "first", "words", "similarity"))).alias("leaks"))
    )
    leaks = stage(leaks, "leaks")
    columns = documents.columns
    kind = dict(leaks.dtypes)["leaks"]
    rows = positional(documents)
    doc, text = F.col(f"_{place(columns, 'doc_id')}"), F.col(f"_{place(columns, 'text')}")
    return (
        rows.join(
            bounded(leaks, weight=F.size("leaks")),
            doc.eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_mark")),
            "left",
        )
        .select(*rows.columns, F.coalesce("leaks", F.array().cast(kind)).alias("leaks"))
        .toDF(*columns, "leaks")
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame, leak: Leak = Leak()) -> DataFrame:
    """``documents`` that hold no window of an item."""
    done = positional(decontaminate(documents, benchmark, leak))
    last = done.columns[-1]
    return done.filter(F.size(last) == 0).drop(last).toDF(*documents.columns)
