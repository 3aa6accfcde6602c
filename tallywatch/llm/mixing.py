"""Mixing sources to target weights by Sainte-Lague apportionment, in Spark expressions.

Sources get token targets by weight, none above ``cap`` times what it has (the excess is
shared again by weight). Each source is dealt into shards by a hash of its documents, of their
ids and texts, and each shard's words, in order of the documents, are cut into blocks of equal length. Seats,
one for each block's worth of the mix, go to the highest quotients votes / (2 seats + 1):
first over the sources, with their targets as votes, then over the shards of each source,
with their words as votes. A shard's quota takes every block equally often and gives what is
left to the blocks with the lowest seeded draws.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a
source, the last in order; equal quotients go to the earlier source or shard; a null ``doc_id``
comes first in its shard, and rows of one ``doc_id`` are in order of a hash of their texts;
repeated rows are documents of their own, which lie in one shard; further columns, also of
clashing names, are ignored; an empty table gives an empty result.

Only sums leave the documents: one row per source (window in one task), one per shard
(ranked within its source; a shard has two million words) and one per block (ranked within
its shard). A source with most of the rows is therefore many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.llm.common import bounded, pick, unit_draw, words
from tallywatch.session import stage


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, a null source last."""

    weights: tuple[int, ...] = (3, 1, 2)
    #: Words of the mix, as a multiple of all words.
    total: float = 1.5
    #: Most of a source's target, as a multiple of its words.
    cap: int = 2
    block_words: int = 128
    shard_words: int = 1 << 21
    seed: int = 17


def sizes(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, the number of words of the whole text, and ``mark``, its hash."""
    docs = pick(documents, "doc_id", "source", "text")
    size = F.size(words(F.col("text"))).cast("bigint").alias("size")
    return docs.select("doc_id", "source", size, mark_of(F.col("text")).alias("mark"))


def mark_of(text: Column) -> Column:
    """What tells a text from others; null is as the empty one."""
    return F.md5(F.coalesce(text, F.lit("")))


def targets(totals: DataFrame, mix: Mix) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(mix.weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(mix.cap))
    rows = totals.select("*", weight.alias("weight"), cap.alias("room")).withColumn(
        "ratio", F.col("room") / F.col("weight")
    )
    # Fill up in order of room per weight: a source is full if the level reaches its ratio.
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    all_words = F.sum(F.col("source_size").cast("double")).over(whole) * F.lit(mix.total)
    level = (all_words - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(
        from_here
    )
    rows = rows.withColumn("level", level)
    # Past the first such source levels only fall.
    reached = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    share = F.col("weight") * F.col("reached")
    return rows.withColumn("reached", reached).select(
        "source",
        "source_size",
        F.when(F.col("reached").isNull() | (share > F.col("room")), F.col("room"))
        .otherwise(share)
        .alias("target"),
    )


def apportion(entries: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Add ``quota``: the Sainte-Lague seats of each entry within its group.

    ``entries`` has ``votes`` (double), ``most`` (the most seats an entry can hold) and
    ``seats`` (of the group). Seats that are certain are given at once: with n entries,
    rounded shares of ``seats - n`` are never too many. Only the quotients around the cut
    are ranked, a few rows per entry.
    """
    own = Window.partitionBy(*group)
    total, n = F.sum("votes").over(own), F.count(F.lit(1)).over(own)
    rows = entries.withColumn("_total", total).withColumn("_n", n)
    sure = F.floor(F.col("votes") * F.greatest(F.col("seats") - F.col("_n"), F.lit(0)) / F.col("_total") + 0.5)
    rows = rows.withColumn(
        "_sure", F.when(F.col("_total") > 0, F.least(F.col("most"), sure)).otherwise(F.lit(0)).cast("bigint")
    )
    rows = rows.withColumn("_left", F.col("seats") - F.sum("_sure").over(own))
    more = F.ceil(2 * (F.col("_left") + F.col("_n")) * F.col("votes") / F.col("_total")) + 2
    rows = rows.withColumn(
        "_more",
        F.when(F.col("votes") > 0, F.greatest(F.least(F.col("most") - F.col("_sure"), more), F.lit(0)))
        .otherwise(F.lit(0))
        .cast("bigint"),
    )
    # The row without a seat number keeps entries that have no quotient to rank.
    seats = F.concat(
        F.array(F.lit(None).cast("bigint")),
        F.when(F.col("_more") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_more") - 1)).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    ranked = rows.withColumn("_j", F.explode(seats)).withColumn(
        "_quotient", F.col("votes") / (2 * (F.col("_sure") + F.col("_j")) + 1)
    )
    by_quotient = Window.partitionBy(*group).orderBy(
        F.col("_quotient").desc_nulls_last(), *order, F.col("_j")
    )
    won = F.col("_j").isNotNull() & (F.col("_rank") <= F.col("_left"))
    return (
        ranked.withColumn("_rank", F.row_number().over(by_quotient))
        .groupBy(*entries.columns, "_sure")
        .agg(F.count_if(won).alias("_won"))
        .select(*entries.columns, (F.col("_sure") + F.col("_won")).cast("bigint").alias("quota"))
    )


def shards(sized: DataFrame, goal: DataFrame, mix: Mix) -> DataFrame:
    """Documents with their shard and the words before them in it."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = unit_draw(F.lit(mix.seed), F.lit("shard"), doc, F.col("mark"))
    n_shards = F.greatest(F.ceil(F.col("source_size") / F.lit(float(mix.shard_words))), F.lit(1))
    dealt = (
        sized.filter("size > 0")
        .join(bounded(goal), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("shard", F.floor(draw * n_shards))
    )
    earlier = (
        Window.partitionBy("source", "shard")
        .orderBy("doc_id", "mark")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return dealt.select(
        "doc_id", "source", "shard", "size", "mark", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start")
    )


def mix_sources(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document with what the mix takes of it.

    ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` (of its source), ``taken``
    (words, repeats counted), ``pieces``: structs of first word (0-based), number of
    words and times, in order, of the parts of the document that are taken, and ``mark``, which
    with ``doc_id`` tells whose text they are of (see ``with_texts``).
    """
    sized = stage(sizes(documents), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stage(targets(totals, mix), "mix-targets")
    named = goal.withColumnRenamed("source", "_source")
    dealt = stage(shards(sized, named, mix), "mix-shards")

    block = F.lit(float(mix.block_words))
    parts = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    parts = parts.withColumn(
        "blocks", F.greatest(F.floor(F.col("shard_size") / block + 0.5), F.lit(1)).cast("bigint")
    )
    parts = stage(parts, "mix-parts")
    # Seats of the sources: all targets in blocks, over the sources' targets as votes.
    held = parts.groupBy(F.col("source").alias("_held")).agg(F.sum("blocks").alias("blocks"))
    sources = (
        goal.join(held, F.col("source").eqNullSafe(F.col("_held")))
        .select("source", F.col("target").alias("votes"), (F.col("blocks") * mix.cap).alias("most"))
        .withColumn("one", F.lit(1))
    )
    seats = F.floor(F.sum("votes").over(Window.partitionBy("one")) / block + 0.5).cast("bigint")
    quotas = apportion(sources.withColumn("seats", seats), ["one"], [F.col("source").asc_nulls_last()])
    per_source = quotas.select(F.col("source").alias("_source"), F.col("quota").alias("seats"))
    votes = parts.join(bounded(per_source), F.col("source").eqNullSafe(F.col("_source"))).select(
        "source",
        "shard",
        "shard_size",
        "blocks",
        "seats",
        F.col("shard_size").cast("double").alias("votes"),
        (F.col("blocks") * mix.cap).alias("most"),
    )
    quota = stage(apportion(votes, ["source"], [F.col("shard").asc()]), "mix-quotas").select(
        "source", "shard", "shard_size", "blocks", "quota"
    )

    # Times of each block: all equally often, the rest by the lowest draws.
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    drawn = quota.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    lowest = Window.partitionBy("source", "shard").orderBy(
        unit_draw(F.lit(mix.seed), F.lit("block"), name, F.col("shard"), F.col("block")), "block"
    )
    even, rest = F.expr("quota div blocks"), F.expr("quota % blocks")
    times = drawn.withColumn("rank", F.row_number().over(lowest)).select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "block",
        F.expr("(block * shard_size) div blocks").alias("block_start"),
        F.expr("((block + 1) * shard_size) div blocks").alias("block_end"),
        (even + (F.col("rank") <= rest).cast("bigint")).alias("times"),
    )
    # A document meets the blocks that its words fall into. Its start is its key in the shard.
    at = dealt.join(
        bounded(
            quota.select(
                F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "blocks"
            )
        ),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")),
    ).select(
        "doc_id",
        "source",
        "shard",
        "size",
        "mark",
        "start",
        F.explode(
            F.expr(
                "sequence(((start + 1) * blocks - 1) div shard_size,"
                " ((start + size) * blocks - 1) div shard_size)"
            )
        ).alias("at"),
    )
    first = F.greatest(F.col("start"), F.col("block_start")) - F.col("start")
    length = F.least(F.col("start") + F.col("size"), F.col("block_end")) - F.greatest(
        F.col("start"), F.col("block_start")
    )
    piece = F.struct(first.alias("first"), length.alias("length"), F.col("times").alias("times"))
    met = (
        at.join(
            # Its size is guessed from the shards it comes from, far too low for a broadcast.
            times.filter("times > 0").hint("merge"),
            F.col("source").eqNullSafe(F.col("_source"))
            & (F.col("shard") == F.col("_shard"))
            & (F.col("at") == F.col("block")),
            "left",
        )
        .groupBy("doc_id", "source", "shard", "size", "mark", "start")
        .agg(
            F.coalesce(F.sum(F.col("times") * length), F.lit(0)).cast("bigint").alias("taken"),
            F.sort_array(F.collect_list(F.when(F.col("times").isNotNull(), piece))).alias("pieces"),
        )
        .select("doc_id", "source", "size", "mark", "taken", "pieces")
    )
    none = F.array().cast(dict(met.dtypes)["pieces"])
    wordless = sized.filter("size = 0").select(
        "doc_id", "source", "size", "mark", F.lit(0).cast("bigint").alias("taken"), none.alias("pieces")
    )
    return (
        met.unionByName(wordless)
        .join(bounded(named), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "pieces", "mark")
    )


def with_texts(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of a mix with the ``text`` of their document, and no ``mark``.

    A row's text is that of its ``doc_id`` and mark; a null text is the empty one.
    """
    docs = pick(documents, "doc_id", "text").select(
        F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"), mark_of(F.col("text")).alias("_mark")
    )
    # Rows that repeat a row stand for one text.
    texts = docs.dropDuplicates(["_doc", "_mark"])
    same = (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    return mixed.join(texts.hint("merge"), same).drop("mark", "_doc", "_mark")


def taken_text(text: Column, pieces: Column) -> Column:
    """The words that the mix takes of a text, joined by spaces: each piece as often as it says."""
    own = words(text)
    cut = F.transform(
        pieces,
        lambda p: F.concat_ws(
            " ", F.array_repeat(F.array_join(F.slice(own, (p["first"] + 1).cast("int"), p["length"].cast("int")), " "), p["times"].cast("int"))
        ),
    )
    return F.concat_ws(" ", cut)
