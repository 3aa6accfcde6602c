"""Chat formatting with Spark expressions only: one training text per conversation.

The turns of a conversation are collected as structs and sorted, adjacent turns of one
role become a run, and a run becomes

    [INST] role [/INST] text [NEXT] text ... </s>

(without the blanks) after one leading ``<s>``. ``[NEXT]`` keeps the texts of a run apart,
so that the turns can be read back as they were. A control string inside a text or role
gets one backslash after its first character, and one more for each it had: the formatted
text then holds control strings only where the template put them, and removing one
backslash gives the text back.

Defined results: a null text or role counts as empty; turns of equal number are ordered by
role and text, and repeated rows are turns of their own; a null turn comes first; a null
``conv_id`` is one conversation; an empty table gives an empty result. A conversation is
one record of the output, so its turns meet in one task, and it must fit a Spark row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.llm.common import pick


@dataclass(frozen=True)
class Template:
    """Control strings; each starts with ``<`` or ``[`` and holds no backslash."""

    begin: str = "<s>"
    head: str = "[INST]"
    body: str = "[/INST]"
    next: str = "[NEXT]"
    end: str = "</s>"

    def controls(self) -> list[str]:
        return [self.begin, self.head, self.body, self.next, self.end]

    def rests(self) -> str:
        """A pattern of the control strings without their first character."""
        return "|".join(quoted(s[1:]) for s in self.controls())


def quoted(text: str) -> str:
    """``text`` as a regular expression."""
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def escape(text: Column, template: Template = Template()) -> Column:
    """Control strings made harmless by one backslash; ``unescape`` is the inverse."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([<\[])(\\*)({template.rests()})", r"$1\\$2$3")


def unescape(text: Column, template: Template = Template()) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({template.rests()})", "$1$2$3")


def format_chats(
    conversations: DataFrame, template: Template = Template(), trained: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans``.

    ``loss_spans`` are structs of ``start`` (0-based) and ``length`` in code points of
    ``formatted``: the escaped texts of the ``trained`` role, in order.
    """
    t = template
    turns = pick(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("turn"),
    )
    # A run: its role and its escaped texts.
    kind = "array<struct<role:string,texts:array<string>>>"

    # Where a run starts is a look at the turn before; no turn is copied twice.
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    marked = ordered.withColumn("n", F.size("turns"))
    starts = F.filter(
        F.transform(
            F.col("turns"),
            lambda turn, i: F.when(
                (i == 0) | (turn["role"] != F.get(F.col("turns"), i - 1)["role"]), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    runs = F.transform(
        F.col("starts"),
        lambda first, i: F.struct(
            F.get(F.col("turns"), first)["role"].alias("role"),
            F.transform(
                F.slice(
                    F.col("turns"),
                    first + 1,
                    F.coalesce(F.get(F.col("starts"), i + 1), F.col("n")) - first,
                ),
                lambda turn: escape(turn["text"], t),
            ).alias("texts"),
        ),
    ).cast(kind)
    # The formatted text as pieces, each with the mark whether it is trained on.
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    pieces = F.flatten(
        F.transform(
            F.col("runs"),
            lambda run: F.concat(
                F.array(piece(F.concat(F.lit(t.head), escape(run["role"], t), F.lit(t.body)), no)),
                F.flatten(
                    F.transform(
                        run["texts"],
                        lambda text, i: F.array(
                            piece(F.when(i > 0, F.lit(t.next)).otherwise(F.lit("")), no),
                            piece(text, run["role"] == trained),
                        ),
                    )
                ),
                F.array(piece(F.lit(t.end), no)),
            ),
        )
    )
    span = "array<struct<start:int,length:int>>"
    spans = F.aggregate(
        F.col("pieces"),
        F.struct(F.lit(len(t.begin)).alias("at"), F.array().cast(span).alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["text"])).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    s["spans"],
                    F.array(F.struct(s["at"].alias("start"), F.char_length(p["text"]).alias("length"))),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return (
        marked.withColumn("starts", starts)
        .select("conv_id", runs.alias("runs"))
        .select("conv_id", pieces.alias("pieces"))
        .select(
            "conv_id",
            F.concat(
                F.lit(t.begin), F.array_join(F.transform("pieces", lambda p: p["text"]), "")
            ).alias("formatted"),
            spans.alias("loss_spans"),
        )
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text: an array of structs ``role``, ``text``."""
    t = template
    body = F.substring(formatted, F.lit(len(t.begin) + 1), F.char_length(formatted))
    # Every run ends in the end string, so the last piece of the split is empty.
    runs = F.split(body, quoted(t.end))
    parts = F.transform(
        F.slice(runs, 1, F.size(runs) - 1), lambda run: F.split(run, quoted(t.body))
    )
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(F.element_at(p, 2), quoted(t.next)),
                lambda text: F.struct(
                    unescape(F.substring(F.element_at(p, 1), len(t.head) + 1, 1 << 30), t).alias("role"),
                    unescape(text, t).alias("text"),
                ),
            ),
        )
    )


def masked_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]), template),
        ),
        "",
    )


def digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What a formatted conversation says when it is read back."""
    turn_text = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chats.select(
        "conv_id",
        read_back(F.col("formatted"), template).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_spans"), template).alias("loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    ).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn_text), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
